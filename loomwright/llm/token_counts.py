"""Token counts of whole texts by a whole-token shortcut.

Which vocabulary strings are one token when they stand alone is proved once for a tokenizer file, by letting the model
merge each of them: such a pre-token counts 1 without any merging. The other pre-tokens are merged, each distinct one
once. The counts of distinct words are added up along the texts as arrays.

A text may be counted word by word (words are parted by white space) where the tokenizer drops white space and no
special string holds any; ``Words`` checks both and else counts text by text. Words that hold a special string go to the
tokenizer whole. Files of the tokenizers library (.json) are served.

NULL and empty texts have no bytes and no tokens. Rows are taken as they are (repeated rows, NULL ids, any order); an
empty table gives an empty table. Columns of the input that have the name of a result are replaced, the text is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.bpe import load, portions

LIMIT = 2048
#: Distinct words whose count a task remembers, and words split at a time.
REMEMBERED, TOGETHER = 500_000, 4096


def prove(tokenizer) -> frozenset[str]:
    """Vocabulary strings, as pre-tokens, that the model leaves as the one token they are."""
    suffix = tokenizer.model.end_of_word_suffix or ""
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    bare = ((token[:len(token) - len(suffix)], i) for token, i in vocabulary.items() if token.endswith(suffix))
    return frozenset(s for s, i in bare if s and [t.id for t in tokenizer.model.tokenize(s)] == [i])


class Words:
    """Numbers of tokens for a file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.whole = prove(self.tokenizer)
        self.merged: dict[str, int] = {}
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        spaced = any(re.search(r"\s", s) for s in specials)
        self.by_word = not spaced and self._parts(" ") == [] and self._parts("a b") == self._parts("a") + self._parts("b")

    def _split(self, text: str) -> tuple[str, list]:
        normal = self.tokenizer.normalizer
        text = normal.normalize_str(text) if normal else text
        return text, self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def _parts(self, text: str) -> list[str]:
        return [part for part, _ in self._split(text)[1]]

    def _cost(self, part: str) -> int:
        if part in self.whole:
            return 1
        n = self.merged.get(part)
        if n is None:
            if len(self.merged) >= REMEMBERED:
                self.merged = dict(islice(self.merged.items(), REMEMBERED // 2))
            n = self.merged[part] = len(self.tokenizer.model.tokenize(part))
        return n

    def one(self, text: str) -> int:
        """Tokens of one text or word."""
        if self.special and self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(self._cost(part) * k for part, k in Counter(self._parts(text)).items())

    def words(self, words: list[str]) -> list[int]:
        """Tokens of each word, split together; one by one where a word holds white space of its own or a special string."""
        if self.special and self.special.search("\n".join(words)):
            return [self.one(w) for w in words]
        text, parts = self._split("\n".join(words))
        gaps = np.array([m.start() for m in re.finditer(" ", text)], np.int64)
        if len(gaps) != len(words) - 1:
            return [self.one(w) for w in words]
        of = np.searchsorted(gaps, np.fromiter((at for _, (at, _) in parts), np.int64, len(parts)))
        costs = np.fromiter((self._cost(part) for part, _ in parts), np.int64, len(parts))
        return np.bincount(of, costs, len(words)).astype(np.int64).tolist()


@lru_cache(maxsize=2)
def shared(path: str) -> Words:
    """The counter of a file with its proof, kept by a Python worker from task to task."""
    return Words(path)


class ByWord:
    """Counts of texts from counts of their distinct words, which are remembered."""

    def __init__(self, counter: Words):
        self.counter, self.known = counter, {"": 0}

    def of(self, texts: pa.Array) -> np.ndarray:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:  # what came first is what comes often
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), TOGETHER):
            some = new[at:at + TOGETHER]
            self.known.update(zip(some, self.counter.words(some)))
        cost = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        upto = np.concatenate([[0], np.cumsum(cost[coded.indices.to_numpy()])])
        edges = lists.offsets.to_numpy()
        return upto[edges[1:]] - upto[edges[:-1]]


def count(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """All columns but the text, and n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in docs.schema.fields if f.name not in (*new, text)]
    schema = T.StructType([*keep, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.BooleanType())])

    def run(batches):
        counter = shared(tokenizer_path)
        by_word = ByWord(counter) if counter.by_word else None
        for batch in batches:
            texts = batch.column(len(keep))
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            tokens = []
            for at, n in portions(size.tolist()):
                some = texts.slice(at, n)
                tokens.append(by_word.of(some) if by_word else np.fromiter(map(counter.one, some.to_pylist()), np.int64, n))
            tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            columns = [*batch.columns[:len(keep)], pa.array(size), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.select(*[f.name for f in keep], F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, schema)
