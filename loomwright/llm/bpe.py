"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

Two neighbouring bytes that occur side by side in no vocabulary token can never be merged, so a text may be cut between
them. Fragments are encoded on their own, each distinct one once, and the ids are joined again. A cut must also leave
the pre-tokenizer's pieces as they are. Its pattern never looks back, so only three places could change a piece, and no
cut is made there: inside a character, behind white space (a run of it depends on what follows) and before an
apostrophe (a contraction is read only at the start of a piece).

NULL and empty texts have no ids and decode to the empty text. Ids are bytes: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.words import slices

#: Last bytes of non-ASCII white space characters in UTF-8 (fixed values).
_SPACE_ENDS = [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]
#: Fragments remembered in a task, and bytes of text that are cut at a time.
REMEMBERED, AT_A_TIME = 1_000_000, 1 << 20


def load(path: str):
    """The tokenizer of ``path`` as it encodes by default, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(tokenizer) -> list[bytes]:
    """id -> bytes; an id that stands for nothing decodes to nothing."""
    alphabet = byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        known = all(c in alphabet for c in token)
        out[i] = bytes(alphabet[c] for c in token) if known else token.encode()
    return out


def cut_table(tokenizer) -> np.ndarray:
    """256 * first + second byte -> whether a text may be cut between the two."""
    may = np.ones((256, 256), bool)
    may[:, 0x80:0xC0] = False
    may[:0x21, :] = False
    may[_SPACE_ENDS, :] = False
    may[:, ord("'")] = False
    may = may.reshape(-1)
    for token in token_bytes(tokenizer):
        raw = np.frombuffer(token, np.uint8).astype(np.int64)
        may[raw[:-1] * 256 + raw[1:]] = False
    return may


def fragments(data: bytes, may: np.ndarray) -> list[bytes]:
    raw = np.frombuffer(data, np.uint8).astype(np.uint16)
    if not len(raw):
        return []
    at = (np.flatnonzero(may[(raw[:-1] << 8) | raw[1:]]) + 1).tolist()
    return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]


class Pieces:
    """Ids of independent pieces of text, each distinct piece encoded once while it is remembered."""

    def __init__(self, tokenizer, kind: str = "<u4"):
        self.tokenizer, self.kind, self.known = tokenizer, kind, {}

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:  # what came first is what comes often
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        for at in range(0, len(new), 4096):
            self.learn(new[at:at + 4096])
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]

    def learn(self, pieces: list[bytes]) -> None:
        done = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        self.known.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(pieces, done))


class Words(Pieces):
    """Pieces for a vocabulary with word ends, whose tokenizer drops white space: the pieces are words.

    A word of plain letters is one unit of the pre-tokenizer, with a mark behind it two, and each unit ends in a token
    with the word-end suffix. So many such words are encoded as one text and parted at these tokens; others one by one.
    """

    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]?)")

    def __init__(self, tokenizer, kind: str = "<u4"):
        super().__init__(tokenizer, kind)
        self.suffix = tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if self.suffix:
            for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(self.suffix)

    def learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        marks = [self.PLAIN.fullmatch(t) if self.suffix else None for t in texts]
        super().learn([p for p, m in zip(pieces, marks) if not m])
        plain = [k for k, m in enumerate(marks) if m]
        for at in range(0, len(plain), 512):
            some = plain[at:at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 + bool(marks[k][1]) for k in some]) - 1
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                super().learn([pieces[k] for k in some])
                continue
            until = (ends[last] * ids.itemsize).tolist()
            raw = ids.tobytes()
            self.known.update((pieces[k], raw[i:j]) for k, i, j in zip(some, [0, *until[:-1]], until))


@lru_cache(maxsize=2)
def shared(path: str, kind: str = "<u4") -> tuple[Pieces, np.ndarray]:
    """Pieces and cut table of a tokenizer file, kept by a Python worker from task to task."""
    tokenizer = load(path)
    return Pieces(tokenizer, kind), cut_table(tokenizer)


class WordIds:
    """Ids of texts whose pieces are words: distinct words get numbers, and all ids of some texts are one gather by them.

    Words are found and looked up as Arrow arrays. A-Z is lowered first, which the tokenizer does anyway, unless that
    would make up a special string; a mark behind letters is parted from them, as the pre-tokenizer does.
    """

    MARKED, SPACED = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])([ \\x09-\\x0d]|$)", "\\1 \\2\\3"

    def __init__(self, words: Words):
        self.words = words
        self.specials = [t.content for t in words.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.string())
        self.flat, self.start, self.length = np.empty(0, self.words.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _apart(self, texts: pa.Array) -> pa.Array:
        low = pc.ascii_lower(texts)
        made_up = any(pc.sum(pc.count_substring(low, s)).as_py() != pc.sum(pc.count_substring(texts, s)).as_py() for s in self.specials)
        return pc.replace_substring_regex(texts if made_up else low, self.MARKED, self.SPACED) if self.words.suffix else texts

    def _learn(self, new: pa.Array) -> None:
        words = [w.encode() for w in new.to_pylist()]
        self.words.learn(words)
        ids = list(map(self.words.known.__getitem__, words))
        self.words.known = {}
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.flat.itemsize
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), self.flat.dtype)])
        self.known = pa.concat_arrays([self.known, new])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin and end."""
        lists = pc.ascii_split_whitespace(self._apart(texts))
        coded = lists.values.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.clear()
        self._learn(coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, value_set=self.known))))
        of = pc.index_in(coded.dictionary, value_set=self.known).to_numpy()[coded.indices.to_numpy()]
        size = self.length[of]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[of] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[lists.offsets.to_numpy()]


@lru_cache(maxsize=2)
def shared_words(path: str, kind: str = "<u4") -> WordIds:
    return WordIds(Words(load(path), kind))


def portions(lengths: Iterable[int], most: int = 8 * AT_A_TIME) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with about ``most`` bytes; a longer text is a run of its own."""
    start = size = n = 0
    for k, length in enumerate(lengths):
        if size and size + length > most:
            yield start, k - start
            start, size = k, 0
        size += length
        n = k + 1
    if n > start:
        yield start, n - start


def in_portions(values: list[bytes | None], most: int = AT_A_TIME) -> Iterator[list[bytes]]:
    portion, size = [], 0
    for v in values:
        portion.append(v or b"")
        size += len(portion[-1])
        if size >= most:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def _with_column(df: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with the column ``name`` that ``make`` builds from its batches."""
    fields = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, kind)])
    return df.mapInArrow(make, schema)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of its texts; a column of the name ``ids`` is replaced."""
    place = "__utf8__"
    keep = [c for c in docs.columns if c != ids]

    def run(batches):
        pieces, may = shared(tokenizer_path)
        for batch in slices(batches):
            at = batch.schema.get_field_index(place)
            done = []
            for portion in in_portions(batch.column(at).to_pylist()):
                done += pieces.ids([fragments(d, may) for d in portion])
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in rest], pa.array(done, pa.binary())], [*[batch.schema.names[k] for k in rest], ids])

    raw = docs.select(*keep, F.col(text).cast("binary").alias(place))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(ids, T.BinaryType())])
    return raw.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; bytes that are no UTF-8 become replacement characters."""

    def run(batches):
        table = token_bytes(shared(tokenizer_path)[0].tokenizer)
        for batch in slices(batches):
            raw = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [b"".join(map(table.__getitem__, np.frombuffer(r or b"", "<u4").tolist())).decode("utf-8", "replace") for r in raw]
            keep = [k for k, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(texts, pa.string())], [*[batch.schema.names[k] for k in keep], text])

    return _with_column(encoded, text, T.StringType(), run)
