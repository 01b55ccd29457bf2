"""Token counts against the tokenizers library: random texts of awkward characters, odd rows, other vocabularies."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from loomwright.llm import token_counts
from loomwright.llm.bpe import load, portions

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["a", "the", "The", "'s", "'ll", "S", "e\u0301", "\u00e9", "\u00dc", "\u3000", "\u00a0", " ", "  ", "\n", "\t", ".", "...", "!?", "1", "23",
         "\u01c5", "\u0130", "\u00df", "\ufb01", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\u4e2d\u6587", "\U0001f600", "\u03a3", "\x1c",
         "\x85", "\u0301", "\ufeff", "\x00", "don't", "hello", "ertion", "\u2028", "\u1100\u1161", "\uac00", "\ufdfa", "\u0345"]


def random_texts(n, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(ATOMS) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def by_library(texts, path):
    return [len(e.ids) for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_equal_the_library(path):
    texts = random_texts(3000)
    counter = token_counts.Words(path)
    want = by_library(texts, path)
    assert [counter.one(t) for t in texts] == want
    if counter.by_word:
        assert token_counts.ByWord(counter).of(pa.array(texts)).tolist() == want


def test_proof_holds_only_strings_that_stay_whole():
    counter = token_counts.Words(WORD)
    assert counter.by_word and not token_counts.Words(BYTE).by_word
    assert {"the", "hello", "!", "...", "'s"} <= counter.whole and "ertion" not in counter.whole
    some = sorted(counter.whole)[::97]
    assert all(len(counter.tokenizer.model.tokenize(s)) == 1 for s in some)


def test_rows(spark):
    long = "word, " * 40_000 + "x" * 30_000
    texts = [None, "", " \n", "plain words", long, "plain words", "<|endoftext|>tail", *random_texts(50, 9)]
    rows = [(k if k != 3 else None, t, 7, "clash", None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, odd_name string, empty string").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 3, r["n_bytes"], r["n_tokens"], r["over_limit"], r["odd_name"]) for r in token_counts.count(docs, WORD, limit=100).collect())
    want = by_library(texts, WORD)
    assert got == [(k, len((t or "").encode()), n, n > 100, "clash") for k, (t, n) in enumerate(zip(texts, want))]
    none = token_counts.count(docs.limit(0), WORD)
    assert none.collect() == [] and none.columns == ["doc_id", "odd_name", "empty", "n_bytes", "n_tokens", "over_limit"]


def test_portions_cover_all_rows():
    assert list(portions([5, 0, 9, 30, 1, 1], 10)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(portions([])) == []
