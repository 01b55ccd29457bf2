"""Substring dedup: fixed-block anchors, probed by every rolling window and extended to maximal exact repeats.

A word is removed if a window of ``WINDOW`` words that covers it also starts in a document with a smaller doc_id.

1. Index and probe. Every document gives its non-overlapping blocks of half a window (at multiples of the block) to the
   index, and probes it with every rolling window of a block's length. Any window of ``WINDOW`` words contains a whole
   block of its document, and its twin in another document has a rolling window there, so no repeat is missed. Hits are
   documents' positions whose hash stands in the index with a smaller document, or in a larger document as a probe.
2. Extend. Around each hit all windows of ``WINDOW`` words that contain it are hashed anew (64 bits); the smallest
   document of each such hash decides which starts are repeats, and neighbouring starts join to maximal repeats.
3. Remove the words that the repeats cover.

Hashes are 32 bits within a part in step 1 (a chance hit costs work, not words) and 64 bits in step 2. NULL and empty
texts have no words. A NULL doc_id counts as larger than any; rows that share an id don't shorten each other. Groups of
any size are summed up by their smallest document only; no pair is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import REPLY, SCHEMA, Answers, Dealer, brought_together, gathered, home, parts_for, replies, starts_of
from loomwright.llm.words import Rolling, WordHashes, slices
from loomwright.plans.store import cut, release

WINDOW = 50
LAST = (1 << 63) - 1
DONE = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by one space, as bytes."""
    block = window // 2
    parts = parts_for(docs, text)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col(text).cast("binary").alias("body"))
    hits = cut(_hits(_messages(source, parts, window, block), parts, block))
    release(docs.sparkSession)
    marked = cut(_marked(source, hits, parts, window, block))
    release(docs.sparkSession)
    repeats = _repeats(marked.filter("starts is not null"), parts, window)
    texts = marked.filter("starts is not null").select(home(F.col("doc"), parts).alias("part"), F.lit(1).alias("role"), "doc", "twin", "body")
    shortened = _with_answers(texts, repeats, parts).mapInArrow(_shorten(window), DONE)
    plain = marked.filter("starts is null").select(F.col("doc").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("body").alias("kept"))
    return plain.unionByName(shortened).withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def _messages(source: DataFrame, parts: int, window: int, block: int) -> DataFrame:
    def run(batches):
        hashes, rolling, dealer = WordHashes(), Rolling(), Dealer(parts, "<u4")
        for batch in slices(batches):
            for doc, body in zip(*[c.to_pylist() for c in batch.columns]):
                words = body.split() if body else []
                if len(words) < window:
                    continue
                all_ = rolling.windows(rolling.prefix(hashes.of(words)), block)
                if dealer.add(all_, np.arange(len(all_), dtype=np.int32), (doc,)):
                    yield from dealer.flush()
        yield from dealer.flush()

    return source.mapInArrow(run, SCHEMA)


def _hits(messages: DataFrame, parts: int, block: int) -> DataFrame:
    """Positions of blocks and windows that another document shares."""

    def run(batches):
        for hashes, positions, owners in gathered(batches, "<u4"):
            doc = owners[:, 0]
            begin = starts_of(hashes)
            group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(hashes)]])))
            anchor = positions % block == 0
            first = np.minimum.reduceat(np.where(anchor, doc, LAST), begin)
            last = np.maximum.reduceat(doc, begin)
            hit = np.flatnonzero((doc > first[group]) | (anchor & (doc < last[group])))
            yield from replies(owners[hit], positions[hit], parts)

    return brought_together(messages, parts).mapInArrow(run, REPLY)


def _with_answers(texts: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Texts and the answers about them, part by part, the answers first."""
    none = {c: F.lit(None).cast("binary") for c in ("positions", "owners", "counts")}
    asked = answers.withColumn("role", F.lit(0))
    both = texts.withColumns(none).unionByName(asked, allowMissingColumns=True)
    return both.repartition(parts, "part").sortWithinPartitions("part", "role")


def _marked(source: DataFrame, hits: DataFrame, parts: int, window: int, block: int) -> DataFrame:
    """Every row once: with ``starts`` (ranges of window starts to look at), or finished, its body then the kept words."""
    texts = source.select(home(F.col("doc"), parts).alias("part"), F.lit(1).alias("role"), "doc", "body")

    def run(batches):
        part, found = None, Answers()
        for batch in slices(batches):
            out = []
            for where, role, doc, body, *answer in zip(*[c.to_pylist() for c in batch.columns]):
                if where != part:
                    part, found = where, Answers()
                if role == 0:
                    found.add(*answer)
                    continue
                words = body.split() if body else []
                n = len(words)
                hit = found.of((doc,)) if n >= window else None
                if hit is not None:  # rows of one id share their hits; those past this text's end are another row's
                    hit = hit[hit <= n - block]
                if hit is None or not len(hit):
                    out.append((doc, 0, n, b" ".join(words), None))
                else:
                    out.append((doc, xxhash.xxh3_64_intdigest(body) - (1 << 63), n, body, _ranges(hit, n, window, block).astype("<i4").tobytes()))
            if out:
                a, b, c, d, e = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), pa.array(e, pa.binary())],
                    ["doc", "twin", "n_words", "body", "starts"])

    return _with_answers(texts, hits, parts).mapInArrow(run, "doc bigint, twin bigint, n_words bigint, body binary, starts binary")


def _ranges(hits: np.ndarray, n: int, window: int, block: int) -> np.ndarray:
    """Ranges (from, until) of starts of windows that contain a hit."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(hits - (window - block), 0), 1)
    np.add.at(change, np.minimum(hits, n - window) + 1, -1)
    on = np.concatenate([[False], np.cumsum(change)[:n - window + 1] > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge.reshape(-1, 2)


def _repeats(marked: DataFrame, parts: int, window: int) -> DataFrame:
    """Starts of windows that also start in a smaller document."""

    def deal(batches):
        hashes, rolling, dealer = WordHashes(), Rolling(), Dealer(parts, "<u8", width=2)
        for batch in slices(batches):
            for doc, twin, body, starts in zip(*[c.to_pylist() for c in batch.columns]):
                all_ = rolling.windows(rolling.prefix(hashes.of(body.split())), window)
                at = np.concatenate([np.arange(i, j, dtype=np.int32) for i, j in np.frombuffer(starts, "<i4").reshape(-1, 2).tolist()])
                if dealer.add(all_[at], at, (doc, twin)):
                    yield from dealer.flush()
        yield from dealer.flush()

    def smallest(batches):
        for hashes, positions, owners in gathered(batches, "<u8", width=2):
            begin = starts_of(hashes)
            group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(hashes)]])))
            later = np.flatnonzero(owners[:, 0] > np.minimum.reduceat(owners[:, 0], begin)[group])
            yield from replies(owners[later], positions[later], parts)

    messages = marked.select("doc", "twin", "body", "starts").mapInArrow(deal, SCHEMA)
    return brought_together(messages, parts).mapInArrow(smallest, REPLY)


def _shorten(window: int):
    def run(batches):
        part, found = None, Answers(2)
        for batch in slices(batches):
            out = []
            for where, role, doc, twin, body, *answer in zip(*[c.to_pylist() for c in batch.columns]):
                if where != part:
                    part, found = where, Answers(2)
                if role == 0:
                    found.add(*answer)
                    continue
                words = body.split()
                change = np.zeros(len(words) + 1, np.int32)
                if (starts := found.of((doc, twin))) is not None:
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
                out.append((doc, len(words), int(gone.sum()), kept))
            if out:
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (a, b, c)], pa.array(d, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run
