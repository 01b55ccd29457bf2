"""Hashes dealt out to parts in packed messages, instead of one row each.

A task gathers the entries (hash, owner, position) of many owners, sorts them by part and writes one row for each part:
the hashes, the positions in byte planes (the upper ones hardly change, so they compress to little), and the owners with
their numbers of entries. A part is a range of hashes; its reader gets all entries of its hashes back as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, hashes binary, positions binary, owners binary, counts binary"
#: Entries gathered before they are written, and bytes of text a part stands for.
GATHERED, TEXT_A_PART = 1 << 20, 10 << 20


def parts_for(docs: DataFrame, text: str = "text") -> int:
    """Parts in proportion to the text, so that each holds about as much at any size."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(16, -(-size // TEXT_A_PART))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """By the upper 32 bits, which leaves the lower ones to tell hashes of a part apart."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


class Dealer:
    """Gathers entries and writes messages. ``kind`` is how much of a hash is kept: '<u4' or '<u8'; an owner is ``width`` int64."""

    def __init__(self, parts: int, kind: str = "<u8", width: int = 1):
        self.parts, self.kind, self.width = parts, kind, width
        self.clear()

    def clear(self) -> None:
        self.hashes, self.positions, self.owners, self.lengths, self.held = [], [], [], [], 0

    def add(self, hashes: np.ndarray, positions: np.ndarray, owner: tuple[int, ...]) -> bool:
        """True if it is time to flush."""
        if len(hashes):
            self.hashes.append(hashes)
            self.positions.append(positions)
            self.owners.append(owner)
            self.lengths.append(len(hashes))
            self.held += len(hashes)
        return self.held >= GATHERED

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        hashes, positions = np.concatenate(self.hashes), np.concatenate(self.positions).astype("<i4")
        owner = np.repeat(np.arange(len(self.owners), dtype=np.int32), self.lengths)
        part = part_of(hashes, self.parts)
        order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
        hashes, positions, owner, part = hashes[order], positions[order], owner[order], part[order]
        names = np.array(self.owners, "<i8").reshape(len(self.owners), self.width)
        change = np.flatnonzero((part[1:] != part[:-1]) | (owner[1:] != owner[:-1])) + 1
        begin = np.concatenate([[0], change])
        size = np.diff(np.concatenate([begin, [len(part)]])).astype("<i4")
        of = part[begin]
        edge = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        rows = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            a, b = begin[i], begin[j] if j < len(begin) else len(part)
            rows.append((int(of[i]), hashes[a:b].astype(self.kind).tobytes(), planes(positions[a:b]), names[owner[begin[i:j]]].tobytes(), size[i:j].tobytes()))
        self.clear()
        for at in range(0, len(rows), 256):
            yield batch_of(rows[at:at + 256])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    a, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), *[pa.array(c, pa.binary()) for c in rest]], ["part", "hashes", "positions", "owners", "counts"])


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def gathered(batches: Iterator[pa.RecordBatch], kind: str = "<u8", width: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, positions, owners) of each part, sorted by hash; the messages of a part must follow each other."""

    def whole(messages):
        hashes = np.concatenate([np.frombuffer(m[0], kind) for m in messages])
        positions = np.concatenate([from_planes(m[1]) for m in messages])
        owners = np.concatenate([np.repeat(np.frombuffer(m[2], "<i8").reshape(-1, width), np.frombuffer(m[3], "<i4"), axis=0) for m in messages])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], positions[order], owners[order]

    last, held = None, []
    for batch in batches:
        for part, *message in zip(*[c.to_pylist() for c in batch.columns]):
            if part != last and held:
                yield whole(held)
                held = []
            last = part
            held.append(message)
    if held:
        yield whole(held)


def brought_together(messages: DataFrame, parts: int) -> DataFrame:
    """Messages of a part in one task, one after the other."""
    return messages.repartition(parts, "part").sortWithinPartitions("part")


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.empty(0, np.int64)


REPLY = "part int, positions binary, owners binary, counts binary"


def home(doc: Column, parts: int) -> Column:
    """The part to which answers about a document go; ``replies`` says the same in numpy."""
    return F.shiftright(F.shiftrightunsigned(F.xxhash64(doc), 32) * F.lit(parts).cast("long"), 32).cast("int")


def replies(owners: np.ndarray, positions: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Positions of owners (first column: the document) in one message for each part."""
    if not len(positions):
        return
    docs, of = np.unique(owners[:, 0], return_inverse=True)
    # Spark's xxhash64 of a bigint is XXH64 of its eight bytes with seed 42
    hashed = np.array([xxhash.xxh64_intdigest(d.tobytes(), 42) for d in docs.astype("<i8")], np.uint64)
    part = part_of(hashed, parts)[of]
    order = np.lexsort((positions, *owners.T[::-1], part))
    owners, positions, part = owners[order], positions[order].astype("<i4"), part[order]
    begin = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (owners[1:] != owners[:-1]).any(axis=1)) + 1])
    size = np.diff(np.concatenate([begin, [len(part)]])).astype("<i4")
    of = part[begin]
    edge = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    rows = []
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        a, b = begin[i], begin[j] if j < len(begin) else len(part)
        rows.append((int(of[i]), planes(positions[a:b]), owners[begin[i:j]].astype("<i8").tobytes(), size[i:j].tobytes()))
    names = ["part", "positions", "owners", "counts"]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names)


class Answers:
    """The replies of one part, by owner."""

    def __init__(self, width: int = 1):
        self.width, self.raw, self.by = width, [], None

    def add(self, positions: bytes, owners: bytes, counts: bytes) -> None:
        self.raw.append((from_planes(positions), np.frombuffer(owners, "<i8").reshape(-1, self.width), np.frombuffer(counts, "<i4")))

    def of(self, owner: tuple[int, ...]) -> np.ndarray | None:
        if self.by is None:
            self.by = {}
            for positions, owners, counts in self.raw:
                ends = np.cumsum(counts).tolist()
                for name, i, j in zip(map(tuple, owners.tolist()), [0, *ends[:-1]], ends):
                    self.by.setdefault(name, []).append(positions[i:j])
            self.raw = []
        found = self.by.get(owner)
        return None if found is None else np.concatenate(found)
