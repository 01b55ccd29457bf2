"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept a group.

Cell centres are fitted on a bounded sample (about ``SAMPLE`` vectors by a hash of their ids). Every vector lives in
its nearest cell and visits the next ones whose similarity is within ``MARGIN`` of it, ``VISITS`` at most, so that a
pair which the border of two cells parts is still found from either side. In a cell all visitors and residents are
compared with all residents, block by block; no pair is written. A pair that both sides find is counted in the lower of
the two cells. What is written: how many vectors each one links to, and links enough to join the groups.

Cells have no cap: the residents of a large one are dealt into blocks by a hash, and who compares goes to all of them.
Unusable vectors (see ``vectors.usable``) link with nothing and are their own group. Rows are taken one by one, so rows
that repeat an id link with each other and share the group of their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.graph import components
from loomwright.llm.sampling import about
from loomwright.llm.vectors import matrix, packed, row_dots, runs, unpacked, usable
from loomwright.plans.store import cut

THRESHOLD, PER_CELL, MOST_CELLS, SAMPLE, VISITS, MARGIN, BLOCK = 0.95, 512, 4096, 16384, 3, 0.15, 2048
_NEAR = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(row_dots(rows, rows))[:, None]


def kmeans(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Spherical k-means: centres are unit vectors, nearness is the cosine."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt(row_dots(sums, sums))
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def groups(
    table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    per_cell: int = PER_CELL, visits: int = VISITS, margin: float = MARGIN, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of the table."""
    spark = table.sparkSession
    numbered = cut(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("row", F.monotonically_increasing_id()))
    rows = usable(numbered.filter("id is not null"), "v").select("row", "id", F.col("v").cast("array<double>").alias("v"))
    n = rows.count()
    if n < 2:
        return numbered.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    first = unit(matrix(about(rows, sample, "id").orderBy("id").select("v").toArrow().column(0).combine_chunks()))
    cells = max(1, min(MOST_CELLS, len(first) // 4, -(-n // per_cell)))
    centres = spark.sparkContext.broadcast(kmeans(first, cells))

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data = unit(matrix(part.column(2)))
                near = data @ centres.value.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :1 + visits]
                close = np.take_along_axis(near, top, 1)
                top = np.where(close >= close[:, :1] - margin, top, -1)
                pad = np.full((len(data), 1 + visits), -1, np.int32)
                pad[:, :top.shape[1]] = top
                where, which = np.nonzero(pad >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pad[where, which]), pa.array((which > 0).astype(np.int32)), part.column(0).take(pa.array(where)), part.column(1).take(pa.array(where)),
                     pa.array([r.tobytes() for r in pad[where]], pa.binary()), packed(data[where])], ["cell", "visitor", "row", "id", "cells", "v"])

    placed = rows.mapInArrow(assign, "cell int, visitor int, row bigint, id bigint, cells binary, v binary")
    sizes = cut(placed.filter("visitor = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")))
    dealt = placed.join(sizes, "cell")
    own = dealt.filter("visitor = 0").select("cell", F.pmod(F.xxhash64("row"), F.col("n")).cast("int").alias("part"), F.lit(0).alias("role"), "row", "id", "cells", "v")
    come = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), (F.col("visitor") + 1).alias("role"), "row", "id", "cells", "v")
    found = cut(_compare(own.unionByName(come), threshold))
    counts = found.filter("other is null").groupBy("row").agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = numbered.select("row", "id").join(counts, "row", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("id")).alias("kept"))


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts of links by row (other is NULL), and links (id, other) enough to join what is linked in a block."""

    def counted(number, total):
        has = np.flatnonzero(total)
        return _batch(number[has], np.zeros(len(has), np.int64), None, total[has])

    def run(batches):
        lives = None
        for begins, part in runs(batches, ["cell", "part"]):
            if begins:
                if lives is not None and lives.gained.any():
                    yield counted(lives.rows, lives.gained)
                lives = _Residents()
            role = part.column(2).to_numpy()
            at_home = role == 0
            if at_home.any():
                lives.add(part.filter(pa.array(at_home)))
            for kind in (1, 2):
                if (role == kind).any() and lives.many:
                    who = part.filter(pa.array(role == kind))
                    total, left, right = lives.link(who, kind == 2, threshold)
                    yield counted(who.column(3).to_numpy(), total)
                    if len(left):
                        yield _batch(np.zeros(len(left), np.int64), left, right, np.zeros(len(left), np.int64))
        if lives is not None and lives.many and lives.gained.any():
            yield counted(lives.rows, lives.gained)

    sorted_ = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    return sorted_.mapInArrow(run, "row bigint, id bigint, other bigint, n bigint")


def _batch(row, left, right, n) -> pa.RecordBatch:
    other = pa.nulls(len(row), pa.int64()) if right is None else pa.array(right, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(left, pa.int64()), other, pa.array(n, pa.int64())], ["row", "id", "other", "n"])


class _Residents:
    """One block of a cell's residents, with a label for each: residents of one label are joined by links written."""

    def __init__(self):
        self.parts, self.rows, self.many, self.gained = [], np.empty(0, np.int64), False, np.zeros(0, np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)
        self.many = True
        whole = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.parts = [whole]
        self.cell = whole.column(0)[0].as_py()
        self.rows, self.ids = whole.column(3).to_numpy(), whole.column(4).to_numpy()
        self.cells = np.frombuffer(b"".join(whole.column(5).to_pylist()), np.int32).reshape(len(self.rows), -1)
        self.data = unpacked(whole.column(6))
        self.gained = np.zeros(len(self.rows), np.int64)
        self.label = np.arange(len(self.rows))

    def link(self, who: pa.RecordBatch, visiting: bool, threshold: float):
        rows, ids = who.column(3).to_numpy(), who.column(4).to_numpy()
        cells = np.frombuffer(b"".join(who.column(5).to_pylist()), np.int32).reshape(len(rows), -1)
        data = unpacked(who.column(6))
        near = data @ self.data.T
        linked = near >= threshold
        x, y = np.nonzero(np.abs(near - threshold) < _NEAR)
        linked[x, y] = row_dots(data[x], self.data[y]) >= threshold
        linked &= rows[:, None] != self.rows[None, :]
        if visiting:
            # found from the other side as well, and counted there
            home = cells[:, 0]
            again = np.zeros(linked.shape, bool)
            lower = np.flatnonzero(home < self.cell)
            for c in range(self.cells.shape[1]):
                again[lower] |= self.cells[None, :, c] == home[lower, None]
            linked &= ~again
            self.gained += linked.sum(axis=0)
        left, right = [], []
        active = np.flatnonzero(linked.any(axis=1))
        sub = linked[active]
        while len(active):
            labels = np.where(sub, self.label[None, :], len(self.label))
            least, pick = labels.min(axis=1), labels.argmin(axis=1)
            left.append(ids[active])
            right.append(self.ids[pick])
            offered = np.where(sub, least[:, None], len(self.label))
            lowest, by = offered.min(axis=0), offered.argmin(axis=0)
            moved = np.flatnonzero(lowest < self.label)
            if not len(moved):
                break
            left.append(ids[active][by[moved]])
            right.append(self.ids[moved])
            self.label[moved] = lowest[moved]
        if not left:
            return linked.sum(axis=1), np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
        return linked.sum(axis=1), pairs[:, 0], pairs[:, 1]
