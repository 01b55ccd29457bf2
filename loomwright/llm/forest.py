"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree halves a bounded sample of the vectors (about ``SAMPLE`` by a hash of their ids) along the difference of
two sampled vectors, at the median, down to leaves of about ``LEAF`` sampled vectors. Every vector of the table is then
put into one leaf of each tree. A query walks all trees at once with one priority queue: a node waits with the smallest
margin on the way to it, the most promising node of any tree is opened next, until enough leaves are reached. The
members of these leaves are compared exactly, in double precision, and the nearest are kept, first within a leaf's
block, then over all.

Leaves have no cap: a large one is dealt into blocks by a hash of the id, and its queries go to all of them. Unusable
vectors (see ``vectors.usable``) take no part. Ties go to the smaller id; rows that repeat an id count once, with the
nearest of them. An empty table has an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.sampling import about
from loomwright.llm.vectors import matrix, packed, row_dots, runs, stored_kind, unpacked, usable
from loomwright.plans.store import cut

TREES, LEAF, SAMPLE, LEAVES, BLOCK = 8, 128, 16384, 160, 4096
_SLACK = 1e-9


class Tree:
    """Inner nodes as arrays: direction, threshold, children; a negative child -1-k is leaf k."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, leaf: int):
        self.directions, self.thresholds, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(sample, rng, leaf)
        dim = sample.shape[1]
        self.directions = np.array(self.directions).reshape(-1, dim)
        self.thresholds = np.array(self.thresholds)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            length = np.linalg.norm(a - b)
            if not length:
                continue
            direction = (a - b) / length
            along = rows @ direction
            middle = float(np.median(along))
            left = along < middle
            if left.any() and not left.all():
                node = len(self.children)
                self.directions.append(direction)
                self.thresholds.append(middle)
                self.children.append(None)
                self.children[node] = (self._grow(rows[left], rng, leaf), self._grow(rows[~left], rng, leaf))
                return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        at = np.full(len(rows), self.root)
        children = np.array(self.children).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = row_dots(rows[inner], self.directions[node]) >= self.thresholds[node]
            at[inner] = children[node, right.astype(int)]
        return -1 - at

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.directions.T - self.thresholds if len(self.thresholds) else np.empty((len(rows), 0))


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list[Tree]:
    return [Tree(sample, np.random.default_rng([seed, k]), leaf) for k in range(trees)]


def search(forest: list[Tree], margins: list[np.ndarray], leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order in which one queue over all trees reaches them."""
    queue = [(-np.inf, k, t.root) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        key, tree, node = heapq.heappop(queue)
        while node >= 0:
            margin = margins[tree][node]
            near, far = forest[tree].children[node][::-1] if margin >= 0 else forest[tree].children[node]
            heapq.heappush(queue, (max(key, abs(margin)), tree, far))
            node = near
        found.append((tree, -1 - node))
    return found


def _key(tree: int, leaf: int) -> int:
    return tree << 32 | leaf


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, leaves: int = LEAVES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``table`` found nearest, its own id left out."""
    spark = table.sparkSession
    kind = stored_kind(table, vector)

    def vectors(df: DataFrame) -> DataFrame:
        return usable(df, vector).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))

    rows, asked = vectors(table), vectors(queries).dropDuplicates(["id"])
    first = about(rows, sample, "id").orderBy("id").select("v").toArrow().column(0).combine_chunks()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(first):
        return spark.createDataFrame([], result)
    forest = spark.sparkContext.broadcast(grow(matrix(first), trees, leaf))
    schema = "leaf bigint, id bigint, v binary"

    def place(batches):
        for batch in batches:
            data, ids = matrix(batch.column(1)), batch.column(0)
            for number, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(tree.place(data) + _key(number, 0), pa.int64()), ids, packed(data, kind)], ["leaf", "id", "v"])

    def visit(batches):
        for batch in batches:
            data, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for at in range(0, len(ids), 256):
                part = data[at:at + 256]
                margins = [t.margins(part) for t in forest.value]
                goes = [(q, _key(*x)) for q in range(len(part)) for x in search(forest.value, [m[q] for m in margins], leaves)]
                who = np.array([g[0] for g in goes])
                yield pa.RecordBatch.from_arrays([pa.array([g[1] for g in goes], pa.int64()), pa.array(ids[at:at + 256][who]), packed(part[who], kind)], ["leaf", "id", "v"])

    members = rows.mapInArrow(place, schema)
    blocks = cut(members.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("n")))
    own = members.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
    come = asked.mapInArrow(visit, schema).join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v")
    best = _compare(own.unionByName(come), k, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compare(rows: DataFrame, k: int, kind: str) -> DataFrame:
    def run(batches):
        ids = members = None
        for begins, part in runs(batches, ["leaf", "block"]):
            if begins:
                ids, members, open_ = [], [], True
            role, who = part.column(2).to_numpy(), part.column(3).to_numpy()
            data = unpacked(part.column(4), kind)
            if (role == 0).any():
                ids.append(who[role == 0])
                members.append(data[role == 0])
                open_ = True
            if not (role == 1).any() or not ids:
                continue
            if open_:
                ids, members, open_ = [np.concatenate(ids)], [np.concatenate(members)], False
            got = [_top(q, v, ids[0], members[0], k) for q, v in _each(who[role == 1], data[role == 1], members[0])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["query_id", "vec_id", "score"])

    sorted_ = rows.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "role")
    return sorted_.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _each(who: np.ndarray, data: np.ndarray, members: np.ndarray):
    scores = data @ members.T
    for q in range(len(who)):
        yield who[q], (data[q], scores[q])


def _top(query: int, found: tuple[np.ndarray, np.ndarray], ids: np.ndarray, members: np.ndarray, k: int):
    vector, rough = found
    rough = np.where(ids == query, -np.inf, rough)
    if len(ids) > k:
        least = np.partition(rough, -k)[-k]
        at = np.flatnonzero((rough >= least - _SLACK * max(1.0, abs(least))) & (ids != query)) if np.isfinite(least) else np.flatnonzero(ids != query)
    else:
        at = np.flatnonzero(ids != query)
    exact = row_dots(members[at], vector[None, :])
    order = np.lexsort((ids[at], -exact))[:k]
    return np.full(len(order), query, np.int64), ids[at][order], exact[order]
