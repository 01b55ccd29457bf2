"""k nearest neighbours: all of them (``knn_exact``), or by several tables of random-hyperplane buckets (``knn``).

``knn_exact`` compares every row with every base row, block by block of at most ``BLOCK`` rows; the work is quadratic, but
one pair of blocks is all that a task holds.

A bucket table puts all rows in the order of a code (which side of each of ``BITS`` hyperplanes through the mean a row lies on,
first plane first), then of one more projection, then of the id, and cuts that order into buckets of equal size, at most
``bucket`` rows. Rows that share a bucket in any table are compared. So a dense region is cut further by the later planes
and an empty one is joined with its neighbours: every bucket is full, whatever the data, and the work is rows x tables x
bucket at every size. Hyperplanes come from a formula in the table, plane and dimension numbers that SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.scan import row_numbers
from loomwright.plans.store import cut

TABLES, BITS, BUCKET = 8, 24, 256
#: Fixed values of the formula for the planes' coefficients: factors and modulus.
CUBE, SQUARE, LINE, MODULUS = 31, 17, 7919, 1_000_003
#: Rows of a block that is compared as a whole, query rows and distances worked off at a time.
BLOCK, AT_ONCE, PAIRS = 16384, 256, 1 << 17
#: Digits of the last projection, so that equal rows tie in every engine.
DIGITS = 6


def planes(tables: int, dims: int, bits: int = BITS) -> np.ndarray:
    """(table, plane, dimension) coefficients in [-0.5, 0.5); the last plane of a table orders rows of one code."""
    x = np.arange(1, tables * (bits + 1) * dims + 1, dtype=np.int64)
    return ((x * x * x * CUBE + x * x * SQUARE + x * LINE) % MODULUS / MODULUS - 0.5).reshape(tables, bits + 1, dims)


def _mean(points: DataFrame, vec: str) -> np.ndarray:
    cells = points.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    return np.array([r["m"] for r in sorted(cells, key=lambda r: r["i"])])


def bucketed(points: DataFrame, id_col: str, vec: str, tables: int = TABLES, bucket: int = BUCKET, bits: int = BITS) -> DataFrame:
    """(id, v, base, tab, bucket) for every row and table; ``points`` has a flag ``base``."""
    n = points.count()
    centre = _mean(points, vec)
    coefficients = planes(tables, len(centre), bits)
    worth = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]]) - centre
            side = np.einsum("nd,tpd->ntp", x, coefficients)
            codes = (side[:, :, :bits] >= 0) @ worth
            for t in range(tables):
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "base": pdf["base"], "tab": np.int32(t), "code": codes[:, t], "along": np.round(side[:, t, bits], DIGITS) + 0.0})

    source = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col("base").cast("boolean").alias("base"))
    coded = cut(source.mapInPandas(run, "id long, v array<double>, base boolean, tab int, code long, along double"))
    placed = row_numbers(coded.select("id", "tab", "code", "along"), ["tab"], [F.col("code"), F.col("along"), F.col("id")], "at")
    many = max(1, -(-n // bucket))
    places = placed.select("id", "tab", F.floor((F.col("at") - 1) * many / n).alias("bucket"))
    return coded.select("id", "v", "base", "tab").join(places, ["id", "tab"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain differences: no cancellation; both sides are a bucket at most."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt((d * d).sum(axis=2))
    return out


def knn(points: DataFrame, k: int, id_col: str, vec: str, tables: int = TABLES, bucket: int = BUCKET, bits: int = BITS) -> DataFrame:
    """(qid, bid, dist, rk): the k nearest base rows found of every row, itself left out, ties by id; ids are unique."""

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, base = group["id"].to_numpy(), group["base"].to_numpy(dtype=bool)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in group["v"]])
        d = _distances(x, x[base])
        d[ids[:, None] == ids[base][None, :]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"qid": np.repeat(ids, top.shape[1]), "bid": ids[base][top].ravel(), "dist": np.take_along_axis(d, top, axis=1).ravel()})
        return out[np.isfinite(out["dist"])]

    each = bucketed(points, id_col, vec, tables, bucket, bits)
    found = each.groupBy("tab", "bucket").applyInPandas(nearest, "qid long, bid long, dist double").dropDuplicates(["qid", "bid"])
    rank = Window.partitionBy("qid").orderBy("dist", "bid")  # a row has at most tables x k candidates here
    return found.withColumn("rk", F.row_number().over(rank)).filter(F.col("rk") <= k)


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in the order of the ids."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(len(ids), -1)
    return ids[order], x[order]


def _nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of ``right`` for each of ``left``.

    One matrix product leaves out what can't be among them, by more than its rounding; the rest is measured by plain
    differences.
    """
    found = []
    if left.num_rows and right.num_rows:
        (ids, x), (others, y) = _dense(left), _dense(right)
        centre = y.mean(axis=0)
        a, b = x - centre, y - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (aa + bb.max())
        for i in range(0, len(ids), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            d = aa[some, None] + bb - 2 * (a[some] @ b.T)
            d[ids[some, None] == others] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
            row, col = np.nonzero((d <= (limit + slack[some])[:, None]) & np.isfinite(d))
            dist = np.empty(len(row))
            for j in range(0, len(row), PAIRS):
                part = slice(j, j + PAIRS)
                dist[part] = np.sqrt(((x[i + row[part]] - y[col[part]]) ** 2).sum(axis=1))
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            begin = np.searchsorted(row, np.arange(len(d)))
            top = np.arange(len(row)) - begin[row] < k
            found.append((ids[i + row[top]], others[col[top]], dist[top]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({n: pa.array(c) for n, c in zip(("qid", "bid", "dist"), columns)})


def knn_exact(points: DataFrame, k: int, id_col: str, vec: str, block: int | None = None) -> DataFrame:
    """(qid, bid, dist, rk): the k nearest base rows of every row, itself left out, ties by id; ids are unique."""
    n = points.count()
    many = max(1, -(-n // (block or BLOCK)), min(4, n // 1024))
    rows = cut(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col("base").cast("boolean").alias("base"),
                             F.pmod(F.xxhash64(id_col), F.lit(many)).cast("int").alias("own")))
    every = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    queries = rows.select("id", "v", F.col("own").alias("left"), every.alias("right"))
    bases = rows.filter("base").select("id", "v", F.col("own").alias("right"), every.alias("left"))
    pairs = queries.groupBy("left", "right").cogroup(bases.groupBy("left", "right"))
    found = pairs.applyInArrow(lambda a, b: _nearest(a, b, k), "qid long, bid long, dist double")
    rank = Window.partitionBy("qid").orderBy("dist", "bid")  # a row has at most blocks x k candidates here
    return found.withColumn("rk", F.row_number().over(rank)).filter(F.col("rk") <= k)
