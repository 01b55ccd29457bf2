"""Ordered windows that stay bounded when one key holds most of the rows.

A plain window sorts a whole key in one task. Here a key with more rows than the group limit is cut into chunks of about
that many rows; every chunk is scanned on its own and the totals of the chunks before it are added back. Small keys keep
the ordinary single-shuffle window. The edges between a key's chunks are quantiles of a sample of that key's own rows,
taken of the whole order (all its columns, then a hash of the row), so that neither a narrow band of values nor ties make
a chunk larger. Only rows that are equal in every column can't be parted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.expr import place_in
from loomwright.plans.store import cut
from loomwright.session import group_row_limit

_EDGES = "__edges"
_CHUNK = "__chunk"
_CUT = "__cut"
_LOOK = object()  # "find the hot keys yourself"
#: Sampled rows for each chunk: its size is then within a quarter of the limit, as a rule.
SAMPLES = 64


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """(keys, __n): keys above the row limit as a written table of at most rows/limit rows, or None when there are none."""
    limit = limit or group_row_limit(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    hot = cut(counts)
    return None if hot.isEmpty() else hot


def _place(df: DataFrame, by: Sequence[Column]) -> Column:
    """The order of a row as one comparable value; ties go by a hash of the row."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], F.xxhash64(*plain).alias("tie"))


def _matched(df: DataFrame, keys: Sequence[str], other: DataFrame, how: str) -> DataFrame:
    """NULL-safe join on the keys; without keys ``other`` has one row, which is broadcast."""
    if not keys:
        one = F.broadcast(other.withColumn("__all", F.lit(0)))
        return df.withColumn("__all", F.lit(0)).join(one, "__all", how).drop("__all")
    tagged = other.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = None
    for k in keys:
        each = df[k].eqNullSafe(tagged[f"__h_{k}"])
        on = each if on is None else on & each
    return df.join(tagged, on, how).drop(*[f"__h_{k}" for k in keys])


def chunk_edges(df: DataFrame, keys: Sequence[str], by: Sequence[Column], limit: int | None = None) -> DataFrame | None:
    """(keys, __edges): where the chunks of each hot key begin, or None when no key is hot."""
    limit, keys = limit or group_row_limit(df.sparkSession), list(keys)
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return None
    placed = df.select(*keys, _place(df, by).alias("__at"))
    share = min(1.0, SAMPLES / limit)
    drawn = placed if share == 1.0 else placed.filter(F.pmod(F.xxhash64("__at"), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = _matched(drawn, keys, hot, "inner").groupBy(*keys).agg(F.sort_array(F.collect_list("__at")).alias("__s"), F.max("__n").alias("__n"))
    many = F.ceil(F.col("__n") / limit)
    picks = F.when((many > 1) & (F.size("__s") > 0), F.sequence(F.lit(1).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))
    edges = F.array_distinct(F.transform(picks, lambda i: F.get("__s", F.floor(i * F.size("__s") / many).cast("int"))))
    return cut(sample.select(*keys, edges.alias(_EDGES)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    by: Sequence[Column] | None = None,
    limit: int | None = None,
    hot=_LOOK,
    flag: str | None = None,
) -> DataFrame:
    """Add running sums/maxima (current row included) per key in the given total order.

    ``by`` are columns whose ascending order (NULL first) is ``order``; the order's own columns if those are plain.
    ``hot`` is a result of ``chunk_edges``; ``flag`` names a column that tells rows of hot keys.
    """
    sums, maxes, keys = sums or {}, maxes or {}, list(keys)
    by = list(by or order)
    hot = chunk_edges(df, keys, by, limit) if hot is _LOOK else hot
    frame = (Window.unboundedPreceding, Window.currentRow)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.select(
            "*",
            *[F.sum(c).over(w).alias(n) for n, c in sums.items()],
            *[F.max(c).over(w).alias(n) for n, c in maxes.items()],
            *([F.lit(False).alias(flag)] if flag else []),
        )
    placed = _matched(df.withColumn("__at", _place(df, by)), keys, hot, "left")
    chunk = F.when(F.col(_EDGES).isNotNull(), place_in(F.col("__at"), F.col(_EDGES))).otherwise(F.lit(0))
    marked = placed.withColumns({_CHUNK: chunk, _CUT: F.col(_EDGES).isNotNull()}).drop(_EDGES, "__at")
    part = [*keys, _CHUNK]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*frame)
    local = marked.select(
        "*",
        *[F.sum(c).over(w).alias(f"__l_{n}") for n, c in sums.items()],
        *[F.max(c).over(w).alias(f"__l_{n}") for n, c in maxes.items()],
    )
    totals = marked.groupBy(*part).agg(
        *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__t_{n}") for n, c in maxes.items()],
    )
    # a key has rows/limit chunks, so this window is as much smaller than the rows
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part,
        *[F.sum(f"__t_{n}").over(before).alias(f"__b_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__b_{n}") for n in maxes],
    )
    joined = _matched(local, part, carry, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__l_{n}") + F.coalesce(F.col(f"__b_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.greatest(F.col(f"__l_{n}"), F.col(f"__b_{n}")), F.col(f"__b_{n}")).alias(n) for n in maxes],
        *([F.col(_CUT).alias(flag)] if flag else []),
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, **kw) -> DataFrame:
    """Exact row_number per key, chunked for hot keys."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, **kw)


def lookback_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    depth: int,
    build: Callable[[Window], dict[str, Column]],
    by: Sequence[Column] | None = None,
    limit: int | None = None,
    hot=_LOOK,
) -> DataFrame:
    """Window columns that look at most ``depth`` rows back, per key.

    ``build(window)`` returns the columns over an ordered window. Hot keys are numbered once, cut into
    blocks of the group limit, and each block also gets the last ``depth`` rows of the block before it.
    """
    limit = limit or group_row_limit(df.sparkSession)
    keys = list(keys)
    hot = chunk_edges(df, keys, by or order, limit) if hot is _LOOK else hot
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[c.alias(n) for n, c in build(w).items()])
    size = max(limit, 2 * depth)
    pos = row_numbers(df, keys, order, "__pos", by=by, limit=limit, hot=hot, flag=_CUT)
    block = F.when(F.col(_CUT), F.floor((F.col("__pos") - 1) / size)).otherwise(F.lit(0)).cast("long")
    feeds_next = F.col(_CUT) & (((F.col("__pos") - 1) % size) >= size - depth)
    spread = (
        pos.withColumn("__own", block)
        .withColumn(
            "__block",
            F.explode(F.when(feeds_next, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))),
        )
    )
    w = Window.partitionBy(*keys, "__block").orderBy("__pos")
    out = spread.select("*", *[c.alias(n) for n, c in build(w).items()])
    return out.filter(F.col("__own") == F.col("__block")).drop("__own", "__block", "__pos", _CUT)
