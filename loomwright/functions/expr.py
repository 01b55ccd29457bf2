"""Column expressions that keep dataframe-library missing-value semantics under ANSI SQL."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b as double; a zero or missing denominator gives NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip_low(x, low=0.0) -> Column:
    """Lower clip that keeps NULL (greatest() would return the bound)."""
    return F.when(col(x) < low, F.lit(low)).otherwise(col(x))


def clip(x, low, high) -> Column:
    x = col(x)
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean to 0/1 where an unknown comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sentinel_to_null(x, *values) -> Column:
    x = col(x)
    return F.when(~x.isin(*values), x)


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = col(x).cast("double")
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x != inf) & (x != -inf), x)


def row_sum(cols: Iterable) -> Column:
    """Row sum that skips missing cells; an all-missing row sums to zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(col(c).cast("double"), F.lit(0.0))
    return total


def hash_key(*ids, seed: int | str = "") -> Column:
    """Repeatable pseudo-random order: md5 hex of the ids and a seed."""
    parts = [col(i).cast("string") for i in ids]
    text = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.md5(F.concat(text, F.lit(str(seed))))


def hash_unit(hex_text) -> Column:
    """First eight hex digits mapped to [0, 1)."""
    return F.conv(F.substring(col(hex_text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket_index(x, edges: Sequence[float]) -> Column:
    """How many sorted edges are <= x, by binary search over a literal array (NULL gives 0)."""
    x, n = col(x), len(edges)
    if n == 0:
        return F.lit(0)
    table = F.array(*[F.lit(e) for e in edges])
    steps, bit = [], 1
    while bit <= n:
        steps.insert(0, bit)
        bit *= 2

    def step(lo, width):
        probe = lo + width
        return F.when((probe <= n) & (F.get(table, probe - 1) <= x), probe).otherwise(lo)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def place_in(x: Column, edges: Column) -> Column:
    """How many values of a sorted array column are <= x, by binary search (arrays of up to two to the 30)."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])

    def step(low, width):
        probe = low + width
        return F.when((probe <= F.size(edges)) & (F.get(edges, probe - 1) <= x), probe).otherwise(low)

    return F.aggregate(F.filter(steps, lambda s: s <= F.size(edges)), F.lit(0), step)


def right_closed_bin(x, edges: Sequence[float]) -> Column:
    """Interval number for right-closed bins: count of inner edges strictly below x (NULL stays)."""
    x = col(x)
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x > F.lit(float(e)), 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def map_value(x, mapping: dict, default=None) -> Column:
    """Lookup of a small fixed mapping, with a default for unseen or missing keys."""
    got = F.try_element_at(literal_map(mapping), col(x))
    return got if default is None else F.coalesce(got, F.lit(default))


def first_max_index(arr) -> Column:
    """Zero-based argmax, first index on ties."""
    arr = col(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def row_count() -> Column:
    return F.count(F.lit(1))


def array_literal(values) -> Column:
    """Nested lists of numbers as one array literal, parsed in a single call."""

    def text(v) -> str:
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(text(x) for x in v) + ")"
        return f"{float(v)!r}D"

    return F.expr(text(list(values)))
