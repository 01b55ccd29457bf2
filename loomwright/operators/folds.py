"""Deterministic fold tables: md5 order of the row id and a seed, exact sizes, no driver loops over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import hash_key, literal_map, row_count
from loomwright.plans.scan import row_numbers
from loomwright.plans.store import cut, load_or_build


def _fold(n: Column, k: int) -> Column:
    return ((n - 1) % k).cast("int")


def _numbered(df: DataFrame, keys: Sequence[str], id_col: str, seed, name: str = "__n") -> DataFrame:
    keyed = df.withColumn("__h", hash_key(id_col, seed=seed))
    return row_numbers(keyed, keys, [F.col("__h"), F.col(id_col)], name).drop("__h")


def stratified(df: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    n = _numbered(df.select(id_col, label), [label], id_col, seed)
    return n.select(id_col, label, _fold(F.col("__n"), k).alias("fold"))


def plain(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    n = _numbered(df.select(id_col), [], id_col, seed)
    return n.select(id_col, _fold(F.col("__n"), k).alias("fold"))


def repeat_seeds(df: DataFrame, id_col: str, label: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """A stratified fold table per seed."""
    rows = df.select(id_col, label, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    keyed = rows.withColumn("__h", F.md5(F.concat(F.col(id_col).cast("string"), F.col("seed").cast("string"))))
    n = row_numbers(keyed, ["seed", label], [F.col("__h"), F.col(id_col)], "__n")
    return n.select(id_col, "seed", _fold(F.col("__n"), k).alias("fold"))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups per fold: (group, n, fold); rows without a group are one group.

    Groups are numbered from the largest (ties by key) and dealt to the folds in turn, forth and back: a round puts one
    group into each fold, and the next round starts with the fold that got the smallest one. So two folds never differ by
    more than the largest group.
    """
    sizes = cut(df.groupBy(group).agg(row_count().alias("n")))
    ranked = row_numbers(sizes, [], [F.desc("n"), F.col(group)], "__n", by=[-F.col("n"), F.col(group)])
    turn, place = F.floor((F.col("__n") - 1) / k), (F.col("__n") - 1) % k
    return ranked.select(group, "n", F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))


def lightest_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups per fold: (group, n, fold); each group, from the largest (ties by key, no key last), goes to the fold that
    is lightest when its turn comes, the first of equals. Rows without a group are one group.

    Only the number of groups of each size passes the driver. Groups of one size fill the lower folds level by level, so
    their folds repeat with a period that changes at most ``k`` times; a group's fold follows from its place in its size.
    """
    sizes = cut(df.groupBy(group).agg(row_count().alias("n")))
    loads, runs = [0] * k, []
    for size, many in sizes.groupBy("n").agg(row_count().alias("m")).orderBy(F.desc("n")).collect():
        low, at = min(loads), 0
        level = [(load - low) // size for load in loads]
        rest = [(load - low) % size for load in loads]
        steps = sorted(set(level))
        for this, after in zip(steps, [*steps[1:], None]):
            turn = sorted((f for f in range(k) if level[f] <= this), key=lambda f: (rest[f], f))
            take = many - at if after is None else min(many - at, (after - this) * len(turn))
            if take:
                runs.append((size, at, at + take, turn))
            for place, f in enumerate(turn):
                loads[f] += size * (take // len(turn) + (place < take % len(turn)))
            at += take
    # at most k rows for each distinct size
    table = F.broadcast(df.sparkSession.createDataFrame(runs, "__size long, __from long, __to long, __turn array<int>"))
    placed = row_numbers(sizes, ["n"], [F.col(group).isNull(), F.col(group)], "__n").withColumn("__n", F.col("__n") - 1)
    inside = (F.col("n") == F.col("__size")) & (F.col("__n") >= F.col("__from")) & (F.col("__n") < F.col("__to"))
    turn = ((F.col("__n") - F.col("__from")) % F.size("__turn")).cast("int")
    return placed.join(table, inside).select(group, "n", F.get("__turn", turn).alias("fold"))


def multilabel(labels: DataFrame, ids: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    """Every row is dealt out within its rarest label; rows without labels form their own stratum."""
    freq = labels.select(id_col, label).distinct().groupBy(label).agg(row_count().alias("__f"))
    rare = labels.join(freq, label).groupBy(id_col).agg(F.min_by(label, F.struct("__f", label)).alias("stratum"))
    n = _numbered(ids.select(id_col).join(rare, id_col, "left"), ["stratum"], id_col, seed)
    return n.select(id_col, "stratum", _fold(F.col("__n"), k).alias("fold"))


def holdout(df: DataFrame, id_col: str, label: str, share: float, seed: int, path: str | None = None) -> DataFrame:
    """Stratified fixed holdout; with a path it is built once and read back afterwards."""

    def build() -> DataFrame:
        counts = df.groupBy(label).agg(F.round(row_count() * share).alias("__q"))
        n = _numbered(df.select(id_col, label), [label], id_col, seed).join(F.broadcast(counts), label)
        return n.select(id_col, label, F.when(F.col("__n") <= F.col("__q"), "test").otherwise("train").alias("split"))

    return load_or_build(df.sparkSession, path, build) if path else build()


def quotas(counts: dict, n: int) -> dict:
    """Proportional class quotas summing to n, leftovers to the largest remainders."""
    total = sum(counts.values())
    exact = {c: n * v / total for c, v in counts.items()}
    base = {c: int(e) for c, e in exact.items()}
    extra = n - sum(base.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - base[c]), c))[:extra]:
        base[c] += 1
    return base


def fixed_size(df: DataFrame, id_col: str, label: str, n: int, seed: int) -> DataFrame:
    """Stratified subset of exactly n rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(row_count().alias("n")).collect()}
    quota = literal_map(quotas(counts, n))
    numbered = _numbered(df.select(id_col, label), [label], id_col, seed)
    return numbered.filter(F.col("__n") <= F.try_element_at(quota, F.col(label))).drop("__n")


def partition_check(folds: DataFrame, rows: DataFrame, id_col: str, k: int) -> DataFrame:
    """Each row is validated exactly once."""
    per = folds.groupBy(id_col).agg(row_count().alias("times"), F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    j = rows.select(id_col).join(per, id_col, "full")
    return j.agg(
        row_count().alias("n_rows"), F.count_if(F.coalesce(F.col("times"), F.lit(0)) != 1).alias("n_not_once"),
        F.count_if((F.col("lo") < 0) | (F.col("hi") >= k)).alias("n_bad_fold"))


def balance_report(folds: DataFrame, label: str) -> DataFrame:
    """Label share per fold and its largest deviation from the overall share."""
    cell = folds.groupBy("fold", label).agg(row_count().alias("n"))
    by_fold = cell.groupBy("fold").agg(F.sum("n").alias("fold_n"))
    by_label = cell.groupBy(label).agg(F.sum("n").alias("label_n"))
    total = cell.agg(F.sum("n")).first()[0]
    j = cell.join(by_fold, "fold").join(by_label, label)
    dev = F.col("n") / F.col("fold_n") - F.col("label_n") / F.lit(total)
    return j.select("fold", label, "n", (F.col("n") / F.col("fold_n")).alias("share"), F.abs(dev).alias("deviation"))
