"""Leak-safe target encoding.

Everything works on the long form (row, combo, key) of ``scalar.combo_keys``: one shuffle builds the
bucket tables of all key combinations, and out-of-fold statistics are the key total minus the fold's
own part, so nothing is refitted per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.expr import right_closed_bin, row_count
from loomwright.plans.quantile import column_quantiles

BUCKET = ["combo", "key"]


def class_counts(df: DataFrame, y: str, n_classes: int) -> list[int]:
    row = df.agg(*[F.count_if(F.col(y) == c).alias(f"c{c}") for c in range(n_classes)]).first()
    return [row[f"c{c}"] for c in range(n_classes)]


def prior_of(df: DataFrame, y: str, n_classes: int) -> list[float]:
    counts = class_counts(df, y, n_classes)
    total = sum(counts)
    return [c / total for c in counts]


def bucket_table(long: DataFrame, y: str, n_classes: int, by: Sequence[str] = BUCKET) -> DataFrame:
    """Bucket size and class counts per key."""
    return long.groupBy(*by).agg(
        row_count().alias("n"), *[F.count_if(F.col(y) == c).alias(f"s{c}") for c in range(n_classes)])


def smooth(s: Column, n: Column, m: float, prior: float) -> Column:
    """(s + m * prior) / (n + m); a missing or empty unsmoothed bucket gets the prior."""
    return F.coalesce(F.try_divide(s.cast("double") + F.lit(m * prior), n.cast("double") + F.lit(float(m))), F.lit(float(prior)))


def smooth_mean(train: DataFrame, df: DataFrame, groupings: Sequence[tuple[str, ...]], y: str, m: float) -> DataFrame:
    """One smoothed mean column per grouping, fitted on ``train``, unseen keys at the prior."""
    prior = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
    out = df
    for g in groupings:
        name = "te_" + "_".join(g)
        stats = train.groupBy(*[F.col(c).alias(f"__k_{c}") for c in g]).agg(
            F.sum(F.col(y).cast("double")).alias("__s"), row_count().alias("__n"))
        cond = None
        for c in g:
            e = out[c] == stats[f"__k_{c}"]
            cond = e if cond is None else cond & e
        out = out.join(stats, cond, "left").withColumn(name, smooth(F.col("__s"), F.col("__n"), m, prior)).drop(
            "__s", "__n", *[f"__k_{c}" for c in g])
    return out


def lookup(long: DataFrame, table: DataFrame, m: float, prior: Sequence[float], n_classes: int) -> DataFrame:
    """Full-train mapping: every class score of the row's bucket, prior vector where unseen."""
    j = long.join(table, BUCKET, "left")
    return j.select(*long.columns, *[smooth(F.col(f"s{c}"), F.col("n"), m, prior[c]).alias(f"te{c}") for c in range(n_classes)])


def leave_one_out(long: DataFrame, y: str, m: float, prior: Sequence[float], n_classes: int) -> DataFrame:
    """Train rows: the bucket without the row itself; a lone row of an unsmoothed bucket gets the prior."""
    j = long.join(bucket_table(long, y, n_classes), BUCKET)
    return j.select(*long.columns, *[
        smooth(F.col(f"s{c}") - (F.col(y) == c).cast("int"), F.col("n") - 1, m, prior[c]).alias(f"te{c}")
        for c in range(n_classes)])


def loo_and_lookup(long: DataFrame, y: str, m: float, n_classes: int, train: Column) -> DataFrame:
    """All combinations and classes in one pass: leave-one-out on train rows, lookup on the others."""
    tr = long.filter(train)
    table = bucket_table(tr, y, n_classes)
    one = F.coalesce(train, F.lit(False)).cast("int")
    # the prior is read off the rows of one combination
    first = tr.select("combo").first()["combo"]
    prior = prior_of(tr.filter(F.col("combo") == first), y, n_classes)
    j = long.join(table, BUCKET, "left")
    return j.select(*long.columns, *[
        smooth(F.col(f"s{c}") - one * (F.col(y) == c).cast("int"), F.col("n") - one, m, prior[c]).alias(f"te{c}")
        for c in range(n_classes)])


def kfold_oof(long: DataFrame, y: str, fold: str, m: float, prior: Sequence[float], n_classes: int) -> DataFrame:
    """Out-of-fold on rows with a fold, the full map on rows without (fold NULL)."""
    fitted = long.filter(F.col(fold).isNotNull())
    own = bucket_table(fitted, y, n_classes, [*BUCKET, fold])
    names = ["n", *[f"s{c}" for c in range(n_classes)]]
    total = own.groupBy(*BUCKET).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    j = long.join(total, BUCKET, "left").join(own, [*BUCKET, fold], "left")

    def rest(c: str) -> Column:
        return F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))

    return j.select(*long.columns, *[smooth(rest(f"s{c}"), rest("n"), m, prior[c]).alias(f"te{c}") for c in range(n_classes)])


def auto_smooth_oof(long: DataFrame, y: str, fold: str) -> DataFrame:
    """Cross-fitted encoding with empirical-Bayes weights.

    weight = n * tau2 / (n * tau2 + var_key), where tau2 is the target variance of the fitting side.
    """
    v = F.col(y).cast("double")
    moments = [row_count().alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")]
    own = long.groupBy(*BUCKET, fold).agg(*moments)
    names = ("n", "s", "q")
    total = own.groupBy(*BUCKET).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    # overall moments by combo and fold: a handful of rows
    by_fold = own.groupBy("combo", fold).agg(*[F.sum(c).alias(f"f_{c}") for c in names])
    overall = by_fold.groupBy("combo").agg(*[F.sum(f"f_{c}").alias(f"a_{c}") for c in names])
    side = by_fold.join(overall, "combo").select(
        "combo", fold, *[(F.col(f"a_{c}") - F.col(f"f_{c}")).alias(f"o_{c}") for c in names])
    enc = own.join(total, BUCKET).join(side, ["combo", fold])
    n, s, q = (F.col(f"t_{c}") - F.col(c) for c in names)
    grand = F.try_divide(F.col("o_s"), F.col("o_n"))
    tau2 = F.try_divide(F.col("o_q"), F.col("o_n")) - grand * grand
    mean = F.try_divide(s, n.cast("double"))
    var = F.try_divide(q, n.cast("double")) - mean * mean
    w = F.try_divide(n * tau2, n * tau2 + var)
    fitted = enc.select(*BUCKET, fold, F.coalesce(w * mean + (1 - w) * grand, grand).alias("te"))
    return long.join(fitted, [*BUCKET, fold], "left")


def quantile_bins(train: DataFrame, df: DataFrame, columns: Sequence[str], q: int, suffix: str = "_bin") -> DataFrame:
    """Right-closed equal-frequency bins with exact train edges; repeated edges merge."""
    edges = column_quantiles(train, columns, [i / q for i in range(1, q)])
    return df.withColumns({f"{c}{suffix}": right_closed_bin(c, sorted(set(edges[c]))) for c in columns})
