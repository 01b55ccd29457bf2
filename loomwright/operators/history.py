"""Entity history: wide statistics, two-level rollups, and the outer-joined feature set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.expr import clip_low, flag, row_count, safe_div, sentinel_to_null
from loomwright.operators.joins import full_outer_chain
from loomwright.plans.quantile import group_quantiles
from loomwright.plans.scan import lookback_windows

ALL_STATS = ("mean", "min", "max", "sum")


def stat(column: str, kind: str) -> Column:
    """One statistic of a column; an all-missing sum is zero, an all-missing mean is NULL."""
    if kind == "mean":
        # shares its buffers with sum and count of the same column
        return F.try_divide(F.sum(column).cast("double"), F.count(column))
    if kind == "sum":
        return F.coalesce(F.sum(column), F.lit(0))
    return {"min": F.min, "max": F.max}[kind](column)


def stat_list(columns: Sequence[str], prefix: str, stats: Sequence[str] = ALL_STATS) -> list[Column]:
    return [stat(c, s).alias(f"{prefix}_{c}_{s}".upper()) for c in columns for s in stats]


def record_count(prefix: str) -> Column:
    return row_count().alias(f"{prefix}_RECORD_COUNT".upper())


@dataclass
class HistorySet:
    """Aggregates to take over one source frame."""

    source: DataFrame
    aggs: list[Column]


def aggregate_sets(sets: Sequence[HistorySet], key: str) -> list[DataFrame]:
    """One groupBy per distinct source frame, whatever the number of sets that read it."""
    merged: list[HistorySet] = []
    for s in sets:
        same = next((m for m in merged if m.source is s.source), None)
        if same is None:
            merged.append(HistorySet(s.source, list(s.aggs)))
        else:
            same.aggs.extend(s.aggs)
    return [m.source.groupBy(key).agg(*m.aggs) for m in merged]


LOAN_NUMERIC = ["days_credit", "overdue_days", "days_enddate", "credit", "debt"]


def loan_columns(loans: DataFrame) -> DataFrame:
    return loans.withColumns({
        "is_active": flag(F.col("status") == "Active"), "is_closed": flag(F.col("status") == "Closed"),
        "has_overdue": flag(F.col("overdue_days") > 0), "debt_credit_ratio": safe_div("debt", "credit"),
    })


def loan_set(loans: DataFrame) -> HistorySet:
    rates = ["is_active", "is_closed", "has_overdue", "debt_credit_ratio"]
    return HistorySet(loans, [*stat_list(LOAN_NUMERIC, "BUREAU"), record_count("BUREAU"), *stat_list(rates, "BUREAU", ("mean", "max"))])


def balance_rollup(balances: DataFrame, loans: DataFrame, loan_key: str, key: str) -> DataFrame:
    """Monthly balances to loan level, then to the entity."""
    by_loan = balances.groupBy(loan_key).agg(
        row_count().alias("bb_months_count"), F.min("months").alias("bb_months_min"),
        F.avg(flag(F.col("delinquent"))).alias("bb_delinquent_rate"), F.avg(flag(F.col("severe"))).alias("bb_severe_rate"),
    )
    up = by_loan.join(loans.select(loan_key, key), loan_key, "inner")
    return up.groupBy(key).agg(
        *stat_list(["bb_months_count"], "BUREAU", ("mean", "max", "sum")), *stat_list(["bb_months_min"], "BUREAU", ("min",)),
        *stat_list(["bb_delinquent_rate", "bb_severe_rate"], "BUREAU", ("mean", "max")),
    )


PREVIOUS_NUMERIC = ["application", "credit", "days_decision", "days_first_due", "credit_application_ratio"]


def previous_columns(prev: DataFrame, sentinel: int) -> DataFrame:
    clean = prev.withColumn("days_first_due", sentinel_to_null("days_first_due", sentinel))
    return clean.withColumns({
        "approved": flag(F.col("status") == "Approved"), "refused": flag(F.col("status") == "Refused"),
        "credit_application_ratio": safe_div("credit", "application"),
    })


def previous_set(prev: DataFrame) -> HistorySet:
    return HistorySet(prev, [*stat_list(PREVIOUS_NUMERIC, "PREV"), record_count("PREV"),
                             *stat_list(["approved", "refused"], "PREV", ("mean", "sum"))])


def line_columns(lines: DataFrame) -> DataFrame:
    """Row-level columns of the instalment, card and payment sets over one line source."""
    late = clip_low(F.col("days_paid") - F.col("days_due"), 0)
    short = clip_low(F.col("due") - F.col("paid"), 0)
    rows = lines.withColumns({
        "is_delinquent": flag(F.col("dpd") > 0), "is_active": flag(F.col("line_status") == "Active"),
        "balance_limit_ratio": safe_div("balance", "credit_limit"), "payment_min_ratio": safe_div("paid", "min_due"),
        "days_late": late, "shortfall": short, "payment_ratio": safe_div("paid", "due"),
    })
    return rows.withColumns({"is_late": flag(F.col("days_late") > 0), "is_short": flag(F.col("shortfall") > 0)})


POS_NUMERIC = ["months", "instalments", "dpd", "is_delinquent", "is_active"]
CARD_NUMERIC = ["months", "balance", "credit_limit", "paid", "dpd", "balance_limit_ratio", "payment_min_ratio", "is_delinquent"]
INSTALMENT_NUMERIC = ["number", "days_due", "days_paid", "due", "paid", "days_late", "shortfall", "payment_ratio", "is_late", "is_short"]


def pos_set(lines: DataFrame) -> HistorySet:
    return HistorySet(lines, [*stat_list(POS_NUMERIC, "POS", ("mean", "min", "max")), record_count("POS")])


def card_set(lines: DataFrame) -> HistorySet:
    return HistorySet(lines, [*stat_list(CARD_NUMERIC, "CC"), record_count("CC")])


def instalment_set(lines: DataFrame) -> HistorySet:
    return HistorySet(lines, [*stat_list(INSTALMENT_NUMERIC, "INSTAL"), record_count("INSTAL")])


def history_features(loans: DataFrame, balances: DataFrame, previous: DataFrame, lines: DataFrame, key: str, loan_key: str) -> DataFrame:
    """All five sets, outer-joined to one row per entity."""
    sets = [loan_set(loans), previous_set(previous), pos_set(lines), card_set(lines), instalment_set(lines)]
    frames = aggregate_sets(sets, key)
    return full_outer_chain([*frames, balance_rollup(balances, loans, loan_key, key)], key)


# ---- other group statistics -------------------------------------------------------------------


def entity_rate(df: DataFrame, key: str, target: Column) -> DataFrame:
    return df.groupBy(key).agg(F.avg(target).alias("rate"), F.sum(target).alias("positives"), row_count().alias("n"))


def first_attribute(df: DataFrame, key: str, attr: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(attr, order).alias(attr))


def crosstab(df: DataFrame, key: str, column: str, classes: Sequence, normalise: bool = False) -> DataFrame:
    """Counts by key and known class, zero-filled, optionally as row shares."""
    counts = {str(c): F.count_if(F.col(column) == c) for c in classes}
    total = row_count()
    return df.groupBy(key).agg(*[
        (F.try_divide(n.cast("double"), total) if normalise else n).alias(c) for c, n in counts.items()])


def distinct_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().agg(row_count().alias("n_groups"))


def class_prior(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(row_count().alias("n"))
    # the window runs over one row per class
    return counts.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced, inverse-frequency and positive weights per class (one row per class)."""
    counts = df.groupBy(label).agg(row_count().alias("n"))
    every = Window.partitionBy()  # one row per class
    j = counts.select(label, "n", F.sum("n").over(every).alias("total"), row_count().over(every).alias("k"))
    return j.select(
        label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("balanced"),
        (F.lit(1.0) / F.col("n")).alias("inverse"), F.try_divide((F.col("total") - F.col("n")).cast("double"), F.col("n")).alias("neg_over_pos"),
    )


def cooccurrence(df: DataFrame, row_key: str, label: str, block: int = 64) -> DataFrame:
    """How many rows carry both labels: (label_a, label_b, n), each pair once, over any vocabulary.

    Equal label sets are added up first. A set is cut into blocks of labels, and pairs come from pairs of its blocks, so
    that a row with very many labels is worked off in pieces. Labels stand in order, NULL labels count for nothing.
    """
    sets = df.filter(F.col(label).isNotNull()).groupBy(row_key).agg(F.array_sort(F.collect_set(label)).alias("s"))
    same = sets.filter(F.size("s") > 1).groupBy("s").agg(row_count().alias("n"))
    starts = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / block).cast("int"))
    lefts = same.select("s", "n", F.explode(starts).alias("i"))
    both = lefts.select("n", F.slice("s", F.col("i") * block + 1, block).alias("a"), "i",
                        F.explode(F.transform(F.sequence(F.col("i"), F.floor((F.size("s") - 1) / block).cast("int")), lambda j: F.struct(j.alias("j"), F.slice("s", j * block + 1, block).alias("b")))).alias("o"))
    one = both.select("n", F.explode("a").alias("label_a"), F.col("o.b").alias("b"))
    pairs = one.select("n", "label_a", F.explode("b").alias("label_b")).filter("label_a < label_b")
    return pairs.groupBy("label_a", "label_b").agg(F.sum("n").alias("n"))


def label_cardinality(df: DataFrame, row_key: str, label: str) -> DataFrame:
    """Distribution of the number of labels per row."""
    per_row = df.select(row_key, label).distinct().groupBy(row_key).agg(F.count(label).alias("n_labels"))
    return per_row.groupBy("n_labels").agg(row_count().alias("n_rows"))


def frame_cells(df: DataFrame, entity: str, frames: int, coefs: int) -> DataFrame:
    """A flat vector of frames x coefficients as (entity, frame, coef, x)."""
    cells = df.select(entity, F.posexplode("embedding").alias("i", "x"))
    return cells.select(entity, F.floor(F.col("i") / coefs).cast("int").alias("frame"),
                        (F.col("i") % coefs).cast("int").alias("coef"), F.col("x").cast("double").alias("x"))


def frame_moments(cells: DataFrame, entity: str) -> DataFrame:
    base = cells.groupBy(entity, "coef").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.log1p(row_count().cast("double")).alias("log_n"))
    med = group_quantiles(cells, [entity, "coef"], "x", {"median": 0.5})
    return base.join(med, [entity, "coef"])


def frame_percentiles(cells: DataFrame, entity: str) -> DataFrame:
    return group_quantiles(cells, [entity, "coef"], "x", {"p10": 0.1, "p90": 0.9})


def frame_deltas(cells: DataFrame, entity: str) -> DataFrame:
    """Mean and spread of frame-to-frame differences per coefficient."""
    stepped = lookback_windows(
        cells, [entity, "coef"], [F.col("frame")], 1, lambda w: {"prev": F.lag("x").over(w)})
    return stepped.groupBy(entity, "coef").agg(
        F.avg(F.col("x") - F.col("prev")).alias("delta_mean"), F.stddev_pop(F.col("x") - F.col("prev")).alias("delta_std"))


def frame_count(cells: DataFrame, entity: str) -> DataFrame:
    return cells.groupBy(entity).agg(F.count_distinct("frame").alias("n_frames"))
