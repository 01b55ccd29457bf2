"""Ordered windows, quantiles and folds: plain and chunked forms give the same rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import folds as FO
from loomwright.operators import windows as W
from loomwright.plans.quantile import column_quantiles, group_quantiles
from loomwright.functions.expr import place_in
from loomwright.plans.scan import _place, chunk_edges, lookback_windows, row_numbers, running


def skewed(spark, n=400):
    rng = random.Random(3)
    # one key holds most rows
    return spark.createDataFrame(
        [(i, 0 if rng.random() < 0.7 else rng.randint(1, 9), rng.random() * 100, rng.randint(0, 5)) for i in range(n)],
        "id long, k int, t double, v int")


def test_running_matches_plain_window(spark, small_groups):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    got = running(df, ["k"], [F.col("t")], sums={"s": F.col("v")}, maxes={"m": F.col("v")}).select("id", "s", "m")
    assert got.exceptAll(want).count() == 0 and got.count() == 400


def test_running_descending(spark, small_groups):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"))
    got = running(df, ["k"], [F.desc("t")], sums={"s": F.col("v")}, by=[-F.col("t")]).select("id", "s")
    assert got.exceptAll(want).count() == 0 and got.count() == 400


def test_lookback_blocks(spark, small_groups):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("id", F.lag("v", 3).over(w).alias("l"), F.sum("v").over(w.rowsBetween(-5, -1)).alias("s"))
    got = lookback_windows(df, ["k"], [F.col("t")], 5, lambda x: {"l": F.lag("v", 3).over(x), "s": F.sum("v").over(x.rowsBetween(-5, -1))})
    assert got.select("id", "l", "s").exceptAll(want).count() == 0 and got.count() == 400


def runs(spark, n_entities=1):
    rows = [(e, i, v) for e in range(n_entities) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 2.0, 3.0, None, None])]
    return spark.createDataFrame(rows, "e int, i int, v double").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 3600).cast("timestamp_ntz"))


def test_flatline_run(spark):
    got = [r["run"] for r in W.flatline_run(runs(spark), "e", "ts", F.col("v")).orderBy("i").collect()]
    assert got == [1, 2, 3, 1, 2, 1, 1, 2]


def test_flatline_run_chunked(spark, small_groups):
    out = W.flatline_run(runs(spark, 3), "e", "ts", F.col("v")).orderBy("e", "i").collect()
    assert [r["run"] for r in out] == [1, 2, 3, 1, 2, 1, 1, 2] * 3


def test_lag_stays_inside_entity(spark):
    out = W.lags(runs(spark, 2), "e", "ts", "v", [1]).filter("i = 0").collect()
    assert len(out) == 2 and all(r["lag_1"] is None for r in out)


def test_average_rank_ties(spark, small_groups):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 5, 3, 3, 3])], "id int, v double")
    got = {r["id"]: r["rank"] for r in W.average_rank(df, [], "v").collect()}
    assert got == {1: 1.0, 3: 3.0, 4: 3.0, 5: 3.0, 0: 5.5, 2: 5.5}


def test_quantiles_plain_and_chunked(spark, small_groups):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 4, 7)], "x double")
    assert column_quantiles(df, ["x"], [0.25, 0.5]) == {"x": [2.25, 3.5]}
    assert column_quantiles(df, ["x"], [0.25, 0.5], limit=100) == {"x": [2.25, 3.5]}


def test_group_quantiles_keep_empty_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None)], "k int, x double")
    for limit in (1, 100):
        got = {r["k"]: r["m"] for r in group_quantiles(df, ["k"], "x", {"m": 0.5}, limit).collect()}
        assert got == {1: 3.0, 2: None}


def test_stratified_folds(spark):
    df = skewed(spark).withColumn("y", (F.col("k") == 0).cast("int"))
    f = FO.stratified(df, "id", "y", 5, 42)
    assert f.select("id").distinct().count() == 400
    spread = f.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in spread)
    again = FO.stratified(df, "id", "y", 5, 42)
    assert f.exceptAll(again).count() == 0


def test_group_folds_whole_and_balanced(spark):
    df = skewed(spark, 2000).withColumn("g", F.when(F.col("k") == 0, F.col("id") % 90 + 100).otherwise(F.col("k")).cast("long"))
    g = FO.group_folds(df, "g", 4)
    assert g.count() == df.select("g").distinct().count()
    sizes = [r["s"] for r in g.groupBy("fold").agg(F.sum("n").alias("s")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= g.agg(F.max("n")).first()[0]


def test_group_folds_one_giant(spark):
    df = spark.range(900).select(F.when(F.col("id") < 500, -1).otherwise(F.col("id")).alias("g"))
    sizes = sorted(r["s"] for r in FO.group_folds(df, "g", 4).groupBy("fold").agg(F.sum("n").alias("s")).collect())
    assert max(sizes[:-1]) - min(sizes[:-1]) <= 1 and sizes[-1] - sizes[0] <= 500


def test_group_folds_are_the_same_in_chunks(spark, small_groups):
    df = skewed(spark, 1500).withColumn("g", F.col("id") % 97)
    got = {r["g"]: r["fold"] for r in FO.group_folds(df, "g", 5).collect()}
    sizes = sorted(((-r["count"], r["g"]) for r in df.groupBy("g").count().collect()))
    assert got == {g: (k % 5 if k // 5 % 2 == 0 else 4 - k % 5) for k, (_, g) in enumerate(sizes)}


def test_lightest_folds_are_those_of_one_by_one_dealing(spark):
    """Sizes far apart, so that dealing in turn is not the lightest fold."""
    rows = [g for g in range(60) for _ in range(1 + (g * 37 % 23) ** 2 // 9 if g else 200)] + [None] * 7
    got = {r["g"]: r["fold"] for r in FO.lightest_folds(spark.createDataFrame([(g,) for g in rows], "g long"), "g", 5).collect()}
    loads, want = [0] * 5, {}
    for g in sorted(set(rows), key=lambda g: (-rows.count(g), g is None, g or 0)):
        want[g] = loads.index(min(loads))
        loads[want[g]] += rows.count(g)
    assert got == want


def test_quotas_sum():
    assert FO.quotas({"a": 5, "b": 3, "c": 2}, 7) == {"a": 4, "b": 2, "c": 1}


def test_group_folds_keep_rows_without_group(spark):
    df = spark.createDataFrame([(g,) for g in [1, 1, None, None, None, 2]], "g long")
    got = {r["g"]: (r["n"], r["fold"]) for r in FO.group_folds(df, "g", 3).collect()}
    assert got == {None: (3, 0), 1: (2, 1), 2: (1, 2)}


def test_chunks_of_a_narrow_band_and_of_ties(spark):
    """20,000 rows of one key in a narrow band, half of them with one and the same order value, beside a wide small key."""
    rows = [(i, 1, 5.0 if i % 2 else 5.0 + i * 1e-9) for i in range(20_000)] + [(i, 2, float(i) * 1e6) for i in range(20_000, 20_300)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "id long, k int, t double").repartition(5)
    limit = 500
    edges = chunk_edges(df, ["k"], [F.col("t")], limit)
    assert [r["k"] for r in edges.collect()] == [1]
    at = df.withColumn("at", _place(df, [F.col("t")]))
    sizes = at.join(edges, "k").groupBy(place_in(F.col("at"), F.col("__edges")).alias("c")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * limit and sizes.count() >= 35
    got = row_numbers(df, ["k"], [F.col("t")], "n", limit=limit)
    assert sorted(r["n"] for r in got.filter("k = 1").collect()) == list(range(1, 20_001))
    low = got.filter("k = 1").groupBy("t").agg(F.min("n").alias("a"), F.max("n").alias("b")).orderBy("t").collect()
    assert all(x["b"] + 1 == y["a"] for x, y in zip(low, low[1:]))
    assert got.filter("k is null").first()["n"] == 1


def test_lookback_with_ties_and_texts(spark):
    rows = [(i, 0, f"w{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, t string, v int")
    got = lookback_windows(df, ["k"], [F.col("t"), F.col("id")], 2, lambda w: {"l": F.lag("v", 2).over(w)}, limit=10)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert got.exceptAll(df.withColumn("l", F.lag("v", 2).over(w))).count() == 0 and got.count() == 300
