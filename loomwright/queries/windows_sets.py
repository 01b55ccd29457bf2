"""Queries of the window, top-k and set sections."""

from pyspark.sql import functions as F

from loomwright.functions.expr import first_max_index, flag, row_count
from loomwright.operators import sets as X
from loomwright.operators import topk as K
from loomwright.operators import windows as W
from loomwright.queries.fixtures import CLASS_LONG, PRIORITIES, SCORES, class_probs, scores, split_col, split_sql
from loomwright.queries.history import cents, rounded
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
STEPS = [1, 24, 168]


def events(spark, d, *extra):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", *extra)


_LAG = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in STEPS)


@query("win_lag", f"SELECT event_id, {_LAG} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def win_lag(spark, d):
    return W.lags(events(spark, d), "user_id", "ts", "value", STEPS).select("event_id", *[f"lag_{k}" for k in STEPS])


@query("win_diff", "SELECT event_id, " + ", ".join(f"value - lag(value, {k}) OVER w AS diff_{k}, abs(value - lag(value, {k}) OVER w) AS absdiff_{k}" for k in STEPS)
       + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def win_diff(spark, d):
    out = W.add_diffs(W.lags(events(spark, d), "user_id", "ts", "value", STEPS), "value", STEPS)
    return out.select("event_id", *[f"{n}_{k}" for k in STEPS for n in ("diff", "absdiff")])


_ROLL = """(SELECT event_id, value, CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END AS roll_mean, CASE WHEN count(value) OVER w >= 4 THEN stddev_samp(value) OVER w END AS roll_std
  FROM (SELECT event_id, user_id, ts, round(value * 100)::BIGINT AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""


def _roll(spark, d):
    return W.rolling(events(spark, d).withColumn("value", cents("value")), "user_id", "ts", "value", 24, 4)


@query("win_roll_mean", f"SELECT event_id, roll_mean FROM {_ROLL}")
def win_roll_mean(spark, d):
    return _roll(spark, d).select("event_id", "roll_mean")


@query("win_roll_std", f"SELECT event_id, round(roll_std, 5) AS roll_std FROM {_ROLL}")
def win_roll_std(spark, d):
    return rounded(_roll(spark, d).select("event_id", "roll_std"), 5)


@query("win_roll_zscore", f"SELECT event_id, round((value - roll_mean) / (roll_std + 1e-6), 5) + 0.0 AS roll_z FROM {_ROLL}")
def win_roll_zscore(spark, d):
    return rounded(_roll(spark, d).select("event_id", "roll_z"), 5)


def _run_sql(expr):
    return f"""SELECT event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts))::INT AS run FROM (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM
      (SELECT event_id, user_id, ts, CASE WHEN lag(1) OVER w IS NULL OR v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS change
       FROM (SELECT event_id, user_id, ts, {expr} AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)))"""


@query("win_flatline_run", _run_sql("CASE WHEN event_id % 3 <> 0 THEN floor(value / 100) END"))
def win_flatline_run(spark, d):
    v = F.when(C("event_id") % 3 != 0, F.floor(C("value") / 100))
    return W.flatline_run(events(spark, d), "user_id", "ts", v).select("event_id", "run")


@query("win_group_transform", """SELECT o_orderkey, count(*) OVER w AS group_size, sum(cents) OVER w::BIGINT AS group_sum, round(avg(cents) OVER w, 6) AS group_mean, round(quantile_cont(cents::DOUBLE, 0.5) OVER w, 6) AS group_median
  FROM (SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def win_group_transform(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("cents"))
    return rounded(W.group_transform(o, "o_custkey", "cents", median=True).drop("o_custkey", "cents"))


@query("win_group_nunique", """SELECT l_orderkey, l_partkey, l_linenumber, n_labels FROM lineitem JOIN
  (SELECT l_suppkey, l_quantity, count(DISTINCT l_returnflag) AS n_labels FROM lineitem GROUP BY 1, 2) USING (l_suppkey, l_quantity)""")
def win_group_nunique(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    return W.group_nunique(l, ["l_suppkey", "l_quantity"], "l_returnflag").select("l_orderkey", "l_partkey", "l_linenumber", "n_labels")


@query("win_is_alone", """SELECT o_orderkey, (count(*) OVER (PARTITION BY o_custkey, month(o_orderdate)) = 1)::INT AS is_alone FROM orders""")
def win_is_alone(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("_", C("o_custkey").cast("string"), F.month("o_orderdate").cast("string")).alias("g"), F.lit(1).alias("one"))
    return W.group_transform(o, "g", "one").select("o_orderkey", flag(C("group_size") == 1).alias("is_alone"))


@query("win_family_count", """SELECT p_partkey, coalesce(n, 0) AS family_size FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN string_split(p_name, ' ')[-1] END AS t FROM part) LEFT JOIN
  (SELECT string_split(p_name, ' ')[-1] AS t, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1) USING (t)""")
def win_family_count(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(C("p_partkey") % 7 != 0, C("p_name")).alias("name"))
    return W.token_count(p, "name", "family_size").drop("name")


@query("win_joint_train_test", f"""SELECT o_orderkey, {split_sql('o_orderkey')} AS split, count(*) OVER w AS group_size, (sum(round(o_totalprice * 100)::BIGINT) OVER w)::BIGINT AS group_sum,
  CASE WHEN o_orderkey % 5 < 4 THEN (o_orderstatus = 'F')::INT END AS target FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def win_joint_train_test(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("cents"), flag(C("o_orderstatus") == "F").alias("target"),
                                         split_col("o_orderkey").alias("s"))
    out = W.joint_group_stats(o.filter("s = 'train'").drop("s"), o.filter("s = 'test'").drop("s", "target"), "o_custkey", "cents")
    return out.select("o_orderkey", "split", "group_size", "group_sum", "target")


@query("win_avg_rank", """SELECT event_id, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rank FROM (SELECT event_id, floor(value) AS v FROM events)""")
def win_avg_rank(spark, d):
    e = events(spark, d).select("event_id", F.floor("value").alias("v"))
    return W.average_rank(e, [], "v").select("event_id", "rank")


@query("win_cumulative_curve", f"""SELECT run, score, (sum(sum(y)) OVER w)::BIGINT AS tp, (sum(count(*) - sum(y)) OVER w)::BIGINT AS fp FROM {SCORES} GROUP BY 1, 2 WINDOW w AS (PARTITION BY run ORDER BY score DESC)""")
def win_cumulative_curve(spark, d):
    return W.cumulative_hits(scores(spark, d), ["run"], "score", "y").select("run", "score", "tp", "fp")


_TOP3 = f"(SELECT row_id, y, c, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rk FROM {CLASS_LONG})"


@query("topk_classes", f"SELECT row_id, string_agg(c::VARCHAR, ',' ORDER BY rk) AS top3 FROM {_TOP3} WHERE rk <= 3 GROUP BY 1")
def topk_classes(spark, d):
    return class_probs(spark, d).select("row_id", F.array_join(K.topk_codes("p", 3).cast("array<string>"), ",").alias("top3"))


@query("topk_strings", f"SELECT row_id, string_agg('C' || c::VARCHAR, ' ' ORDER BY rk) AS prediction FROM {_TOP3} WHERE rk <= 3 GROUP BY 1")
def topk_strings(spark, d):
    return class_probs(spark, d).select("row_id", K.topk_names("p", 3, [f"C{i}" for i in range(5)]).alias("prediction"))


@query("topk_global", """SELECT p_partkey, dev FROM (SELECT p_partkey, round(p_retailprice - 950, 4) + 0.0 AS dev FROM part) ORDER BY abs(dev) DESC, p_partkey LIMIT 15""")
def topk_global(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.round(C("p_retailprice") - 950, 4) + 0.0).alias("dev"))
    return K.topk_overall(p, 15, F.abs("dev"), "p_partkey")


@query("topk_per_group", """SELECT * FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem) WHERE rn <= 3""")
def topk_per_group(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    return K.topk_per_group(l, "l_suppkey", [F.desc("l_extendedprice")], 3)


@query("sort_entity_time", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq FROM events")
def sort_entity_time(spark, d):
    from loomwright.plans.scan import row_numbers

    return row_numbers(events(spark, d), ["user_id"], [C("ts")], "seq").select("event_id", "user_id", "seq")


@query("argmax_label", f"SELECT row_id, c AS label FROM {_TOP3} WHERE rk = 1")
def argmax_label(spark, d):
    return class_probs(spark, d).select("row_id", first_max_index("p").alias("label"))


@query("set_union_train_test", """SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment, 'train' AS split FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'test' FROM supplier""")
def set_union_train_test(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_acctbal").alias("acctbal"), C("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), C("s_acctbal").alias("acctbal"))
    return X.union_splits(c, s)


@query("set_augment_train", """WITH f AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey % 3)::INT AS fold FROM customer UNION ALL SELECT -s_suppkey - 1, s_acctbal, NULL FROM supplier)
  SELECT k::INT AS fold, count(*) FILTER (fold IS NULL OR fold <> k) AS n_train, count(*) FILTER (fold = k) AS n_valid FROM f, range(3) t(k) GROUP BY 1""")
def set_augment_train(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_acctbal").alias("x"), (C("c_custkey") % 3).cast("int").alias("fold"))
    s = table(spark, d, "supplier").select((-C("s_suppkey") - 1).alias("id"), C("s_acctbal").alias("x"))
    both = X.augment_train(c, s)
    one = [F.struct(F.lit(k).alias("fold"), F.count_if(C("fold").isNull() | (C("fold") != k)).alias("n_train"), F.count_if(C("fold") == k).alias("n_valid")) for k in range(3)]
    return both.agg(F.array(*one).alias("a")).select(F.inline("a"))


@query("set_replace_partition", f"""SELECT l_orderkey, l_quantity, split FROM (SELECT l_orderkey, l_quantity, {split_sql('l_orderkey')} AS split FROM lineitem) WHERE split <> 'test'
  UNION ALL SELECT l_orderkey, l_quantity * 2, 'test' FROM lineitem WHERE l_orderkey % 5 = 4""")
def set_replace_partition(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", split_col("l_orderkey").alias("split"))
    new = l.filter("split = 'test'").withColumn("l_quantity", C("l_quantity") * 2)
    return X.replace_splits(l, new).select("l_orderkey", "l_quantity", "split")


@query("smp_n_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 1000")
def smp_n_rows(spark, d):
    return X.sample_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query("smp_keep_positives", """SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL (SELECT doc_id, toxic FROM labels WHERE toxic = 0 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100)""")
def smp_keep_positives(spark, d):
    return X.keep_positives(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", C("toxic") == 1, 100)


@query("smp_undersample", """SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM labels)
  WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def smp_undersample(spark, d):
    return X.undersample(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("smp_weighted_replace", """WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)),
  r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS rn FROM orders),
  d AS (SELECT i AS draw, ('0x' || left(md5(i::VARCHAR || 'class'), 8))::UBIGINT / 4294967296.0::DOUBLE AS u1, ('0x' || left(md5(i::VARCHAR || 'row'), 8))::UBIGINT / 4294967296.0::DOUBLE AS u2 FROM range((SELECT count(*) FROM orders)) t(i))
  SELECT draw, o_orderkey, c.o_orderpriority FROM d JOIN c ON c.k = floor(u1 * (SELECT count(*) FROM c)) JOIN r ON r.o_orderpriority = c.o_orderpriority AND r.rn = floor(u2 * c.n) + 1""")
def smp_weighted_replace(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return X.weighted_replace(spark, o, "o_orderkey", "o_orderpriority")


@query("smp_fewshot", """SELECT doc_id, quality, rn AS shot FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn
  FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE rn <= 4""")
def smp_fewshot(spark, d):
    l = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return X.few_shot(l.drop("toxic"), l.filter("toxic = 1"), "doc_id", "quality", 4)
