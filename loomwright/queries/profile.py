"""Queries of the profile, drift and publish sections."""

from pyspark.sql import functions as F

from loomwright.functions.expr import first_max_index, flag, row_count
from loomwright.operators import drift as DR
from loomwright.operators import metrics as M
from loomwright.operators import profile as P
from loomwright.operators import publish as PB
from loomwright.operators import target_encoding as TE
from loomwright.operators import topk as K
from loomwright.queries.fixtures import (
    ORDERS_NULLED, SPLIT_LINES, class_probs, orders_nulled, split_col, split_lines, split_sql,
)
from loomwright.queries.history import rounded
from loomwright.queries.metrics_decide import PRED
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
NUM = ["l_quantity", "l_extendedprice", "l_tax"]


def per(cols, template):
    """One SELECT per column."""
    return " UNION ALL ".join(template.format(c=c) for c in cols)


def nulled(spark, d):
    return orders_nulled(spark, d).withColumn("split", split_col("o_orderkey"))


NULLED = f"(SELECT *, {split_sql('o_orderkey')} AS split FROM {ORDERS_NULLED})"
_MISS = """SELECT '{c}' AS "column", '{k}' AS kind, count(*) FILTER (split = 'train' AND {c} IS NULL) AS train_missing, count(*) FILTER (split = 'train' AND {c} IS NULL) * 100 / (count(*) FILTER (split = 'train'))::DOUBLE AS train_percent,
  count(*) FILTER (split = 'test' AND {c} IS NULL) AS test_missing, count(*) FILTER (split = 'test' AND {c} IS NULL) * 100 / (count(*) FILTER (split = 'test'))::DOUBLE AS test_percent FROM """ + NULLED
_KINDS = {"o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderpriority": "categorical"}


@query("pr_missing", " UNION ALL ".join(_MISS.format(c=c, k=k) for c, k in _KINDS.items()))
def pr_missing(spark, d):
    return P.missing(nulled(spark, d), list(_KINDS), "split")


@query("pr_describe", per(NUM, """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.5), 5) AS median,
  round(quantile_cont({c}, 0.75), 5) AS q3, max({c}) AS max FROM lineitem"""))
def pr_describe(spark, d):
    return rounded(P.describe(table(spark, d, "lineitem"), NUM), 5)


@query("pr_skew_kurt", per(["l_quantity", "l_extendedprice"], """SELECT '{c}' AS "column", round(skewness({c}), 5) + 0.0 AS skew, round(kurtosis({c}), 5) + 0.0 AS kurt, round(skewness(ln(1 + {c})), 5) + 0.0 AS log_skew FROM lineitem"""))
def pr_skew_kurt(spark, d):
    return rounded(P.skew_kurt(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 5)


_SK = "round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (var_pop(x) ** 1.5), 5) + 0.0"


@query("pr_skew_flag", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_SK} AS skew, CASE WHEN abs({_SK}) > 1 THEN 'high' WHEN abs({_SK}) > 0.5 THEN 'moderate' ELSE 'symmetric' END AS flag FROM (SELECT {e} AS x FROM part)"""
                                          for c, e in (("p_size", "p_size::DOUBLE"), ("size_sq", "(p_size * p_size)::DOUBLE"), ("size_6", "(p_size::DOUBLE / 10) ** 6"))))
def pr_skew_flag(spark, d):
    p = table(spark, d, "part").select(C("p_size").cast("double").alias("p_size"), (C("p_size") * C("p_size")).cast("double").alias("size_sq"),
                                       F.pow(C("p_size").cast("double") / 10, 6).alias("size_6"))
    return rounded(P.skew_flag(p, ["p_size", "size_sq", "size_6"]), 5)


_CARD = ["o_orderstatus", "o_orderpriority"]


@query("pr_cardinality", per(_CARD, """SELECT '{c}' AS "column", split, count(DISTINCT {c}) AS n_levels, count(DISTINCT coalesce({c}, '?')) AS n_with_missing FROM """ + NULLED + " GROUP BY 2"))
def pr_cardinality(spark, d):
    return P.cardinality(nulled(spark, d), _CARD, "split")


@query("pr_value_counts", f"SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS share FROM {NULLED} GROUP BY 1")
def pr_value_counts(spark, d):
    return P.value_counts(nulled(spark, d), "o_orderpriority")


@query("pr_class_balance", "SELECT o_orderpriority, n, n / (sum(n) OVER ())::DOUBLE AS share, max(n) OVER () / (min(n) OVER ())::DOUBLE AS imbalance FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def pr_class_balance(spark, d):
    return P.class_balance(table(spark, d, "orders"), "o_orderpriority")


@query("pr_corr_target", per(["l_quantity", "l_tax", "l_linenumber"], """SELECT '{c}' AS "column", round(corr({c}, l_extendedprice), 7) + 0.0 AS r FROM lineitem"""))
def pr_corr_target(spark, d):
    return rounded(P.corr_target(table(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_linenumber"], "l_extendedprice"), 7)


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_quantity", "l_linenumber"), ("l_extendedprice", "l_tax"), ("l_extendedprice", "l_linenumber"), ("l_tax", "l_linenumber")]


@query("pr_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) + 0.0 AS r FROM lineitem" for a, b in _PAIRS))
def pr_corr_matrix(spark, d):
    return rounded(P.corr_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber"]), 7)


#: The p-value by Simpson's rule over the density of the t distribution.
_BISERIAL = """SELECT "column", round(r, 7) + 0.0 AS r, n, round(t, 5) + 0.0 AS t, round(1 - 2 * abs(t) / 6000 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi())
    * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 2000, 2) / (n - 2), -(n - 1) / 2.0))), 6) + 0.0 AS p
  FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT '{c}' AS "column", corr({c}::DOUBLE, (o_orderstatus = 'F')::INT::DOUBLE) AS r, count(*) AS n FROM orders))"""


@query("pr_pointbiserial", per(["o_totalprice", "o_custkey"], _BISERIAL))
def pr_pointbiserial(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", C("o_custkey").cast("double").alias("o_custkey"), flag(C("o_orderstatus") == "F").cast("double").alias("y"))
    return rounded(P.point_biserial(o, ["o_totalprice", "o_custkey"], "y"), 7).withColumns({"t": F.round("t", 5) + 0.0, "p": F.round("p", 6) + 0.0})


@query("pr_rate_by_level", """WITH l AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, (o_orderstatus = 'F')::INT AS y FROM orders UNION ALL SELECT 'month', month(o_orderdate)::VARCHAR, (o_orderstatus = 'F')::INT FROM orders),
  p AS (SELECT "column", value, avg(y) AS rate, count(*) AS n FROM l GROUP BY 1, 2) SELECT "column", value, rate, n, max(rate) OVER (PARTITION BY "column") - min(rate) OVER (PARTITION BY "column") AS spread FROM p""")
def pr_rate_by_level(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.month("o_orderdate").alias("month"), "o_orderstatus")
    return P.rate_by_level(o, ["o_orderpriority", "month"], flag(C("o_orderstatus") == "F"))


@query("pr_median_by_level", "SELECT p_type, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY 1")
def pr_median_by_level(spark, d):
    return P.median_by_level(table(spark, d, "part"), "p_type", "p_retailprice")


_CM = "(SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1)"


@query("pr_class_means_z", f"SELECT l_returnflag, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 5) + 0.0 AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 5) + 0.0 AS l_extendedprice FROM {_CM}")
def pr_class_means_z(spark, d):
    return rounded(P.class_means_z(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), 5)


_DEC = "(SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM orders)"
_DB = " + ".join(f"(o_totalprice > e{i})::INT" for i in range(1, 10))


@query("pr_mutual_info", f"""WITH r AS (SELECT (o_orderstatus = 'F')::INT AS y, o_orderpriority, ({_DB})::VARCHAR AS o_totalprice FROM orders, {_DEC}), l AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, y FROM r UNION ALL SELECT 'o_totalprice', o_totalprice, y FROM r),
  c AS (SELECT "column", value, y, count(*) AS n FROM l GROUP BY 1, 2, 3), j AS (SELECT "column", n, sum(n) OVER (PARTITION BY "column", value) AS nx, sum(n) OVER (PARTITION BY "column", y) AS ny, sum(n) OVER (PARTITION BY "column") AS t FROM c)
  SELECT "column", round(sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)), 9) AS mi FROM j GROUP BY 1""")
def pr_mutual_info(spark, d):
    o = P.binned(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"), ["o_totalprice"])
    return rounded(P.mutual_info(o.withColumn("y", flag(C("o_orderstatus") == "F")), ["o_orderpriority", "o_totalprice"], "y"), 9)


_SF = f"(SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, o_custkey::DOUBLE AS t, {_DB} AS bin FROM orders, {_DEC})"


@query("pr_single_feature_score", f"""WITH m AS (SELECT *, avg(y) OVER (PARTITION BY bin) AS p, avg(t) OVER (PARTITION BY bin) AS pt FROM {_SF}), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM m)
  SELECT round((SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE FROM r), 8) AS auc, round(sqrt(avg((t - pt) ** 2)), 6) AS rmse FROM m""")
def pr_single_feature_score(spark, d):
    o = P.binned(table(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus"), ["o_totalprice"])
    o = o.select(C("o_totalprice").alias("bin"), flag(C("o_orderstatus") == "F").alias("y"), C("o_custkey").cast("double").alias("t"))
    auc = M.roc_auc(P.level_means(o, "bin", "y", "score"), []).first()["auc"]
    err = P.level_means(o, "bin", "t", "p").agg(M.rmse("t", "p").alias("rmse"))
    return err.select(F.round(F.lit(auc), 8).alias("auc"), F.round("rmse", 6).alias("rmse"))


_EW = """(SELECT left(o_orderpriority, 1)::INT - 1 AS y, """ + " + ".join(f"(o_custkey > lo + (hi - lo) / 10.0::DOUBLE * {i})::INT" for i in range(1, 10)) + """ AS bin FROM orders, (SELECT min(o_custkey)::DOUBLE AS lo, max(o_custkey)::DOUBLE AS hi FROM orders))"""


@query("pr_single_feature_map3", f"""WITH s AS (SELECT bin, c, count(*) FILTER (y = c) AS s FROM {_EW}, range(5) t(c) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY s DESC, c) AS rk FROM s),
  p AS (SELECT s, row_number() OVER (ORDER BY s DESC, c) AS rk FROM (SELECT c, sum(s) AS s FROM s GROUP BY 1)), a AS (SELECT sum(CASE WHEN rk <= 3 THEN s / rk::DOUBLE ELSE 0 END) / sum(s) AS v FROM r), b AS (SELECT sum(CASE WHEN rk <= 3 THEN s / rk::DOUBLE ELSE 0 END) / sum(s) AS v FROM p)
  SELECT round(a.v, 9) AS map3, round(a.v - b.v, 9) AS lift FROM a, b""")
def pr_single_feature_map3(spark, d):
    o = table(spark, d, "orders").select(C("o_custkey").cast("double").alias("x"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"))
    lo, hi = o.agg(F.min("x"), F.max("x")).first()
    b = o.select(P.equal_width_bin("x", lo, hi, 10).alias("bin"), F.lit(0).alias("all"), "y")
    prior = P.bucket_map3(TE.bucket_table(b, "y", 5, ["all"]), "all", 5).first()["map3"]
    got = P.bucket_map3(TE.bucket_table(b, "y", 5, ["bin"]), "bin", 5)
    return rounded(got.select("map3", (C("map3") - F.lit(prior)).alias("lift")), 9)


_UV = "(SELECT '{c}' AS col, {c}::DOUBLE AS score, (l_returnflag = 'R')::INT AS y FROM lineitem)"


def _uni_sql():
    from loomwright.queries.metrics_decide import auc_sql

    cols = ["l_quantity", "l_tax"]
    u = "(" + " UNION ALL ".join(_UV.format(c=c)[1:-1] for c in cols) + ")"
    g = f"(SELECT col, score, sum(y) AS pos, count(*) AS n FROM {u} GROUP BY 1, 2)"

    def ap(order):
        return f"(SELECT col, sum(pos * tp::DOUBLE / al) / sum(pos) AS ap FROM (SELECT col, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM {g} WINDOW w AS (PARTITION BY col ORDER BY score {order})) GROUP BY 1)"

    return f"""SELECT a.col AS "column", round(auc, 9) AS auc, round(1 - auc, 9) AS auc_neg, round(p.ap, 8) AS ap, round(q.ap, 8) AS ap_neg FROM ({auc_sql(u, ['col'])}) a JOIN {ap('DESC')} p ON p.col = a.col JOIN {ap('ASC')} q ON q.col = a.col"""


@query("pr_univariate_auc", _uni_sql())
def pr_univariate_auc(spark, d):
    l = table(spark, d, "lineitem").select("l_quantity", "l_tax", flag(C("l_returnflag") == "R").alias("y"))
    v = P.long_values(l, ["l_quantity", "l_tax"], ["y"]).withColumnRenamed("value", "score")
    auc = M.roc_auc(v, ["column"])
    ap = M.average_precision(v, ["column"])
    neg = M.average_precision(v.withColumn("score", -C("score")), ["column"]).withColumnRenamed("ap", "ap_neg")
    out = auc.join(ap, "column").join(neg, "column").withColumn("auc_neg", 1 - C("auc"))
    return out.select("column", *[F.round(c, 9).alias(c) for c in ("auc", "auc_neg")], *[F.round(c, 8).alias(c) for c in ("ap", "ap_neg")])


@query("pr_iqr_outliers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(q1 - 1.5 * (q3 - q1), 4) AS lo, round(q3 + 1.5 * (q3 - q1), 4) AS hi, round(p99, 4) AS p99, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  round(count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100 / count(*)::DOUBLE, 4) AS percent FROM (SELECT {e} AS x FROM lineitem), (SELECT quantile_cont({e}, 0.25) AS q1, quantile_cont({e}, 0.75) AS q3, quantile_cont({e}, 0.99) AS p99 FROM lineitem) GROUP BY q1, q3, p99"""
                                            for c, e in (("l_quantity", "l_quantity"), ("unit", "l_extendedprice * l_extendedprice / l_quantity"))))
def pr_iqr_outliers(spark, d):
    l = table(spark, d, "lineitem").select("l_quantity", (C("l_extendedprice") * C("l_extendedprice") / C("l_quantity")).alias("unit"))
    return rounded(P.iqr_outliers(l, ["l_quantity", "unit"]), 4)


@query("pr_sentinels", """SELECT 'o_custkey' AS "column", '0' AS sentinel, count(*) FILTER (o_custkey = 0) AS n FROM orders UNION ALL SELECT 'o_custkey', '17', count(*) FILTER (o_custkey = 17) FROM orders UNION ALL SELECT 'o_orderpriority', '4-NOT SPECIFIED', count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') FROM orders""")
def pr_sentinels(spark, d):
    return P.sentinels(table(spark, d, "orders"), {"o_custkey": [0, 17], "o_orderpriority": ["4-NOT SPECIFIED"]})


@query("pr_duplicates", "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_surplus, count(*) FILTER (n > 1) AS n_groups FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def pr_duplicates(spark, d):
    return P.duplicates(table(spark, d, "documents"), ["text"])


@query("pr_label_conflicts", """SELECT count(*) AS n_vectors, count(*) FILTER (k > 1) AS n_conflicting, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS rows_covered FROM (SELECT text, count(DISTINCT y) AS k, count(*) AS n FROM
  (SELECT text, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS y FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""")
def pr_label_conflicts(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "text", F.when(C("doc_id") % 3 == 0, 1 - C("quality")).otherwise(C("quality")).alias("y"))
    return P.label_conflicts(x, ["text"], "y")


@query("pr_missing_informative", " UNION ALL ".join(f"""SELECT '{c}' AS "column", k::INT AS class, round(count(*) FILTER ({c} IS NULL AND y = k) / (count(*) FILTER ({c} IS NULL))::DOUBLE - count(*) FILTER (y = k) / count(*)::DOUBLE, 9) + 0.0 AS lift
  FROM (SELECT *, (o_custkey % 3)::INT AS y FROM {ORDERS_NULLED}), range(3) t(k) GROUP BY k""" for c in _KINDS))
def pr_missing_informative(spark, d):
    o = orders_nulled(spark, d).withColumn("y", (C("o_custkey") % 3).cast("int"))
    return rounded(P.missing_informative(o, list(_KINDS), "y", [0, 1, 2]), 9)


@query("pr_missing_by_group", "SELECT user_id, month(ts)::INT AS month, avg((event_id % 7 = 0)::INT) AS missing_rate, count(*) AS n FROM events GROUP BY 1, 2")
def pr_missing_by_group(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.when(C("event_id") % 7 != 0, C("value")).alias("value"))
    return P.missing_by_group(e, [C("user_id"), F.month("ts").alias("month")], "value")


@query("pr_structural_missing", f"SELECT o_orderstatus, avg((o_totalprice IS NULL)::INT) AS missing_share, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM {ORDERS_NULLED} GROUP BY 1")
def pr_structural_missing(spark, d):
    return P.structural_missing(orders_nulled(spark, d), "o_orderstatus", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("pr_semantic_none", """SELECT 'o_orderpriority' AS "column", avg((o_orderpriority IN ('4-NOT SPECIFIED'))::INT) AS share FROM orders UNION ALL SELECT 'o_orderstatus', avg((o_orderstatus IN ('O', 'P'))::INT) FROM orders UNION ALL SELECT 'o_totalprice', avg((o_totalprice < 5000)::INT) FROM orders""")
def pr_semantic_none(spark, d):
    return P.semantic_none(table(spark, d, "orders"), {"o_orderpriority": ["4-NOT SPECIFIED"], "o_orderstatus": ["O", "P"]}, {"o_totalprice": 5000})


@query("pr_rate_by_time", " UNION ALL ".join(f"SELECT '{n}' AS part, {e}::INT AS value, avg((event_type = 'error')::INT) AS rate, count(*) AS n FROM events GROUP BY 2"
                                            for n, e in (("hour", "hour(ts)"), ("weekday", "(isodow(ts) - 1)"), ("month", "month(ts)"))))
def pr_rate_by_time(spark, d):
    e = table(spark, d, "events")
    return P.rate_by(e, {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "month": F.month("ts")}, flag(C("event_type") == "error"))


@query("pr_near_zero_var", "SELECT (i - 1)::INT AS position, round(var_pop(embedding[i]::DOUBLE), 9) AS variance, var_pop(embedding[i]::DOUBLE) < 1e-8 AS near_zero FROM embeddings, range(1, 65) t(i) GROUP BY i")
def pr_near_zero_var(spark, d):
    e = table(spark, d, "embeddings").select(C("embedding").cast("array<double>").alias("embedding"))
    return rounded(P.near_zero_variance(e, "embedding"), 9)


@query("pr_pca_scree")
def pr_pca_scree(spark, d):
    cum, need = P.pca_scree(table(spark, d, "embeddings"), "embedding")
    rows = [(i + 1, float(v), i + 1 >= need[0.9], i + 1 >= need[0.95]) for i, v in enumerate(cum)]
    return spark.createDataFrame(rows, "component int, cumulative double, reaches_90 boolean, reaches_95 boolean")


@query("pr_histogram", f"SELECT split, l_returnflag, floor((l_extendedprice - 0) / 10000.0)::INT AS bin, count(*) AS n FROM {SPLIT_LINES} GROUP BY 1, 2, 3")
def pr_histogram(spark, d):
    return P.histogram(split_lines(spark, d), "l_extendedprice", ["split", "l_returnflag"], 0, 10000.0)


_LAM = "ks * sqrt(na * nb / (na + nb)::DOUBLE)"
_PV = " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp({-2.0 * k * k} * ({_LAM}) * ({_LAM}))" for k in range(1, 21))


@query("dr_ks", f"""WITH v AS ({per(NUM, 'SELECT ' + "'{c}'" + ' AS col, split, {c} AS x FROM ' + SPLIT_LINES)}), c AS (SELECT col, x, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM v GROUP BY 1, 2),
  u AS (SELECT col, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY col) AS na, sum(b) OVER (PARTITION BY col) AS nb FROM c WINDOW w AS (PARTITION BY col ORDER BY x)),
  k AS (SELECT col, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks, max(na)::BIGINT AS na, max(nb)::BIGINT AS nb FROM u GROUP BY 1)
  SELECT col AS "column", round(ks, 9) AS ks, round(CASE WHEN {_LAM} < 0.2 THEN 1.0 ELSE least(greatest({_PV}, 0.0), 1.0) END, 6) AS p_value FROM k""")
def dr_ks(spark, d):
    return DR.ks(split_lines(spark, d), NUM, "split").select("column", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"))


def _psi_sql(c):
    edges = "list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(11)) + "]))"
    return f"""SELECT '{c}' AS "column", round(sum((b - a) * ln(b / a)), 8) AS psi FROM (SELECT greatest(count(*) FILTER (split = 'train') / (SELECT count(*) FROM {SPLIT_LINES} WHERE split = 'train')::DOUBLE, 1e-6) AS a,
      greatest(count(*) FILTER (split = 'test') / (SELECT count(*) FROM {SPLIT_LINES} WHERE split = 'test')::DOUBLE, 1e-6) AS b
      FROM {SPLIT_LINES}, (SELECT e[2:-2] AS e FROM (SELECT {edges} AS e FROM {SPLIT_LINES} WHERE split = 'train')) GROUP BY len(list_filter(e, lambda v: v < {c})))"""


@query("dr_psi", " UNION ALL ".join(_psi_sql(c) for c in NUM))
def dr_psi(spark, d):
    return rounded(DR.psi(split_lines(spark, d), NUM, "split"), 8)


_TV = f"""(SELECT 'o_orderstatus' AS col, coalesce(o_orderstatus, '<MISSING>') AS v, split FROM {NULLED} UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, '<MISSING>'), split FROM {NULLED})"""
_GAP = f"""(SELECT col, abs(a / (sum(a) OVER (PARTITION BY col))::DOUBLE - b / (sum(b) OVER (PARTITION BY col))::DOUBLE) AS gap FROM (SELECT col, v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM {_TV} GROUP BY 1, 2))"""


@query("dr_total_variation", f'SELECT col AS "column", round(0.5 * sum(gap), 9) AS total_variation FROM {_GAP} GROUP BY 1')
def dr_total_variation(spark, d):
    return rounded(DR.total_variation(nulled(spark, d), ["o_orderstatus", "o_orderpriority"], "split"), 9)


@query("dr_max_share_gap", f'SELECT col AS "column", round(max(gap), 9) AS max_gap FROM {_GAP} GROUP BY 1')
def dr_max_share_gap(spark, d):
    return rounded(DR.max_share_gap(nulled(spark, d), ["o_orderstatus", "o_orderpriority"], "split"), 9)


@query("dr_missing_shift", per(list(_KINDS), """SELECT '{c}' AS "column", round(abs(avg(({c} IS NULL)::INT) FILTER (split = 'train') - avg(({c} IS NULL)::INT) FILTER (split = 'test')), 9) AS shift FROM """ + NULLED))
def dr_missing_shift(spark, d):
    return rounded(P.missing_shift(nulled(spark, d), list(_KINDS), "split"), 9)


@query("dr_mean_shift", per(NUM, """SELECT '{c}' AS "column", round(avg({c}) FILTER (split = 'train'), 4) AS train_mean, round(avg({c}) FILTER (split = 'test'), 4) AS test_mean, round(abs(avg({c}) FILTER (split = 'train') - avg({c}) FILTER (split = 'test')), 4) AS shift FROM """ + SPLIT_LINES))
def dr_mean_shift(spark, d):
    return rounded(DR.mean_shift(split_lines(spark, d), NUM, "split"), 4)


@query("dr_entity_overlap", f"SELECT sum(a)::BIGINT AS n_train, sum(b)::BIGINT AS n_test, sum(a * b)::BIGINT AS n_both, count(*) AS n_all FROM (SELECT user_id, max((event_id % 5 < 4)::INT) AS a, max((event_id % 5 >= 4)::INT) AS b FROM events GROUP BY 1)")
def dr_entity_overlap(spark, d):
    return DR.entity_overlap(table(spark, d, "events").select("user_id", split_col("event_id").alias("split")), "user_id", "split")


@query("pub_validate", """SELECT count(*) FILTER (o_orderkey % 100 = 0) AS n_missing_ids, 1::BIGINT AS n_extra_ids, 0::BIGINT AS n_duplicate_ids, count(*) FILTER (o_orderkey % 100 <> 0 AND o_orderkey % 7 = 0) AS n_null, 0::BIGINT AS n_not_finite,
  count(*) FILTER (o_orderkey % 100 <> 0 AND o_orderkey % 7 <> 0 AND o_totalprice / 480000.0 > 1) AS n_out_of_range, 0::BIGINT AS n_bad_columns FROM orders""")
def pub_validate(spark, d):
    o = table(spark, d, "orders")
    out = o.filter("o_orderkey % 100 <> 0").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 7 != 0, C("o_totalprice") / 480000.0).alias("prediction"))
    extra = o.agg((-F.max("o_orderkey") - 1).alias("id"), F.lit(0.5).alias("prediction"))
    return PB.validate(out.unionByName(extra), o.select(C("o_orderkey").alias("id")), "id", "prediction", 0.0, 1.0, ["id", "prediction"])


@query("pub_topk_validate", "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 10 = 0) AS n_bad FROM orders")
def pub_topk_validate(spark, d):
    names = [f"C{i}" for i in range(5)]
    p = class_probs(spark, d).select("row_id", K.topk_names("p", 3, names).alias("prediction"))
    broken = p.withColumn("prediction", F.when(C("row_id") % 20 == 0, "C1 C1 C2").when(C("row_id") % 10 == 0, "C1 C2 C9").otherwise(C("prediction")))
    return broken.agg(row_count().alias("n_rows"), F.count_if(~PB.topk_valid("prediction", names, 3)).alias("n_bad"))


@query("pub_wide_to_long", "SELECT vec_id::VARCHAR || '_' || (i - 1)::VARCHAR AS id, embedding[i]::DOUBLE AS probability FROM embeddings, range(1, 65) t(i)")
def pub_wide_to_long(spark, d):
    return PB.wide_to_long(table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("e")), "vec_id", "e")


@query("pub_distribution", f"SELECT pred AS label, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS share FROM {PRED} GROUP BY 1")
def pub_distribution(spark, d):
    p = class_probs(spark, d).select(first_max_index("p").alias("label"))
    return PB.label_distribution(p, "label", table(spark, d, "orders").count())
