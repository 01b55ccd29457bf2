"""Queries of the joins section."""

from pyspark.sql import functions as F

from loomwright.functions.expr import hash_key, row_count
from loomwright.operators import joins as J
from loomwright.plans.scan import row_numbers
from loomwright.queries.fixtures import SCORES_WIDE, scores, split_col
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col



@query("join_left_enrich", """SELECT c_custkey, c_mktsegment, n_orders, total FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def join_left_enrich(spark, d):
    feats = (table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(C("o_custkey").alias("c_custkey"))
             .agg(row_count().alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    return J.left_enrich(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), feats, "c_custkey")


@query("join_full_outer_chain", """SELECT coalesce(a.k, b.k, c.k) AS nationkey, n_rich, n_suppliers, nation FROM
  (SELECT c_nationkey AS k, count(*) AS n_rich FROM customer WHERE c_acctbal > 9800 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal < 5000 GROUP BY 1) b ON a.k = b.k
  FULL JOIN (SELECT n_nationkey AS k, n_name AS nation FROM nation) c ON coalesce(a.k, b.k) = c.k""")
def join_full_outer_chain(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9800").groupBy(C("c_nationkey").alias("nationkey")).agg(row_count().alias("n_rich"))
    b = table(spark, d, "supplier").filter("s_acctbal < 5000").groupBy(C("s_nationkey").alias("nationkey")).agg(row_count().alias("n_suppliers"))
    c = table(spark, d, "nation").select(C("n_nationkey").alias("nationkey"), C("n_name").alias("nation"))
    return J.full_outer_chain([a, b, c], "nationkey")


@query("join_inner_rekey", """SELECT o_custkey, count(*) AS n_loans, round(avg(qty), 6) AS mean_qty FROM
  (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def join_inner_rekey(spark, d):
    child = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    up = J.inner_rekey(child, table(spark, d, "orders"), "o_orderkey", "o_custkey")
    return up.groupBy("o_custkey").agg(row_count().alias("n_loans"), F.round(F.avg("qty"), 6).alias("mean_qty"))


@query("join_index_align", """SELECT o_custkey, count(*) AS n, avg(round(o_totalprice * 100)::BIGINT) AS cents_mean, round(avg((o_orderstatus = 'F')::INT), 8) AS closed_rate FROM orders GROUP BY 1""")
def join_index_align(spark, d):
    # aggregates over one key are one groupBy, not a join of several
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        row_count().alias("n"), F.avg(F.round(C("o_totalprice") * 100).cast("long")).alias("cents_mean"),
        F.round(F.avg((C("o_orderstatus") == "F").cast("int")), 8).alias("closed_rate"))


@query("join_lookup_map", """SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN
  (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 5 < 4 AND o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)""")
def join_lookup_map(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    size = (o.filter((split_col("o_orderkey") == "train") & (C("o_orderstatus") == "F")).groupBy("o_custkey").agg(row_count().alias("n")))
    return J.lookup(o, size, "o_custkey", "n", 0).select("o_orderkey", "n")


@query("join_fold_table", """SELECT o_orderkey, o_totalprice, ((row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '7')) - 1) % 5)::INT AS fold FROM orders""")
def join_fold_table(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    keyed = o.select("o_orderkey", hash_key("o_orderkey", seed=7).alias("h"))
    folds = row_numbers(keyed, [], [C("h")], "n").select("o_orderkey", ((C("n") - 1) % 5).cast("int").alias("fold"))
    return J.attach_folds(o, folds, "o_orderkey")


@query("join_template_order", "SELECT o_orderkey, o_totalprice FROM orders")
def join_template_order(spark, d):
    o = table(spark, d, "orders")
    template = o.select("o_orderkey", F.md5(C("o_orderkey").cast("string")).alias("pos"))
    return J.template_order(template, o.select("o_orderkey", "o_totalprice"), "o_orderkey", "pos").drop("pos")


@query("join_align_runs", f"SELECT row_id, a, b, c FROM {SCORES_WIDE}")
def join_align_runs(spark, d):
    return J.align_runs(scores(spark, d), ["a", "b", "c"])


_TOKENS = "SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM"


def _vocab(spark, d, name):
    return table(spark, d, name).select(F.explode(J.tokens(C("text"))).alias("token")).distinct()


@query("join_semi_overlap", f"""SELECT token FROM ({_TOKENS} documents) WHERE token <> '' AND token IN (SELECT token FROM ({_TOKENS} benchmark))""")
def join_semi_overlap(spark, d):
    return J.semi_overlap(_vocab(spark, d, "documents"), _vocab(spark, d, "benchmark"), "token")


@query("join_anti_unseen", f"""SELECT token FROM ({_TOKENS} documents) WHERE token <> '' AND token NOT IN (SELECT token FROM ({_TOKENS} benchmark))""")
def join_anti_unseen(spark, d):
    return J.anti_unseen(_vocab(spark, d, "documents"), _vocab(spark, d, "benchmark"), "token")


@query("join_cross_grid", """SELECT c_custkey, r_name, printf('%05d_%s', c_custkey::INT, r_name) AS grid_id FROM customer, region""")
def join_cross_grid(spark, d):
    grid = J.class_grid(table(spark, d, "customer").select("c_custkey"), table(spark, d, "region"), "r_name")
    return grid.withColumn("grid_id", F.format_string("%05d_%s", "c_custkey", "r_name"))
