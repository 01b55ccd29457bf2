"""Queries of the sources, sinks and checks sections."""

from pyspark.sql import functions as F

from loomwright.operators import checks
from loomwright.plans.store import fresh_path, load_or_build
from loomwright.queries.fixtures import PRIORITIES, split_col, split_sql
from loomwright.queries.registry import query
from loomwright.sources import (
    align_external, merge_partitions, parse_frames, read_csv, read_dimension, read_label_matrix, table, upsert_results,
    write_json_report, write_ordered_csv, write_predictions,
)
from loomwright.sources.records import read_records, record_index, to_examples, write_records


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, d):
    path = fresh_path(spark, "src_csv")
    table(spark, d, "nation").write.option("header", True).csv(path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_csv_project", """SELECT user_id, event_id, hour(ts)::INT AS hour,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq FROM events""")
def src_csv_project(spark, d):
    from loomwright.plans.scan import row_numbers

    path = fresh_path(spark, "src_csv_project")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    (table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
     .write.option("header", True).option("timestampNTZFormat", fmt).csv(path))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    ev = read_csv(spark, path, schema, ["event_id", "ts", "user_id"], fmt)
    out = row_numbers(ev, ["user_id"], [F.col("ts")], "seq")
    return out.select("user_id", "event_id", F.hour("ts").alias("hour"), "seq")


@query("src_parquet_cache", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price
  FROM orders GROUP BY 1""")
def src_parquet_cache(spark, d):
    path = fresh_path(spark, "orders_cache")
    build = lambda: table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    load_or_build(spark, path, build)
    cached = load_or_build(spark, path, build)
    return cached.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("src_feature_cache", """SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 4) AS qty
  FROM lineitem GROUP BY 1""")
def src_feature_cache(spark, d):
    path = fresh_path(spark, "history_cache")
    build = lambda: (table(spark, d, "lineitem").groupBy("l_orderkey")
                     .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("qty")))
    return load_or_build(spark, path, build, force=True)


@query("src_frames_text", """SELECT vec_id, frame::INT AS frame, coef::INT AS coef,
  round(embedding[(coef * 8 + frame + 1)::INT]::DOUBLE, 6) AS x
  FROM embeddings, range(8) f(frame), range(8) g(coef)""")
def src_frames_text(spark, d):
    path = fresh_path(spark, "frames")
    e = table(spark, d, "embeddings")
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.array_join(F.transform(
        F.slice("embedding", c * 8 + 1, 8), lambda x: F.format_string("%.6f", x.cast("double"))), " "))
    e.select(F.col("vec_id").alias("entity"), F.array_join(lines, "\n").alias("text")).write.json(path)
    raw = spark.read.schema("entity long, text string").json(path)
    frames = parse_frames(raw)
    return frames.select(F.col("entity").alias("vec_id"), "frame", F.posexplode("coefs").alias("coef", "x"))


@query("src_label_matrix", """SELECT doc_id, label, y, n_chars::DOUBLE AS duration FROM (
  SELECT doc_id, 'quality' AS label, quality::INT AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::INT FROM labels)
  JOIN documents USING (doc_id)""")
def src_label_matrix(spark, d):
    path = fresh_path(spark, "label_matrix")
    (table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
     .select("doc_id", "quality", "toxic", "n_chars").write.csv(path))
    return read_label_matrix(spark, path, "doc_id", ["quality", "toxic"], "duration")


@query("src_dimension", "SELECT n_nationkey, n_name FROM nation")
def src_dimension(spark, d):
    path = fresh_path(spark, "dimension")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    n.unionByName(n.limit(1).select(F.lit("999").alias("n_nationkey"), F.lit("empty").alias("n_name"))).write.option(
        "header", True).csv(path)
    return read_dimension(spark, path, "n_nationkey string, n_name string", "n_nationkey",
                          F.col("n_name") != "empty", expected_rows=25)


@query("src_tfrecord_index", f"""SELECT page_id AS id, {split_sql('page_id')} AS split,
  (url LIKE 'https:%')::INT AS label, CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END AS class_name,
  CASE WHEN page_id % 5 < 4 THEN url ELSE 'v2/' || url END AS path FROM pages""")
def src_tfrecord_index(spark, d):
    """The pages as framed example files, one folder a split; their index; the test split converted again and merged."""
    path = fresh_path(spark, "record_index")
    secure = F.col("url").startswith("https:")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), secure.cast("int").alias("label"), F.col("url").alias("name"),
                                            F.col("html").alias("body"), split_col("page_id").alias("split"))

    def converted(rows):
        files = write_records(to_examples(rows, ["id", "label", "name", "body"]), "payload", fresh_path(spark, "record_files"), "split")
        return record_index(read_records(files), "id", "label", "name", ["http", "https"])

    merge_partitions(converted(pages), path)
    again = pages.filter("split = 'test'").withColumn("name", F.concat(F.lit("v2/"), "name"))
    merge_partitions(converted(again), path)
    return spark.read.parquet(path)


@query("src_external_aligned", """SELECT c_custkey AS row_id, c_nationkey AS nationkey, c_acctbal AS acctbal, 0 AS external FROM customer
  UNION ALL SELECT -row_number() OVER (ORDER BY s_suppkey), s_nationkey, s_acctbal, 1 FROM supplier""")
def src_external_aligned(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("﻿s_suppkey "), F.col("s_nationkey").alias(" s_nationkey"),
        F.col("s_acctbal").alias("Account Balance"))
    ext = align_external(s, {"s_nationkey": "nationkey", "Account Balance": "acctbal"}, ["nationkey", "acctbal"],
                         "row_id", F.col("s_suppkey"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("nationkey"),
                                             F.col("c_acctbal").alias("acctbal"))
    return own.withColumn("external", F.lit(0)).unionByName(ext.withColumn("external", F.lit(1)))


@query("sink_csv_ordered", "SELECT o_orderkey AS id, o_totalprice AS prediction FROM orders")
def sink_csv_ordered(spark, d):
    path = fresh_path(spark, "ordered_csv")
    o = table(spark, d, "orders")
    template = o.select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("pos"))
    write_ordered_csv(template, o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("prediction")), "id", "pos", path)
    return read_csv(spark, path, "id long, prediction double")


@query("sink_results_table", """SELECT run, CASE WHEN run IN ('1-URGENT', '2-HIGH') THEN f_mean ELSE all_mean END AS score FROM (
  SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS all_mean,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f_mean FROM orders GROUP BY 1)""")
def sink_results_table(spark, d):
    path = fresh_path(spark, "results")
    o = table(spark, d, "orders")
    score = F.round(F.avg("o_totalprice"), 4).alias("score")
    o.groupBy(F.col("o_orderpriority").alias("run")).agg(score).write.parquet(path)
    rerun = o.filter("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").groupBy(
        F.col("o_orderpriority").alias("run")).agg(score)
    out = path + "-v2"
    upsert_results(spark.read.parquet(path), rerun, ["run"], F.desc("score")).write.parquet(out)
    return spark.read.parquet(out)


@query("sink_predictions", f"""SELECT 'price' AS run, {split_sql('o_orderkey')} AS split, o_orderkey AS row_id,
  round(o_totalprice / 500000.0, 6) AS score FROM orders WHERE o_orderkey % 5 >= 4""")
def sink_predictions(spark, d):
    path = fresh_path(spark, "predictions")
    o = table(spark, d, "orders")
    preds = o.select(F.lit("price").alias("run"), split_col("o_orderkey").alias("split"), F.col("o_orderkey").alias("row_id"),
                     F.round(F.col("o_totalprice") / 500000.0, 6).alias("score"))
    write_predictions(preds, path)
    return spark.read.parquet(path).filter("run = 'price' AND split = 'test'")


@query("sink_json_report", """SELECT count(*) AS n_rows, round(avg(o_totalprice), 4) AS mean_price,
  round(avg((o_orderstatus = 'F')::INT), 6) AS positive_rate FROM orders""")
def sink_json_report(spark, d):
    path = fresh_path(spark, "report")
    rep = table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.struct(F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
                 F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("positive_rate")).alias("metrics"))
    write_json_report(rep, path)
    back = spark.read.schema("n_rows long, metrics struct<mean_price: double, positive_rate: double>").json(path)
    return back.select("n_rows", "metrics.mean_price", "metrics.positive_rate")


@query("chk_required_columns", """SELECT column_name AS "column", column_name IN
  ('o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority') AS present, n_rows
  FROM (VALUES ('o_orderkey'), ('o_totalprice'), ('o_clerk')) t(column_name), (SELECT count(*) AS n_rows FROM orders)""")
def chk_required_columns(spark, d):
    o = table(spark, d, "orders")
    required = ["o_orderkey", "o_totalprice", "o_clerk"]
    gone = checks.missing_columns(o, required)
    return o.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c not in gone).alias("present")) for c in required])).alias("s"),
        "n_rows").select("s.*", "n_rows")


_NULLABLE = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("chk_no_nulls", """SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS n_null FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL OR o_orderkey % 5 = 0) FROM orders
  UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL OR o_orderkey % 7 = 0) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL OR o_orderkey % 11 = 0) FROM orders""")
def chk_no_nulls(spark, d):
    from loomwright.queries.fixtures import orders_nulled

    return checks.null_counts(orders_nulled(spark, d), _NULLABLE)


@query("chk_label_domain", """SELECT count(*) AS n_rows,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')) AS n_unknown,
  count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')) AS n_known_levels FROM orders""")
def chk_label_domain(spark, d):
    known = [p for p in PRIORITIES if p != "4-NOT SPECIFIED"]
    return checks.domain_report(table(spark, d, "orders"), "o_orderpriority", known)


@query("chk_levels", """SELECT c_mktsegment AS level, count(*) AS n FROM customer
  WHERE c_mktsegment NOT IN ('BUILDING','AUTOMOBILE','MACHINERY') GROUP BY 1""")
def chk_levels(spark, d):
    return checks.unknown_levels(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY"])


@query("chk_range", """SELECT 'l_quantity' AS "column", min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_quantity) >= 1 AND max(l_quantity) <= 50 AS inside FROM lineitem
  UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), min(l_tax) >= 0 AND max(l_tax) <= 0.05 FROM lineitem""")
def chk_range(spark, d):
    return checks.range_report(table(spark, d, "lineitem"), {"l_quantity": (1, 50), "l_tax": (0, 0.05)})


@query("chk_shape_binary", """SELECT count(*) AS n_rows, 2::BIGINT AS n_labels,
  count(*) FILTER (quality NOT IN (0, 1)) + count(*) FILTER (toxic NOT IN (0, 1)) AS n_not_binary FROM labels""")
def chk_shape_binary(spark, d):
    return checks.binary_matrix_report(table(spark, d, "labels"), ["quality", "toxic"])


@query("chk_unique_ids", """SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_ids, count(*) FILTER (n > 1) AS n_duplicated, sum(m)::BIGINT AS n_missing_text
  FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (text IS NULL) AS m FROM documents GROUP BY 1)""")
def chk_unique_ids(spark, d):
    return checks.unique_id_report(table(spark, d, "documents"), "doc_id", "text")
