"""Queries of the projections, filters and scalar features section."""

from pyspark.sql import functions as F

from loomwright.functions.expr import clip, flag, row_sum, safe_div
from loomwright.operators import scalar as S
from loomwright.queries.fixtures import PART_NULLED, part_nulled, split_col, split_sql
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
LINE = "l_orderkey, l_partkey, l_linenumber"


def lines(spark, d, *cols):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *cols)


@query("feat_safe_ratio", f"""SELECT {LINE}, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
  l_tax / nullif(l_discount + 0.0, 0) AS tax_per_discount FROM lineitem""")
def feat_safe_ratio(spark, d):
    return lines(spark, d, safe_div("l_extendedprice", "l_quantity").alias("unit_price"),
                 safe_div("l_tax", "l_discount").alias("tax_per_discount"))


@query("feat_offset_ratio", f"""SELECT {LINE}, l_extendedprice / (l_quantity + 1.0) AS price_ratio,
  l_tax / ((l_discount + 0.0) + 1.0) AS tax_ratio FROM lineitem""")
def feat_offset_ratio(spark, d):
    return lines(spark, d, S.offset_ratio("l_extendedprice", "l_quantity").alias("price_ratio"),
                 S.offset_ratio("l_tax", C("l_discount") + 0.0).alias("tax_ratio"))


@query("feat_products", f"""SELECT {LINE}, l_quantity * l_extendedprice AS l_quantity_x_l_extendedprice,
  l_quantity * l_tax AS l_quantity_x_l_tax, l_extendedprice * l_tax AS l_extendedprice_x_l_tax FROM lineitem""")
def feat_products(spark, d):
    p = S.pairwise(["l_quantity", "l_extendedprice", "l_tax"], ["product"])
    return lines(spark, d, *[e.alias(n) for n, e in p.items()])


@query("feat_sum_diff", f"""SELECT p_partkey, coalesce(p_size::DOUBLE, 0.0) + coalesce(p_retailprice, 0.0) AS total,
  p_size - p_retailprice AS p_size_minus_p_retailprice, p_size / (p_retailprice + 1.0) AS p_size_over_p_retailprice
  FROM {PART_NULLED}""")
def feat_sum_diff(spark, d):
    p = S.pairwise(["p_size", "p_retailprice"], ["difference", "ratio"])
    return part_nulled(spark, d).select("p_partkey", row_sum(["p_size", "p_retailprice"]).alias("total"),
                                        *[e.alias(n) for n, e in p.items()])


@query("feat_years_from_days", """SELECT o_orderkey,
  CASE WHEN x < 0 THEN 0.0 ELSE x END AS years FROM (SELECT o_orderkey,
  -(date_diff('day', DATE '2000-01-01', o_orderdate::DATE)) / 365.25::DOUBLE AS x FROM orders)""")
def feat_years_from_days(spark, d):
    days = F.datediff(C("o_orderdate"), F.lit("2000-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", S.years_from_days(days).alias("years"))


@query("feat_age_diff", """SELECT o_orderkey, CASE WHEN start_year > 0 THEN 2002 - start_year ELSE 0 END::INT AS age FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE year(o_orderdate) END AS start_year FROM orders)""")
def feat_age_diff(spark, d):
    start = F.when(C("o_orderkey") % 7 == 0, 0).otherwise(F.year("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", S.age_at(F.lit(2002), start).alias("age"))


@query("feat_log1p", """SELECT event_id, round(ln(1 + CASE WHEN value - 50 < 0 THEN 0 ELSE value - 50 END), 8) AS log_value FROM events""")
def feat_log1p(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.log1p_clipped(C("value") - 50.0), 8).alias("log_value"))


@query("feat_expm1", """SELECT p_partkey, round(CASE WHEN x < 0 THEN 0 ELSE x END, 6) AS price FROM (
  SELECT p_partkey, exp(ln(p_retailprice - 930.0 + 31.0) - 2.0) - 1 AS x FROM part)""")
def feat_expm1(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.round(S.invert_log(F.log(C("p_retailprice") - 930.0 + 31.0) - 2.0), 6).alias("price"))


@query("feat_threshold_flag", f"""SELECT p_partkey, coalesce(p_size >= 30, false)::INT AS big, coalesce(p_size > 0, false)::INT AS has_size,
  coalesce(p_size <> 7, false)::INT AS not_seven FROM {PART_NULLED}""")
def feat_threshold_flag(spark, d):
    return part_nulled(spark, d).select("p_partkey", flag(C("p_size") >= 30).alias("big"), flag(C("p_size") > 0).alias("has_size"),
                                        flag(C("p_size") != 7).alias("not_seven"))


@query("feat_equality_flag", """SELECT event_id, (event_type = 'click')::INT AS is_click, (value = 6.55)::INT AS is_level,
  (event_type = 'error')::INT AS is_error FROM events""")
def feat_equality_flag(spark, d):
    return table(spark, d, "events").select("event_id", flag(C("event_type") == "click").alias("is_click"),
                                            flag(C("value") == 6.55).alias("is_level"), flag(C("event_type") == "error").alias("is_error"))


@query("feat_flag_count", """SELECT c_custkey, (c_acctbal < 0)::INT + (c_mktsegment = 'BUILDING')::INT + (c_nationkey >= 12)::INT AS risk FROM customer""")
def feat_flag_count(spark, d):
    risk = flag(C("c_acctbal") < 0) + flag(C("c_mktsegment") == "BUILDING") + flag(C("c_nationkey") >= 12)
    return table(spark, d, "customer").select("c_custkey", risk.alias("risk"))


@query("feat_weighted_sum", f"SELECT {LINE}, l_quantity + 0.5 * l_linenumber AS weighted FROM lineitem")
def feat_weighted_sum(spark, d):
    return lines(spark, d, (C("l_quantity") + 0.5 * C("l_linenumber")).alias("weighted"))


@query("feat_mean_pressure", f"""SELECT {LINE}, l_quantity + (l_extendedprice - l_quantity) / 3.0 AS mean_pressure,
  l_extendedprice - l_quantity AS pulse FROM lineitem""")
def feat_mean_pressure(spark, d):
    return lines(spark, d, S.mean_pressure("l_extendedprice", "l_quantity").alias("mean_pressure"),
                 (C("l_extendedprice") - C("l_quantity")).alias("pulse"))


@query("feat_composite_demand", f"""SELECT {LINE}, l_quantity * ((100.0 - l_tax * 1000.0) / 100.0) * (1.0 + l_linenumber / 20.0) AS demand,
  l_linenumber * ((100.0 - l_tax * 1000.0) / 100.0) AS wind_dryness FROM lineitem""")
def feat_composite_demand(spark, d):
    dry = (F.lit(100.0) - C("l_tax") * 1000.0) / 100.0
    return lines(spark, d, S.demand("l_quantity", C("l_tax") * 1000.0, "l_linenumber").alias("demand"),
                 (C("l_linenumber") * dry).alias("wind_dryness"))


@query("feat_interactions_derived", f"""SELECT {LINE}, unit_price * l_tax AS price_x_tax, unit_price * unit_price AS price_sq,
  (l_quantity + l_tax / 50.0) - unit_price AS supply_minus_demand FROM (SELECT *, l_extendedprice / (l_quantity + 1.0) AS unit_price FROM lineitem)""")
def feat_interactions_derived(spark, d):
    l = lines(spark, d, "l_quantity", "l_tax", S.offset_ratio("l_extendedprice", "l_quantity").alias("unit_price"))
    return l.select("l_orderkey", "l_partkey", "l_linenumber", (C("unit_price") * C("l_tax")).alias("price_x_tax"),
                    (C("unit_price") * C("unit_price")).alias("price_sq"),
                    ((C("l_quantity") + C("l_tax") / 50.0) - C("unit_price")).alias("supply_minus_demand"))


@query("feat_hour_cycle", """SELECT event_id, round((s / 3600.0) % 24, 6) AS hour_cycle, floor(((s / 3600.0) % 24) / 4)::INT AS bucket FROM (
  SELECT event_id, (epoch_us(ts) // 1000000)::DOUBLE AS s FROM events)""")
def feat_hour_cycle(spark, d):
    s = F.unix_seconds(C("ts").cast("timestamp")).cast("double")
    return table(spark, d, "events").select("event_id", F.round(S.hour_of_day(s), 6).alias("hour_cycle"), S.hour_bucket(s).alias("bucket"))


@query("feat_calendar", """SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, month(ts)::INT AS month FROM events""")
def feat_calendar(spark, d):
    return table(spark, d, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.month("ts").alias("month"))


@query("feat_circular", """SELECT event_id, round(sin(radians(coalesce(g, 0))), 6) + 0.0 AS dir_sin, round(cos(radians(coalesce(g, 0))), 6) + 0.0 AS dir_cos
  FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS g FROM events)""")
def feat_circular(spark, d):
    s, c = S.circular(F.when(C("event_id") % 7 != 0, C("value")))
    return table(spark, d, "events").select("event_id", (F.round(s, 6) + 0.0).alias("dir_sin"), (F.round(c, 6) + 0.0).alias("dir_cos"))


@query("feat_cross_key", """SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority AS status_priority,
  10 * (o_orderkey % 5) + month(o_orderdate) AS code_cross FROM orders""")
def feat_cross_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.cross_key("o_orderstatus", "o_orderpriority").alias("status_priority"),
                                            (10 * (C("o_orderkey") % 5) + F.month("o_orderdate")).alias("code_cross"))


@query("feat_combo_keys", """WITH k AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, month(o_orderdate)::VARCHAR AS m FROM orders),
  u AS (SELECT o_orderkey, 's' AS combo, s AS key FROM k UNION ALL SELECT o_orderkey, 'p', p FROM k UNION ALL SELECT o_orderkey, 'm', m FROM k
  UNION ALL SELECT o_orderkey, 's+p', s || chr(31) || p FROM k UNION ALL SELECT o_orderkey, 's+m', s || chr(31) || m FROM k
  UNION ALL SELECT o_orderkey, 'p+m', p || chr(31) || m FROM k UNION ALL SELECT o_orderkey, 's+p+m', s || chr(31) || p || chr(31) || m FROM k)
  SELECT combo, key, count(*) AS n FROM u GROUP BY 1, 2""")
def feat_combo_keys(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", C("o_orderstatus").alias("s"), C("o_orderpriority").alias("p"), F.month("o_orderdate").alias("m"))
    long = S.combo_keys(o, ["o_orderkey"], S.combos(["s", "p", "m"], 1, 3))
    return long.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n"))


@query("feat_groups", f"""SELECT {LINE}, l_quantity + l_linenumber AS npk_sum, l_quantity - l_linenumber AS n_minus_p,
  l_quantity * l_tax AS temp_x_moisture FROM lineitem""")
def feat_groups(spark, d):
    g = S.FeatureGroups()
    g.add("sums", lambda: {"npk_sum": C("l_quantity") + C("l_linenumber"), "n_minus_p": C("l_quantity") - C("l_linenumber")})
    g.add("env", lambda: {"temp_x_moisture": C("l_quantity") * C("l_tax")})
    g.add("unused", lambda: {"never": F.lit(1)})
    use = ["sums", "env"]
    return g.apply(table(spark, d, "lineitem"), use).select("l_orderkey", "l_partkey", "l_linenumber", *g.columns(use))


@query("flt_rule_outliers", f"""SELECT {LINE}, {split_sql('l_orderkey')} AS split FROM lineitem
  WHERE NOT (l_orderkey % 5 < 4 AND l_quantity > 40 AND l_extendedprice < 50000)""")
def flt_rule_outliers(spark, d):
    l = lines(spark, d, "l_quantity", "l_extendedprice", split_col("l_orderkey").alias("split"))
    rule = (C("split") == "train") & (C("l_quantity") > 40) & (C("l_extendedprice") < 50000)
    return S.drop_outliers(l, rule).select("l_orderkey", "l_partkey", "l_linenumber", "split")


@query("flt_drop_columns", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def flt_drop_columns(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", F.lit(1).alias("constant"),
                                           C("l_extendedprice").alias("leaky"))
    flat = S.near_constant_columns(l, ["l_quantity", "l_returnflag", "constant"], 0.99)
    return l.drop("leaky", *flat)


@query("flt_split", f"""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (SELECT *, {split_sql('l_orderkey')} AS split FROM lineitem) WHERE split = 'test'""")
def flt_split(spark, d):
    return lines(spark, d, "l_quantity", split_col("l_orderkey").alias("split")).filter("split = 'test'").drop("split")


@query("feat_split_xy", """SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS y, o_totalprice, o_orderpriority FROM orders""")
def feat_split_xy(spark, d):
    o = table(spark, d, "orders")
    x = o.drop("o_orderstatus", "o_custkey", "o_orderdate").withColumnRenamed("o_orderkey", "row_id")
    y = o.select(C("o_orderkey").alias("row_id"), flag(C("o_orderstatus") == "F").alias("y"))
    return x.join(y, "row_id")


@query("flt_isin_entities", """SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY 1 LIMIT 20)""")
def flt_isin_entities(spark, d):
    return S.first_entities(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", 20)


@query("flt_min_support", """SELECT user_id, count(*) AS n, round(avg((event_type = 'error')::INT), 8) AS rate FROM events GROUP BY 1 HAVING count(*) >= 65""")
def flt_min_support(spark, d):
    out = S.min_support(table(spark, d, "events"), "user_id", flag(C("event_type") == "error"), 65)
    return out.withColumn("rate", F.round("rate", 8))


@query("feat_clip_range", f"""SELECT {LINE}, CASE WHEN l_quantity < 5 THEN 5.0 WHEN l_quantity > 45 THEN 45.0 ELSE l_quantity END AS clipped FROM lineitem""")
def feat_clip_range(spark, d):
    return lines(spark, d, clip("l_quantity", 5.0, 45.0).alias("clipped"))
