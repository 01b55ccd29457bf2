"""Queries of the missing-value and encoder sections."""

from pyspark.sql import functions as F

from loomwright.functions.expr import flag
from loomwright.operators import encode as E
from loomwright.operators import missing as M
from loomwright.queries.fixtures import (
    LINEITEM_NULLED, ORDERS_NULLED, PART_NULLED, PRIORITIES, lineitem_nulled, orders_nulled, part_nulled, split_col,
)
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
ORDER_CODES = {p: i for i, p in enumerate(PRIORITIES)}
LINE = "l_orderkey, l_partkey, l_linenumber"
LINE_COLS = ["l_orderkey", "l_partkey", "l_linenumber"]


@query("na_sentinel_flag", """SELECT event_id, nullif(cloud, 255) AS cloud, (cloud = 255)::INT AS cloud_missing FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 255 ELSE value END AS cloud FROM events)""")
def na_sentinel_flag(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(C("event_id") % 11 == 0, 255.0).otherwise(C("value")).alias("cloud"))
    return M.flag_sentinel(e, "cloud", 255.0, "cloud_missing")


@query("na_sentinel_multi", f"""SELECT {LINE}, nullif(l_quantity, 50) AS l_quantity, nullif(l_tax * 100, 50) AS tax_points FROM
  (SELECT {LINE}, l_quantity, CASE WHEN l_orderkey % 11 = 0 THEN 0.5 ELSE l_tax END AS l_tax FROM lineitem)""")
def na_sentinel_multi(spark, d):
    l = table(spark, d, "lineitem").select(
        *LINE_COLS, "l_quantity", (F.when(C("l_orderkey") % 11 == 0, 0.5).otherwise(C("l_tax")) * 100).alias("tax_points"))
    return M.null_sentinels(l, ["l_quantity", "tax_points"], 50.0)


@query("na_conditional_fill", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice,
  coalesce(o_orderstatus = 'P', false)::INT AS not_applicable FROM {ORDERS_NULLED}""")
def na_conditional_fill(spark, d):
    o = orders_nulled(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return M.fill_not_applicable(o, "o_totalprice", C("o_orderstatus") == "P", 0.0, "not_applicable").drop("o_orderstatus")


@query("na_recode_levels", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Unknown' WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 'Closed' ELSE o_orderstatus END AS o_orderstatus FROM {ORDERS_NULLED}""")
def na_recode_levels(spark, d):
    o = orders_nulled(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return M.recode(o, {"o_orderpriority": {"4-NOT SPECIFIED": "Unknown", "5-LOW": "LOW"}, "o_orderstatus": {"F": "Closed"}})


@query("na_fill_none_zero", f"""SELECT p_partkey, coalesce(p_brand, 'None') AS p_brand, coalesce(p_type, 'None') AS p_type, coalesce(p_size, 0) AS p_size FROM {PART_NULLED}""")
def na_fill_none_zero(spark, d):
    return M.fill_constants(part_nulled(spark, d).drop("p_retailprice"), ["p_brand", "p_type"], ["p_size"])


@query("na_fill_token", f"SELECT o_orderkey, coalesce(o_orderpriority, '__MISSING__') AS o_orderpriority, coalesce(o_orderstatus, '__MISSING__') AS o_orderstatus FROM {ORDERS_NULLED}")
def na_fill_token(spark, d):
    return M.fill_constants(orders_nulled(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus"),
                            ["o_orderpriority", "o_orderstatus"], token="__MISSING__")


@query("na_indicator", f"SELECT o_orderkey, (o_totalprice IS NULL)::INT AS o_totalprice_isna, (o_orderpriority IS NULL)::INT AS o_orderpriority_isna FROM {ORDERS_NULLED}")
def na_indicator(spark, d):
    o = M.add_indicators(orders_nulled(spark, d), ["o_totalprice", "o_orderpriority"])
    return o.select("o_orderkey", "o_totalprice_isna", "o_orderpriority_isna")


@query("na_impute_median", f"""SELECT {LINE}, coalesce(l_quantity, mq) AS l_quantity, coalesce(l_extendedprice, me) AS l_extendedprice,
  (l_quantity IS NULL)::INT AS l_quantity_isna, (l_extendedprice IS NULL)::INT AS l_extendedprice_isna
  FROM {LINEITEM_NULLED}, (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS me FROM {LINEITEM_NULLED} WHERE l_orderkey % 5 < 4)""")
def na_impute_median(spark, d):
    l = lineitem_nulled(spark, d).select(*LINE_COLS, "l_quantity", "l_extendedprice")
    stage = M.median_imputer(["l_quantity", "l_extendedprice"]).fit(l.filter(split_col("l_orderkey") == "train"))
    return stage.apply(l)


@query("na_impute_group_median", f"""WITH x AS (SELECT {LINE}, p_brand, e.l_extendedprice FROM {LINEITEM_NULLED} e JOIN part ON l_partkey = p_partkey)
  SELECT {LINE}, p_brand, coalesce(l_extendedprice, m, (SELECT quantile_cont(l_extendedprice, 0.5) FROM x)) AS l_extendedprice
  FROM x LEFT JOIN (SELECT p_brand, quantile_cont(l_extendedprice, 0.5) AS m FROM x GROUP BY 1) USING (p_brand)""")
def na_impute_group_median(spark, d):
    l = lineitem_nulled(spark, d).select(*LINE_COLS, "l_extendedprice")
    p = table(spark, d, "part").select(C("p_partkey").alias("l_partkey"), "p_brand")
    return M.impute_group_median(l.join(p, "l_partkey"), "p_brand", "l_extendedprice")


@query("na_impute_mode", f"""WITH x AS (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM {ORDERS_NULLED}),
  p AS (SELECT o_orderpriority AS v FROM x WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  s AS (SELECT o_orderstatus AS v FROM x WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM p)) AS o_orderpriority, coalesce(o_orderstatus, (SELECT v FROM s)) AS o_orderstatus FROM x""")
def na_impute_mode(spark, d):
    o = orders_nulled(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return M.mode_imputer(["o_orderpriority", "o_orderstatus"]).fit(o).apply(o)


@query("na_implied_bool", """SELECT c_custkey, coalesce(CASE WHEN sleep IS NULL AND spend > 0 THEN false ELSE sleep END, false) AS sleep,
  coalesce(vip, false) AS vip FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey < 12 END AS sleep, c_acctbal AS spend,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment = 'BUILDING' END AS vip FROM customer)""")
def na_implied_bool(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(C("c_custkey") % 3 != 0, C("c_nationkey") < 12).alias("sleep"), C("c_acctbal").alias("spend"),
        F.when(C("c_custkey") % 4 != 0, C("c_mktsegment") == "BUILDING").alias("vip"))
    return c.select("c_custkey", M.infer_bool("sleep", C("spend")).alias("sleep"), F.coalesce("vip", F.lit(False)).alias("vip"))


@query("na_nonfinite", """SELECT vec_id, (i - 1)::INT AS pos, CASE WHEN vec_id % 3 = 0 AND i % 2 = 0 THEN 0.0 WHEN vec_id % 3 = 1 AND i % 5 = 0 THEN 0.0 ELSE embedding[i]::DOUBLE END AS x
  FROM embeddings, range(1, 65) t(i)""")
def na_nonfinite(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    i = C("pos") + 1
    dirty = (F.when((C("vec_id") % 3 == 0) & (i % 2 == 0), F.lit(float("nan")))
             .when((C("vec_id") % 3 == 1) & (i % 5 == 0), F.lit(float("-inf"))).otherwise(C("x").cast("double")))
    return e.select("vec_id", "pos", M.finite_or(dirty).alias("x"))


@query("skew_fit_log", """WITH f AS (SELECT *, l_extendedprice * l_extendedprice AS price_sq FROM lineitem), s AS (
  SELECT abs(skewness(l_quantity) ) > 0.5 AND min(l_quantity) >= 0 AND count(DISTINCT l_quantity) > 10 AS q,
  abs(skewness(price_sq)) > 0.5 AND min(price_sq) >= 0 AND count(DISTINCT price_sq) > 10 AS p FROM f WHERE l_orderkey % 5 < 4)
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, price_sq, round(ln(1 + price_sq), 8) AS "LOG1P_price_sq" FROM f, s WHERE p AND NOT q""")
def skew_fit_log(spark, d):
    l = table(spark, d, "lineitem").select(*LINE_COLS, "l_quantity", (C("l_extendedprice") * C("l_extendedprice")).alias("price_sq"))
    stage = M.skew_log(["l_quantity", "price_sq"], 0.5).fit(l.filter(split_col("l_orderkey") == "train"))
    return stage.apply(l).withColumn("LOG1P_price_sq", F.round("LOG1P_price_sq", 8))


@query("cast_codes", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part")
def cast_codes(spark, d):
    return M.cast_codes(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"])


@query("enc_ordinal_map", f"""SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 0 END, -1) AS code FROM {ORDERS_NULLED}""")
def enc_ordinal_map(spark, d):
    order = {"5-LOW": 0, "3-MEDIUM": 1, "2-HIGH": 2, "1-URGENT": 3}
    return orders_nulled(spark, d).select("o_orderkey", E.ordinal("o_orderpriority", order).alias("code"))


@query("enc_label", "SELECT o_orderkey, left(o_orderpriority, 1)::INT - 1 AS code, o_orderpriority AS name FROM orders")
def enc_label(spark, d):
    o = E.encode_label(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES, "code")
    return o.select("o_orderkey", "code", E.decode_label("code", PRIORITIES).alias("name"))


@query("enc_code_remap", """SELECT p_partkey, p_size % 4 + 1 AS pain_type, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 7 END AS scan_code,
  CASE WHEN p_type = 'PROMO' THEN 'Presence' ELSE 'Absence' END AS target FROM part""")
def enc_code_remap(spark, d):
    from loomwright.functions.expr import map_value

    return table(spark, d, "part").select(
        "p_partkey", (C("p_size") % 4 + 1).alias("pain_type"), map_value(C("p_size") % 3, {0: 3, 1: 6, 2: 7}).alias("scan_code"),
        map_value(flag(C("p_type") == "PROMO"), {1: "Presence", 0: "Absence"}).alias("target"))


@query("enc_level_union", """WITH lv AS (SELECT DISTINCT v FROM (SELECT c_nationkey::VARCHAR || 'x' AS v FROM customer UNION ALL SELECT s_nationkey::VARCHAR || 'x' FROM supplier)),
  code AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS code FROM lv)
  SELECT s_suppkey AS id, code FROM supplier JOIN code ON v = s_nationkey::VARCHAR || 'x'""")
def enc_level_union(spark, d):
    c = table(spark, d, "customer").select(F.concat(C("c_nationkey").cast("string"), F.lit("x")).alias("level"))
    s = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), F.concat(C("s_nationkey").cast("string"), F.lit("x")).alias("level"))
    return s.join(E.level_union([(c, "level"), (s, "level")]), "level").select("id", "code")


def _onehot_sql(levels, cols="o_orderkey", src="orders", extra=""):
    flags = ", ".join(f"coalesce(o_orderpriority = '{p}', false)::INT AS \"o_orderpriority_{p}\"" for p in levels)
    return f"SELECT {cols}, {flags}{extra} FROM {src}"


@query("enc_onehot", _onehot_sql(PRIORITIES))
def enc_onehot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.onehot("o_orderpriority").fit(o.filter(split_col("o_orderkey") == "train")).apply(o).drop("o_orderpriority")


@query("enc_onehot_aligned", _onehot_sql(PRIORITIES[1:], src="(SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 = 0 THEN 'NEW' ELSE o_orderpriority END AS o_orderpriority) FROM orders)"))
def enc_onehot_aligned(spark, d):
    unseen = (C("o_orderkey") % 5 == 4) & (C("o_orderkey") % 3 == 0)
    o = table(spark, d, "orders").select("o_orderkey", F.when(unseen, "NEW").otherwise(C("o_orderpriority")).alias("o_orderpriority"))
    return E.onehot("o_orderpriority", drop_first=True).fit(o.filter(split_col("o_orderkey") == "train")).apply(o).drop("o_orderpriority")


@query("enc_onehot_na", _onehot_sql(PRIORITIES, src=ORDERS_NULLED, extra=', (o_orderpriority IS NULL)::INT AS "o_orderpriority_nan"'))
def enc_onehot_na(spark, d):
    o = orders_nulled(spark, d).select("o_orderkey", "o_orderpriority")
    return E.onehot("o_orderpriority", missing_level=True).fit(o).apply(o).drop("o_orderpriority")


@query("enc_onehot_sparse", """WITH p AS (SELECT DISTINCT l_partkey::VARCHAR AS v FROM lineitem WHERE l_orderkey % 5 < 4), f AS (SELECT DISTINCT l_returnflag AS v FROM lineitem WHERE l_orderkey % 5 < 4),
  a AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS place FROM p), b AS (SELECT v, ((SELECT count(*) FROM p) + row_number() OVER (ORDER BY v) - 1)::INT AS place FROM f)
  SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, ((SELECT count(*) FROM p) + (SELECT count(*) FROM f))::INT AS size, a.place AS part_place, b.place AS flag_place
  FROM lineitem l LEFT JOIN a ON a.v = l.l_partkey::VARCHAR LEFT JOIN b ON b.v = l.l_returnflag""")
def enc_onehot_sparse(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    out = E.sparse_onehot(["l_partkey", "l_returnflag"]).fit(l.filter(split_col("l_orderkey") == "train")).apply(l)
    n_flags = 3
    flag_place = F.get(F.filter("onehot.indices", lambda p: p >= C("onehot.size") - n_flags), F.lit(0))
    part_place = F.get(F.filter("onehot.indices", lambda p: p < C("onehot.size") - n_flags), F.lit(0))
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", C("onehot.size").alias("size"), part_place.alias("part_place"), flag_place.alias("flag_place"))


@query("enc_onehot_to_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code FROM orders")
def enc_onehot_to_label(spark, d):
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", *[flag(C("o_orderstatus") == s).alias(f"winner_{s}") for s in "FOP"])
    return o.select("o_orderkey", E.onehot_to_code(["winner_F", "winner_O", "winner_P"]).alias("code"))


@query("scale_standard", f"""SELECT {LINE}, round((l_quantity - mq) / sq, 7) + 0.0 AS l_quantity, round((l_extendedprice - me) / se, 7) + 0.0 AS l_extendedprice FROM lineitem,
  (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem WHERE l_orderkey % 5 < 4)""")
def scale_standard(spark, d):
    l = table(spark, d, "lineitem").select(*LINE_COLS, "l_quantity", "l_extendedprice")
    out = E.standard_scaler(["l_quantity", "l_extendedprice"]).fit(l.filter(split_col("l_orderkey") == "train")).apply(l)
    return out.withColumns({c: F.round(c, 7) + 0.0 for c in ("l_quantity", "l_extendedprice")})


@query("scale_robust", f"""SELECT {LINE}, (l_extendedprice - m) / (q3 - q1) AS l_extendedprice, l_quantity FROM lineitem,
  (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE l_orderkey % 5 < 4)""")
def scale_robust(spark, d):
    l = table(spark, d, "lineitem").select(*LINE_COLS, "l_quantity", "l_extendedprice")
    return E.robust_scaler(["l_extendedprice"]).fit(l.filter(split_col("l_orderkey") == "train")).apply(l)


@query("scale_minmax", "SELECT event_id, (value - lo) / (hi - lo) AS value, 0.0::DOUBLE AS constant FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def scale_minmax(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.lit(3.0).alias("constant"))
    return E.minmax_scaler(["value", "constant"]).fit(e).apply(e)


@query("scale_zscore_index", f"""SELECT {LINE}, round((l_extendedprice - me) / se + (l_tax - mt) / st - (l_quantity - mq) / sq, 6) + 0.0 AS aridity FROM lineitem,
  (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE l_orderkey % 5 < 4)""")
def scale_zscore_index(spark, d):
    l = table(spark, d, "lineitem").select(*LINE_COLS, "l_quantity", "l_extendedprice", "l_tax")
    st = E.zscore_index(["l_extendedprice", "l_tax"], ["l_quantity"], "aridity").fit(l.filter(split_col("l_orderkey") == "train"))
    return st.apply(l).select(*LINE_COLS, (F.round("aridity", 6) + 0.0).alias("aridity"))


_SEG = {"BUILDING": 0, "MACHINERY": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "AUTOMOBILE": 4}


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", (C("c_nationkey") % 3).cast("string").alias("zone"))


_FAMILIES = """WITH x AS (SELECT c_custkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS seg, c_nationkey % 3 AS zone FROM customer),
  f AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(seg) AS ms, stddev_pop(seg) AS ss FROM x WHERE c_custkey % 5 < 4)
  SELECT c_custkey, c_acctbal AS tree_balance, seg AS tree_segment, zone AS tree_zone, round((c_acctbal - ma) / sa, 6) + 0.0 AS linear_balance, round((seg - ms) / ss, 6) + 0.0 AS linear_segment,
  (zone = 0)::INT AS zone_0, (zone = 1)::INT AS zone_1, (zone = 2)::INT AS zone_2 FROM x, f"""


@query("enc_pipeline", _FAMILIES)
@query("enc_family_chain", _FAMILIES)
def enc_family_chain(spark, d):
    c = _customers(spark, d)
    train = c.filter(split_col("c_custkey") == "train")
    tree = E.family_chain("tree", ["c_acctbal"], {"c_mktsegment": _SEG}, ["zone"]).fit(train).apply(c)
    lin = E.family_chain("linear", ["c_acctbal"], {"c_mktsegment": _SEG}, ["zone"]).fit(train).apply(c)
    tree = tree.select("c_custkey", C("c_acctbal").alias("tree_balance"), C("c_mktsegment").alias("tree_segment"), C("zone").alias("tree_zone"))
    lin = lin.select("c_custkey", (F.round("c_acctbal", 6) + 0.0).alias("linear_balance"), (F.round("c_mktsegment", 6) + 0.0).alias("linear_segment"),
                     "zone_0", "zone_1", "zone_2")
    return tree.join(lin, "c_custkey")


@query("enc_feature_names", """SELECT pos, name, n_rows FROM (VALUES (0, 'c_acctbal'), (1, 'c_mktsegment'), (2, 'zone_0'), (3, 'zone_1'), (4, 'zone_2')) t(pos, name), (SELECT count(*) AS n_rows FROM customer)""")
def enc_feature_names(spark, d):
    c = _customers(spark, d)
    names = E.family_chain("linear", ["c_acctbal"], {"c_mktsegment": _SEG}, ["zone"]).fit(c).feature_names(c, drop=["c_custkey"])
    return c.agg(F.count(F.lit(1)).alias("n_rows")).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "name"), "n_rows")
