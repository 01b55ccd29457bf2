"""Queries of the aggregation section. Money is carried in whole cents so that sums are exact."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.expr import flag, row_count
from loomwright.operators import history as H
from loomwright.queries.fixtures import PRIORITIES
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
CUT = "2002-01-01"


def rounded(df, digits=6):
    """Doubles to fixed digits; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else C(f.name)
        for f in df.schema.fields])


def rounded_ratios(df):
    """Fixed digits for statistics of ratios; means of whole numbers are exact as they are."""
    return df.select(*[
        (F.round(c, 6) + 0.0).alias(c) if any(r.upper() in c for r in _R) else C(c) for c in df.columns])


def cents(c):
    return F.round(C(c) * 100).cast("long")


def days(c):
    return F.datediff(C(c), F.lit(CUT).cast("date")).cast("long")


def loans(spark, d):
    o = table(spark, d, "orders").select(
        C("o_custkey").alias("client"), C("o_orderkey").alias("loan"), days("o_orderdate").alias("days_credit"),
        (C("o_orderkey") % 4).alias("overdue_days"), (days("o_orderdate") + C("o_orderkey") % 90).alias("days_enddate"),
        cents("o_totalprice").alias("credit"), (cents("o_totalprice") % 10000).alias("debt"),
        F.when(C("o_orderstatus") == "F", "Closed").otherwise("Active").alias("status"))
    return H.loan_columns(o)


def previous(spark, d):
    o = table(spark, d, "orders").select(
        C("o_custkey").alias("client"), cents("o_totalprice").alias("application"),
        (cents("o_totalprice") - C("o_orderkey") % 1000).alias("credit"), days("o_orderdate").alias("days_decision"),
        F.when(C("o_orderkey") % 11 == 0, 365243).otherwise(days("o_orderdate") + 30).cast("long").alias("days_first_due"),
        F.when(C("o_orderpriority") == "1-URGENT", "Approved").when(C("o_orderpriority") == "5-LOW", "Refused").otherwise("Other").alias("status"))
    return H.previous_columns(o, 365243)


def balances(spark, d):
    return table(spark, d, "lineitem").select(
        C("l_orderkey").alias("loan"), (-C("l_linenumber")).cast("long").alias("months"),
        (C("l_returnflag") == "R").alias("delinquent"), ((C("l_returnflag") == "R") & (C("l_linestatus") == "F")).alias("severe"))


def lines(spark, d):
    o = table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_custkey").alias("client"),
                                         days("o_orderdate").alias("opened"), cents("o_totalprice").alias("credit_limit"))
    l = table(spark, d, "lineitem").join(o, "l_orderkey")
    price = cents("l_extendedprice")
    return H.line_columns(l.select(
        "client", "credit_limit", (-C("l_linenumber")).cast("long").alias("months"), C("l_quantity").cast("long").alias("instalments"),
        F.when(C("l_returnflag") == "R", C("l_linenumber")).otherwise(0).cast("long").alias("dpd"),
        F.when(C("l_linestatus") == "O", "Active").otherwise("Done").alias("line_status"), price.alias("balance"),
        (C("l_quantity").cast("long") * 770000).alias("min_due"), C("l_linenumber").cast("long").alias("number"),
        (C("opened") + 60).alias("days_due"), days("l_shipdate").alias("days_paid"), (price * 100).alias("due"),
        (price * (100 - F.round(C("l_discount") * 100).cast("long"))).alias("paid")))


def _s(cols, prefix, stats=("mean", "min", "max", "sum"), ratios=()):
    out = []
    for c in cols:
        for s in stats:
            name = f'"{prefix}_{c}_{s}"'.upper()
            if s == "mean":
                out.append(f"round(avg({c}), 6) + 0.0 AS {name}" if c in ratios else f"avg({c}) AS {name}")
            elif s == "sum":
                out.append(f"round(coalesce(sum({c}), 0), 6) + 0.0 AS {name}" if c in ratios else f"coalesce(sum({c}), 0)::BIGINT AS {name}")
            else:
                out.append(f"round({s}({c}), 6) + 0.0 AS {name}" if c in ratios else f"{s}({c}) AS {name}")
    return ", ".join(out)


_LOANS = f"""(SELECT o_custkey AS client, o_orderkey AS loan, date_diff('day', DATE '{CUT}', o_orderdate::DATE) AS days_credit, o_orderkey % 4 AS overdue_days,
  date_diff('day', DATE '{CUT}', o_orderdate::DATE) + o_orderkey % 90 AS days_enddate, round(o_totalprice * 100)::BIGINT AS credit, round(o_totalprice * 100)::BIGINT % 10000 AS debt,
  (o_orderstatus <> 'F')::INT AS is_active, (o_orderstatus = 'F')::INT AS is_closed, (o_orderkey % 4 > 0)::INT AS has_overdue,
  (round(o_totalprice * 100)::BIGINT % 10000)::DOUBLE / nullif(round(o_totalprice * 100), 0) AS debt_credit_ratio FROM orders)"""
_PREV = f"""(SELECT *, credit::DOUBLE / nullif(application, 0) AS credit_application_ratio FROM (SELECT o_custkey AS client, round(o_totalprice * 100)::BIGINT AS application,
  round(o_totalprice * 100)::BIGINT - o_orderkey % 1000 AS credit, date_diff('day', DATE '{CUT}', o_orderdate::DATE) AS days_decision,
  CASE WHEN o_orderkey % 11 <> 0 THEN date_diff('day', DATE '{CUT}', o_orderdate::DATE) + 30 END AS days_first_due,
  (o_orderpriority = '1-URGENT')::INT AS approved, (o_orderpriority = '5-LOW')::INT AS refused FROM orders))"""
_LINES = f"""(SELECT *, (days_late > 0)::INT AS is_late, (shortfall > 0)::INT AS is_short FROM (SELECT *, (dpd > 0)::INT AS is_delinquent,
  balance::DOUBLE / nullif(credit_limit, 0) AS balance_limit_ratio, paid::DOUBLE / nullif(min_due, 0) AS payment_min_ratio,
  CASE WHEN days_paid - days_due < 0 THEN 0 ELSE days_paid - days_due END AS days_late, CASE WHEN due - paid < 0 THEN 0 ELSE due - paid END AS shortfall,
  paid::DOUBLE / nullif(due, 0) AS payment_ratio FROM (SELECT o_custkey AS client, round(o_totalprice * 100)::BIGINT AS credit_limit, -l_linenumber::BIGINT AS months,
  l_quantity::BIGINT AS instalments, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END::BIGINT AS dpd, (l_linestatus = 'O')::INT AS is_active,
  round(l_extendedprice * 100)::BIGINT AS balance, l_quantity::BIGINT * 770000 AS min_due, l_linenumber::BIGINT AS number,
  date_diff('day', DATE '{CUT}', o_orderdate::DATE) + 60 AS days_due, date_diff('day', DATE '{CUT}', l_shipdate::DATE) AS days_paid,
  round(l_extendedprice * 100)::BIGINT * 100 AS due, round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))"""
_R = {"debt_credit_ratio", "credit_application_ratio", "balance_limit_ratio", "payment_min_ratio", "payment_ratio", "bb_delinquent_rate", "bb_severe_rate"}
_BUREAU = f"""SELECT client, {_s(H.LOAN_NUMERIC, 'BUREAU', ratios=_R)}, count(*) AS "BUREAU_RECORD_COUNT",
  {_s(['is_active', 'is_closed', 'has_overdue', 'debt_credit_ratio'], 'BUREAU', ('mean', 'max'), _R)} FROM {_LOANS} GROUP BY 1"""
_BB = f"""SELECT client, {_s(['bb_months_count'], 'BUREAU', ('mean', 'max', 'sum'))}, {_s(['bb_months_min'], 'BUREAU', ('min',))},
  {_s(['bb_delinquent_rate', 'bb_severe_rate'], 'BUREAU', ('mean', 'max'), _R)} FROM (SELECT l_orderkey, count(*) AS bb_months_count, min(-l_linenumber)::BIGINT AS bb_months_min,
  avg((l_returnflag = 'R')::INT) AS bb_delinquent_rate, avg((l_returnflag = 'R' AND l_linestatus = 'F')::INT) AS bb_severe_rate FROM lineitem GROUP BY 1)
  JOIN {_LOANS} ON loan = l_orderkey GROUP BY 1"""
_PREVIOUS = f"""SELECT client, {_s(H.PREVIOUS_NUMERIC, 'PREV', ratios=_R)}, count(*) AS "PREV_RECORD_COUNT", {_s(['approved', 'refused'], 'PREV', ('mean', 'sum'))} FROM {_PREV} GROUP BY 1"""
_POS = f"""SELECT client, {_s(H.POS_NUMERIC, 'POS', ('mean', 'min', 'max'))}, count(*) AS "POS_RECORD_COUNT" FROM {_LINES} GROUP BY 1"""
_CARD = f"""SELECT client, {_s(H.CARD_NUMERIC, 'CC', ratios=_R)}, count(*) AS "CC_RECORD_COUNT" FROM {_LINES} GROUP BY 1"""
_INSTAL = f"""SELECT client, {_s(H.INSTALMENT_NUMERIC, 'INSTAL', ratios=_R)}, count(*) AS "INSTAL_RECORD_COUNT" FROM {_LINES} GROUP BY 1"""


@query("agg_stats_wide", f"""SELECT l_orderkey, {_s(['l_quantity', 'cents'], 'LINE')} FROM (SELECT l_orderkey, l_quantity::BIGINT AS l_quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem) GROUP BY 1""")
def agg_stats_wide(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", C("l_quantity").cast("long").alias("l_quantity"), cents("l_extendedprice").alias("cents"))
    return rounded_ratios(l.groupBy("l_orderkey").agg(*H.stat_list(["l_quantity", "cents"], "LINE")))


@query("agg_record_count", 'SELECT o_custkey, count(*) AS "ORD_RECORD_COUNT" FROM orders GROUP BY 1')
def agg_record_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(H.record_count("ORD"))


@query("agg_bureau", f"SELECT * FROM ({_BUREAU}) LEFT JOIN ({_BB}) USING (client)")
def agg_bureau(spark, d):
    ln = loans(spark, d)
    base = H.aggregate_sets([H.loan_set(ln)], "client")[0]
    return rounded_ratios(base.join(H.balance_rollup(balances(spark, d), ln, "loan", "client"), "client", "left"))


@query("agg_two_level", _BB)
def agg_two_level(spark, d):
    return rounded_ratios(H.balance_rollup(balances(spark, d), loans(spark, d), "loan", "client"))


@query("agg_previous", _PREVIOUS)
def agg_previous(spark, d):
    return rounded_ratios(H.aggregate_sets([H.previous_set(previous(spark, d))], "client")[0])


@query("agg_pos_cash", _POS)
def agg_pos_cash(spark, d):
    return rounded_ratios(H.aggregate_sets([H.pos_set(lines(spark, d))], "client")[0])


@query("agg_credit_card", _CARD)
def agg_credit_card(spark, d):
    return rounded_ratios(H.aggregate_sets([H.card_set(lines(spark, d))], "client")[0])


@query("agg_installments", _INSTAL)
def agg_installments(spark, d):
    return rounded_ratios(H.aggregate_sets([H.instalment_set(lines(spark, d))], "client")[0])


@query("agg_history_features", f"""SELECT * FROM ({_BUREAU}) FULL JOIN ({_PREVIOUS}) USING (client) FULL JOIN ({_POS}) USING (client) FULL JOIN ({_CARD}) USING (client)
  FULL JOIN ({_INSTAL}) USING (client) FULL JOIN ({_BB}) USING (client)""")
def agg_history_features(spark, d):
    return rounded_ratios(H.history_features(loans(spark, d), balances(spark, d), previous(spark, d), lines(spark, d), "client", "loan"))


@query("agg_entity_rate", """SELECT count(*) AS n_entities, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate), 6) AS std_rate, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate,
  sum(positives)::BIGINT AS positives, sum(n)::BIGINT AS n FROM (SELECT user_id, avg((event_type = 'error')::INT) AS rate, sum((event_type = 'error')::INT) AS positives, count(*) AS n FROM events GROUP BY 1)""")
def agg_entity_rate(spark, d):
    per = H.entity_rate(table(spark, d, "events"), "user_id", flag(C("event_type") == "error"))
    return rounded(per.agg(row_count().alias("n_entities"), F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("std_rate"),
                           F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.sum("positives").alias("positives"), F.sum("n").alias("n")))


@query("agg_first_attr", "SELECT user_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY 1")
def agg_first_attr(spark, d):
    return H.first_attribute(table(spark, d, "events"), "user_id", "event_type", "ts")


_PIV = ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES)
_PIVS = ", ".join(f"(count(*) FILTER (l_returnflag = '{p}'))::DOUBLE / count(*) AS \"{p}\"" for p in "ANR")


@query("agg_crosstab", f"SELECT o_orderstatus, {_PIV} FROM orders GROUP BY 1")
def agg_crosstab(spark, d):
    return H.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)


@query("agg_pivot_share", f"SELECT l_suppkey, {_PIVS} FROM lineitem GROUP BY 1")
def agg_pivot_share(spark, d):
    return H.crosstab(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", list("ANR"), normalise=True)


@query("agg_distinct_groups", "SELECT count(*) AS n_groups FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)")
def agg_distinct_groups(spark, d):
    return H.distinct_groups(table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("agg_class_prior", "SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS prior FROM orders GROUP BY 1")
def agg_class_prior(spark, d):
    return H.class_prior(table(spark, d, "orders"), "o_orderpriority")


@query("agg_class_weights", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total, count(*) AS k FROM c)
  SELECT o_orderkey, o_orderstatus, n, total / (k * n)::DOUBLE AS balanced, 1.0::DOUBLE / n AS inverse, (total - n)::DOUBLE / n AS neg_over_pos FROM orders JOIN c USING (o_orderstatus), t""")
def agg_class_weights(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(H.class_weights(o, "o_orderstatus"), "o_orderstatus")


@query("agg_cooccurrence", """WITH r AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT * FROM r)
  SELECT a.p_brand AS label_a, b.p_brand AS label_b, count(*) AS n FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2""")
def agg_cooccurrence(spark, d):
    p = table(spark, d, "part").select(C("p_partkey").alias("l_partkey"), "p_brand")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")
    return H.cooccurrence(l, "l_orderkey", "p_brand")


@query("agg_label_cardinality", """SELECT n_labels, count(*) AS n_rows FROM (SELECT conv_id, count(DISTINCT role) AS n_labels FROM conversations GROUP BY 1) GROUP BY 1""")
def agg_label_cardinality(spark, d):
    return H.label_cardinality(table(spark, d, "conversations"), "conv_id", "role")


_CELLS = """(SELECT vec_id, ((i - 1) // 8)::INT AS frame, ((i - 1) % 8)::INT AS coef, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i))"""


def cells(spark, d):
    return H.frame_cells(table(spark, d, "embeddings"), "vec_id", 8, 8)


@query("agg_frame_moments", f"""SELECT vec_id, coef, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi,
  round(ln(1 + count(*)), 6) AS log_n, round(quantile_cont(x, 0.5), 6) + 0.0 AS median FROM {_CELLS} GROUP BY 1, 2""")
def agg_frame_moments(spark, d):
    return rounded(H.frame_moments(cells(spark, d), "vec_id"))


@query("agg_frame_delta", f"""SELECT vec_id, coef, round(avg(dx), 6) + 0.0 AS delta_mean, round(stddev_pop(dx), 6) + 0.0 AS delta_std FROM
  (SELECT vec_id, coef, x - lag(x) OVER (PARTITION BY vec_id, coef ORDER BY frame) AS dx FROM {_CELLS}) GROUP BY 1, 2""")
def agg_frame_delta(spark, d):
    return rounded(H.frame_deltas(cells(spark, d), "vec_id"))


@query("agg_frame_pctl", f"""SELECT vec_id, coef, round(quantile_cont(x, 0.1), 6) + 0.0 AS p10, round(quantile_cont(x, 0.9), 6) + 0.0 AS p90 FROM {_CELLS} GROUP BY 1, 2""")
def agg_frame_pctl(spark, d):
    return rounded(H.frame_percentiles(cells(spark, d), "vec_id"))


@query("agg_frame_count", f"SELECT vec_id, count(DISTINCT frame) AS n_frames FROM {_CELLS} GROUP BY 1")
def agg_frame_count(spark, d):
    return H.frame_count(cells(spark, d), "vec_id")
