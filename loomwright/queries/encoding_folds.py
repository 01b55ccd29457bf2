"""Queries of the target encoding and fold sections."""

from pyspark.sql import functions as F

from loomwright.functions.expr import flag
from loomwright.operators import folds as FO
from loomwright.operators import target_encoding as TE
from loomwright.operators.scalar import combo_keys, combos
from loomwright.plans.store import fresh_path, load_or_build
from loomwright.queries.fixtures import PRIORITIES, split_col
from loomwright.queries.history import rounded
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
K = 5
FEATURES = ["s", "m", "q"]
NAMES = ["s", "m", "q", "s+m", "s+q", "m+q", "s+m+q"]


def base(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        C("o_orderkey").alias("row_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"),
        split_col("o_orderkey").alias("split"), (C("o_orderkey") % 4).cast("int").alias("fold"), C("o_orderstatus").alias("s"),
        F.month("o_orderdate").alias("m"), F.floor(C("o_totalprice") / 50000).alias("q"), "o_totalprice")


BASE = """(SELECT o_orderkey AS row_id, left(o_orderpriority, 1)::INT - 1 AS y, CASE WHEN o_orderkey % 5 < 4 THEN 'train' ELSE 'test' END AS split, (o_orderkey % 4)::INT AS fold,
  o_orderstatus AS s, month(o_orderdate)::VARCHAR AS m, floor(o_totalprice / 50000)::BIGINT::VARCHAR AS q, o_totalprice FROM orders)"""


def long_rows(spark, d, keep=("y", "split", "fold")):
    return combo_keys(base(spark, d), ["row_id"], combos(FEATURES, 1, 3), keep)


LONG = "(" + " UNION ALL ".join(
    f"SELECT row_id, y, split, fold, '{n}' AS combo, concat_ws(chr(31), {', '.join(n.split('+'))}) AS key FROM {BASE}" for n in NAMES) + ")"
_S = ", ".join(f"count(*) FILTER (y = {c}) AS s{c}" for c in range(K))
_PRIOR_TRAIN = ", ".join(f"count(*) FILTER (y = {c}) / count(*)::DOUBLE AS p{c}" for c in range(K))
TABLE = f"(SELECT combo, key, count(*) AS n, {_S} FROM {LONG} WHERE split = 'train' GROUP BY 1, 2)"
PRIOR = f"(SELECT {_PRIOR_TRAIN} FROM {BASE} WHERE split = 'train')"


@query("te_bucket_table", f"SELECT combo, key, n, {', '.join(f's{c}' for c in range(K))} FROM {TABLE}")
def te_bucket_table(spark, d):
    return TE.bucket_table(long_rows(spark, d).filter("split = 'train'"), "y", K)


_GROUPS = [("s",), ("m",), ("q",), ("s", "m"), ("m", "q")]


def _smooth_sql():
    pr = f"(SELECT avg((y = 0)::INT) FROM {BASE} WHERE split = 'train')"
    cols, joins = [], []
    for i, g in enumerate(_GROUPS):
        cols.append(f"round(coalesce((t{i}.s + 20.3::DOUBLE * {pr}) / (t{i}.n + 20.3::DOUBLE), {pr}), 8) AS te_{'_'.join(g)}")
        on = " AND ".join(f"t{i}.{c}_ = b.{c}" for c in g)
        keys = ", ".join(f"{c} AS {c}_" for c in g)
        joins.append(f"LEFT JOIN (SELECT {keys}, sum((y = 0)::INT)::DOUBLE AS s, count(*) AS n FROM {BASE} WHERE split = 'train' GROUP BY {', '.join(g)}) t{i} ON {on}")
    return f"SELECT row_id, {', '.join(cols)} FROM {BASE} b {' '.join(joins)}"


@query("te_smooth_mean", _smooth_sql())
def te_smooth_mean(spark, d):
    b = base(spark, d).withColumn("hit", flag(C("y") == 0))
    out = TE.smooth_mean(b.filter("split = 'train'"), b, _GROUPS, "hit", 20.3)
    return rounded(out.select("row_id", *["te_" + "_".join(g) for g in _GROUPS]), 8)


def _enc_sql(expr, frm, where="", cols="l.row_id, l.combo"):
    return f"SELECT {cols}, " + ", ".join(f"round({expr.format(c=c)}, 8) AS te{c}" for c in range(K)) + f" FROM {frm} {where}"


def _te(df):
    return rounded(df.select("row_id", "combo", *[f"te{c}" for c in range(K)]), 8)


_LOO = "coalesce((s{c} - (y = {c})::INT + 10.7::DOUBLE * p{c}) / nullif(n - 1 + 10.7::DOUBLE, 0), p{c})"
_LOOK = "coalesce((s{c} + 10.7::DOUBLE * p{c}) / (n + 10.7::DOUBLE), p{c})"


@query("te_loo", _enc_sql(_LOO, f"{LONG} l JOIN {TABLE} t USING (combo, key), {PRIOR}", "WHERE split = 'train'"))
def te_loo(spark, d):
    tr = long_rows(spark, d).filter("split = 'train'")
    prior = TE.prior_of(base(spark, d).filter("split = 'train'"), "y", K)
    return _te(TE.leave_one_out(tr, "y", 10.7, prior, K))


@query("te_lookup", _enc_sql(_LOOK, f"{LONG} l LEFT JOIN {TABLE} t USING (combo, key), {PRIOR}", "WHERE split = 'test'"))
def te_lookup(spark, d):
    long = long_rows(spark, d)
    prior = TE.prior_of(base(spark, d).filter("split = 'train'"), "y", K)
    return _te(TE.lookup(long.filter("split = 'test'"), TE.bucket_table(long.filter("split = 'train'"), "y", K), 10.7, prior, K))


@query("te_combo_multi", _enc_sql("CASE WHEN split = 'train' THEN " + _LOO + " ELSE " + _LOOK + " END",
                                  f"{LONG} l LEFT JOIN {TABLE} t USING (combo, key), {PRIOR}"))
def te_combo_multi(spark, d):
    return _te(TE.loo_and_lookup(long_rows(spark, d), "y", 10.7, K, C("split") == "train"))


_FOLDT = f"(SELECT combo, key, fold, count(*) AS fn, {', '.join(f'count(*) FILTER (y = {c}) AS f{c}' for c in range(K))} FROM {LONG} WHERE split = 'train' GROUP BY 1, 2, 3)"


@query("te_kfold_oof", _enc_sql("coalesce((s{c} - CASE WHEN split = 'train' THEN f{c} ELSE 0 END + 5.3::DOUBLE * p{c}) / (n - CASE WHEN split = 'train' THEN fn ELSE 0 END + 5.3::DOUBLE), p{c})",
                                f"{LONG} l LEFT JOIN {TABLE} t USING (combo, key) LEFT JOIN {_FOLDT} f ON f.combo = l.combo AND f.key = l.key AND f.fold = l.fold, {PRIOR}"))
def te_kfold_oof(spark, d):
    long = long_rows(spark, d).withColumn("fold", F.when(C("split") == "train", C("fold")))
    prior = TE.prior_of(base(spark, d).filter("split = 'train'"), "y", K)
    return _te(TE.kfold_oof(long, "y", "fold", 5.3, prior, K))


@query("te_external", """WITH e AS (SELECT o_custkey AS key, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS s FROM orders GROUP BY 1), p AS (SELECT avg((o_orderstatus = 'F')::INT) AS p FROM orders)
  SELECT c_custkey AS row_id, round(coalesce((s + 2.3::DOUBLE * p) / (n + 2.3::DOUBLE), p), 8) AS te0 FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_custkey END AS key FROM customer) LEFT JOIN e USING (key), p""")
def te_external(spark, d):
    ext = table(spark, d, "orders").select(F.lit("client").alias("combo"), C("o_custkey").cast("string").alias("key"),
                                           flag(C("o_orderstatus") != "F").alias("y"))
    rows = table(spark, d, "customer").select(C("c_custkey").alias("row_id"), F.lit("client").alias("combo"),
                                              F.when(C("c_custkey") % 10 == 0, "-1").otherwise(C("c_custkey").cast("string")).alias("key"))
    prior = TE.prior_of(ext, "y", 2)
    return rounded(TE.lookup(rows, TE.bucket_table(ext, "y", 2), 2.3, prior, 2).select("row_id", "te0"), 8)


@query("te_auto_smooth", f"""WITH l AS (SELECT row_id, combo, key, fold, (y = 0)::INT::DOUBLE AS y FROM {LONG} WHERE split = 'train'),
  own AS (SELECT combo, key, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY 1, 2, 3), tot AS (SELECT combo, key, sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM own GROUP BY 1, 2),
  bf AS (SELECT combo, fold, sum(n) AS fn, sum(s) AS fs, sum(q) AS fq FROM own GROUP BY 1, 2), ov AS (SELECT combo, sum(fn) AS an, sum(fs) AS asum, sum(fq) AS aq FROM bf GROUP BY 1),
  e AS (SELECT combo, key, fold, (tn - n)::DOUBLE AS n, ts - s AS s, tq - q AS q, (asum - fs) / (an - fn)::DOUBLE AS g, (aq - fq) / (an - fn)::DOUBLE - ((asum - fs) / (an - fn)::DOUBLE) ** 2 AS t2
    FROM own JOIN tot USING (combo, key) JOIN bf USING (combo, fold) JOIN ov USING (combo)),
  w AS (SELECT combo, key, fold, g, s / nullif(n, 0) AS mean, n * t2 / nullif(n * t2 + (q / nullif(n, 0) - (s / nullif(n, 0)) ** 2), 0) AS w FROM e)
  SELECT row_id, combo, round(coalesce(w * mean + (1 - w) * g, g), 8) AS te FROM l JOIN w USING (combo, key, fold)""")
def te_auto_smooth(spark, d):
    long = long_rows(spark, d).filter("split = 'train'").withColumn("y", flag(C("y") == 0))
    return rounded(TE.auto_smooth_oof(long, "y", "fold").select("row_id", "combo", "te"), 8)


_EDGE = "(SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 8}) AS e{i}" for i in range(1, 8)) + f" FROM {BASE} WHERE split = 'train')"
_BIN = " + ".join(f"(o_totalprice > e{i})::INT" for i in range(1, 8))
_BINNED = f"(SELECT row_id, y, split, s, {_BIN} AS b FROM {BASE}, {_EDGE})"


@query("te_binned", f"""WITH b AS {_BINNED}, p AS (SELECT avg((y = 0)::INT) AS p FROM b WHERE split = 'train'),
  k1 AS (SELECT b, count(*) AS n, sum((y = 0)::INT) AS h FROM b WHERE split = 'train' GROUP BY 1), k2 AS (SELECT s, b, count(*) AS n, sum((y = 0)::INT) AS h FROM b WHERE split = 'train' GROUP BY 1, 2)
  SELECT row_id, b::INT AS o_totalprice_bin, round(coalesce((k1.h + 20.3::DOUBLE * p) / (k1.n + 20.3::DOUBLE), p), 8) AS te_o_totalprice_bin, round(coalesce((k2.h + 20.3::DOUBLE * p) / (k2.n + 20.3::DOUBLE), p), 8) AS te_s_o_totalprice_bin
  FROM b LEFT JOIN k1 USING (b) LEFT JOIN k2 USING (s, b), p""")
def te_binned(spark, d):
    b = base(spark, d).withColumn("hit", flag(C("y") == 0))
    binned = TE.quantile_bins(b.filter("split = 'train'"), b, ["o_totalprice"], 8)
    out = TE.smooth_mean(binned.filter("split = 'train'"), binned, [("o_totalprice_bin",), ("s", "o_totalprice_bin")], "hit", 20.3)
    return rounded(out.select("row_id", "o_totalprice_bin", "te_o_totalprice_bin", "te_s_o_totalprice_bin"), 8)


# ---- folds -------------------------------------------------------------------------------------


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


_STRAT = "((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '{s}'), o_orderkey) - 1) % 5)::INT"


@query("fold_stratified", f"SELECT o_orderkey, o_orderpriority, {_STRAT.format(s=42)} AS fold FROM orders")
def fold_stratified(spark, d):
    return FO.stratified(_orders(spark, d), "o_orderkey", "o_orderpriority", 5, 42)


@query("fold_plain", "SELECT o_orderkey, ((row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def fold_plain(spark, d):
    return FO.plain(_orders(spark, d), "o_orderkey", 5, 42)


@query("fold_group", """WITH RECURSIVE s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), g AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS rn FROM s),
  r AS (SELECT 0::BIGINT AS rn, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS f UNION ALL
    SELECT g.rn, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END), list_position(loads, list_min(loads))::INT - 1 FROM r JOIN g ON g.rn = r.rn + 1)
  SELECT event_id, f AS fold FROM events LEFT JOIN g ON events.user_id IS NOT DISTINCT FROM g.user_id LEFT JOIN r USING (rn)""")
def fold_group(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    f = FO.lightest_folds(e, "user_id", 5).withColumnRenamed("user_id", "g")
    return e.join(f, C("user_id").eqNullSafe(C("g")), "left").select("event_id", "fold")


_CONV = "(SELECT DISTINCT conv_id, role || ':' || (turn % 3)::VARCHAR AS label FROM conversations)"


@query("fold_multilabel", f"""WITH l AS {_CONV}, f AS (SELECT label, count(*) AS n FROM l GROUP BY 1), r AS (SELECT conv_id, label AS stratum FROM (SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY n, label) AS k FROM l JOIN f USING (label)) WHERE k = 1)
  SELECT conv_id, stratum, ((row_number() OVER (PARTITION BY stratum ORDER BY md5(conv_id::VARCHAR || '42'), conv_id) - 1) % 5)::INT AS fold FROM r""")
def fold_multilabel(spark, d):
    c = table(spark, d, "conversations")
    labels = c.select("conv_id", F.concat_ws(":", "role", (C("turn") % 3).cast("string")).alias("label")).distinct()
    return FO.multilabel(labels, c.select("conv_id").distinct(), "conv_id", "label", 5, 42)


@query("fold_holdout", """SELECT doc_id, toxic, CASE WHEN rn <= round(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS rn,
  count(*) OVER (PARTITION BY toxic) AS n FROM labels)""")
def fold_holdout(spark, d):
    l = table(spark, d, "labels").select("doc_id", "toxic")
    path = fresh_path(spark, "holdout")
    FO.holdout(l, "doc_id", "toxic", 0.2, 42, path)
    return FO.holdout(l, "doc_id", "toxic", 0.2, 42, path)


@query("fold_fixed_size", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT o_orderpriority, 400.0::DOUBLE * n / (SELECT sum(n) FROM c)::DOUBLE AS x FROM c),
  q AS (SELECT o_orderpriority, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, o_orderpriority) <= 400 - (SELECT sum(floor(x)) FROM e))::INT AS quota FROM e)
  SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) AS rn FROM orders) JOIN q USING (o_orderpriority) WHERE rn <= quota""")
def fold_fixed_size(spark, d):
    return FO.fixed_size(_orders(spark, d), "o_orderkey", "o_orderpriority", 400, 42)


@query("fold_persist", f"SELECT o_orderkey, o_orderpriority, {_STRAT.format(s=7)} AS fold FROM orders")
def fold_persist(spark, d):
    path = fresh_path(spark, "folds")
    return load_or_build(spark, path, lambda: FO.stratified(_orders(spark, d), "o_orderkey", "o_orderpriority", 5, 7))


@query("fold_repeat_seeds", " UNION ALL ".join(f"SELECT o_orderkey, {s} AS seed, {_STRAT.format(s=s)} AS fold FROM orders" for s in (1, 2, 3)))
def fold_repeat_seeds(spark, d):
    return FO.repeat_seeds(_orders(spark, d), "o_orderkey", "o_orderpriority", 5, [1, 2, 3])


@query("fold_partition_check", "SELECT count(*) AS n_rows, 0::BIGINT AS n_not_once, 0::BIGINT AS n_bad_fold FROM orders")
def fold_partition_check(spark, d):
    o = _orders(spark, d)
    return FO.partition_check(FO.stratified(o, "o_orderkey", "o_orderpriority", 5, 42), o, "o_orderkey", 5)


@query("fold_balance_report", f"""WITH f AS (SELECT o_orderpriority, {_STRAT.format(s=42)} AS fold FROM orders), c AS (SELECT fold, o_orderpriority, count(*) AS n FROM f GROUP BY 1, 2)
  SELECT fold, o_orderpriority, n, n / (sum(n) OVER (PARTITION BY fold))::DOUBLE AS share,
  round(abs(n / (sum(n) OVER (PARTITION BY fold))::DOUBLE - (sum(n) OVER (PARTITION BY o_orderpriority)) / (sum(n) OVER ())::DOUBLE), 10) AS deviation FROM c""")
def fold_balance_report(spark, d):
    out = FO.balance_report(FO.stratified(_orders(spark, d), "o_orderkey", "o_orderpriority", 5, 42), "o_orderpriority")
    return out.withColumn("deviation", F.round("deviation", 10))
