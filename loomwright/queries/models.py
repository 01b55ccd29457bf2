"""Queries of the model training and anomaly sections."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from loomwright.functions.expr import flag, row_count
from loomwright.operators import anomaly as A
from loomwright.operators import blend as B
from loomwright.operators import decide as D
from loomwright.operators import encode as E
from loomwright.operators import models as ML
from loomwright.operators import neighbours as N
from loomwright.operators import text_models as TM
from loomwright.queries.fixtures import scores_wide, split_col, split_lines
from loomwright.queries.history import rounded
from loomwright.plans.store import cut
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
FOLDS = [0, 1, 2]
COLS = ["price", "client", "month", "priority", "hint"]


def orders_matrix(spark, d):
    """Orders as a numeric matrix; the hint column carries part of the label."""
    y = flag(C("o_orderstatus") == "F")
    o = table(spark, d, "orders").select(
        C("o_orderkey").alias("row_id"), y.cast("double").alias("y"), (C("o_orderkey") % 3).cast("int").alias("fold"),
        split_col("o_orderkey").alias("split"), (C("o_totalprice") / 500000.0).alias("price"), ((C("o_custkey") * 7919) % 1000 / 1000.0).alias("client"),
        (F.month("o_orderdate") / 12.0).alias("month"), (F.substring("o_orderpriority", 1, 1).cast("int") / 5.0).alias("priority"),
        (F.when(C("o_orderkey") % 2 == 0, y).otherwise(0) + (C("o_custkey") % 10) / 10.0).alias("hint"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("double").alias("klass"))
    return cut(ML.assemble(o, COLS))  # every fold reads the assembled rows


def _oof(spark, d, fit):
    return ML.oof_loop(orders_matrix(spark, d), FOLDS, fit, ["row_id", "y"])


@query("ml_oof_loop")
def ml_oof_loop(spark, d):
    o = table(spark, d, "orders").select(
        C("o_orderkey").alias("row_id"), flag(C("o_orderstatus") == "F").cast("double").alias("y"), (C("o_orderkey") % 3).cast("int").alias("fold"),
        split_col("o_orderkey").alias("side"), C("o_totalprice").alias("price"), "o_orderpriority", (C("o_custkey") % 10).alias("client"))

    def prepare():
        def vector(df, _):
            return ML.assemble(df, ["price", "client"] + [c for c in df.columns if c.startswith("o_orderpriority_")])

        return E.StageChain([E.standard_scaler(["price"]), E.onehot("o_orderpriority"), E.FittedStage(lambda _: None, vector)])

    train, test = o.filter("side = 'train'"), o.filter("side = 'test'")
    return ML.oof_loop(train, FOLDS, ML.logistic(), ["row_id", "y"], prepare, test)


@query("ml_logreg")
def ml_logreg(spark, d):
    return _oof(spark, d, ML.logistic(balanced=True))


@query("ml_linear")
def ml_linear(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_extendedprice").alias("y"), "l_quantity", "l_tax", (C("l_discount") + 0.0).alias("l_discount"))
    v = cut(ML.assemble(l.withColumn("fold", (C("l_orderkey") % 3).cast("int")), ["l_quantity", "l_tax", "l_discount"]))
    members = {name: ML.linear_member(alpha, mix) for name, alpha, mix in (("ridge", 1.0, 0.0), ("lasso", 5.0, 1.0), ("elastic", 2.0, 0.5))}
    out = ML.regressions_oof(v, FOLDS, members)
    return out.select("l_orderkey", "l_linenumber", "y", "ridge", "lasso", "elastic")


@query("ml_forest")
def ml_forest(spark, d):
    return _oof(spark, d, ML.forest(balanced=True))


@query("ml_gbt")
def ml_gbt(spark, d):
    m = orders_matrix(spark, d).withColumn("is_valid", C("row_id") % 7 == 0)
    return ML.oof_loop(m, FOLDS, ML.boosted(rounds=10, validation="is_valid"), ["row_id", "y"])


@query("ml_gbt_multiclass")
def ml_gbt_multiclass(spark, d):
    from pyspark.ml.functions import vector_to_array

    m = orders_matrix(spark, d).withColumn("y", C("klass"))
    out = ML.boosted_multiclass(m.filter("split = 'train'"), rounds=3).transform(m.filter("split = 'test'"))
    p = F.transform(vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
    n = out.select("row_id", "y", D.ovr_normalise(p).alias("p"))
    return n.select("row_id", "y", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(5)])


@query("ml_ovr_labels")
def ml_ovr_labels(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", (F.length("text") / 1000.0).alias("len"), (C("turn") % 2).cast("double").alias("odd"), flag(C("role") == "user").cast("double").alias("user"),
        flag(C("role") == "assistant").cast("double").alias("assistant"), F.lit(1.0).alias("always"))
    return ML.per_label(ML.assemble(c, ["len", "odd"]), ["user", "assistant", "always"], ML.logistic(), ["conv_id", "turn"])


def labelled_texts(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        C("doc_id").alias("row_id"), C("quality").cast("double").alias("y"), "text", (C("doc_id") % 3).cast("int").alias("fold"))


@query("ml_svc")
def ml_svc(spark, d):
    counted = TM.hashed_counts(labelled_texts(spark, d), "text", 1 << 16)
    return ML.oof_loop(counted, FOLDS, ML.svc(), ["row_id", "y"], TM.hashed_tfidf, at_once=1)


_KINDS = """w0 AS (SELECT row_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM docs),
  k0 AS (SELECT row_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM docs), p0 AS (SELECT row_id, ' ' || t || ' ' AS w, count(*) AS n FROM k0 WHERE t <> '' GROUP BY 1, 2),
  tf AS (SELECT row_id, 'word' AS kind, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM w0 UNION ALL SELECT row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w0) GROUP BY ALL
    UNION ALL SELECT row_id, 'char', term, sum(n) FROM (SELECT row_id, n, unnest(flatten(""" + "[" + ", ".join(
    f"CASE WHEN length(w) >= {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) ELSE [] END" for n in (3, 4, 5)) + "])) AS term FROM p0) GROUP BY ALL)"


@query("ml_nb", f"""WITH docs AS (SELECT doc_id AS row_id, quality::DOUBLE AS y, text, (doc_id % 3)::INT AS fold FROM labels JOIN documents USING (doc_id)), {_KINDS},
  m AS (SELECT unnest([0, 1, 2]) AS f), size AS (SELECT f, count(*) FILTER (fold <> f) AS n FROM docs, m GROUP BY 1),
  dfs AS (SELECT f, kind, term, count(*) AS df FROM tf JOIN docs USING (row_id) JOIN m ON fold <> f GROUP BY ALL HAVING count(*) >= CASE kind WHEN 'word' THEN 2 ELSE 3 END),
  raw AS (SELECT f, row_id, kind, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (kind, term) JOIN size USING (f)),
  x AS (SELECT f, row_id, kind, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, row_id, kind)) AS w FROM raw),
  s AS (SELECT f, kind, term, coalesce(sum(w) FILTER (fold <> f AND y = 1), 0) + 0.3 AS s1, coalesce(sum(w) FILTER (fold <> f AND y = 0), 0) + 0.3 AS s0 FROM x JOIN docs USING (row_id) GROUP BY ALL),
  c AS (SELECT f, kind, term, ln(s1 / sum(s1) OVER (PARTITION BY f)) - ln(s0 / sum(s0) OVER (PARTITION BY f)) AS c FROM s),
  g AS (SELECT row_id, sum(w * c) AS g FROM x JOIN docs USING (row_id) JOIN c USING (f, kind, term) WHERE fold = f GROUP BY 1)
  SELECT row_id, y, fold AS fold_no, round(1 / (1 + exp(-coalesce(g, 0))), 6) AS score FROM docs LEFT JOIN g USING (row_id)""")
def ml_nb(spark, d):
    return rounded(TM.complement_nb(labelled_texts(spark, d), "row_id", "text", FOLDS), 6)


@query("ml_mlp")
def ml_mlp(spark, d):
    m = orders_matrix(spark, d).withColumn("is_valid", C("row_id") % 7 == 0)
    return ML.oof_loop(m, FOLDS, ML.perceptron_with_stop([len(COLS), 8, 2], "is_valid"), ["row_id", "y"])


@query("ml_random_search")
def ml_random_search(spark, d):
    space = {"regParam": lambda r: 10 ** r.uniform(-3, 0), "elasticNetParam": [0.0, 0.5, 1.0]}
    m = orders_matrix(spark, d)
    est = LogisticRegression(featuresCol="features", labelCol="y", maxIter=15)
    found = ML.random_search(m, est, space, 4, 3)
    n = m.count()
    return spark.createDataFrame([(i + 1, float(p["regParam"]), float(p["elasticNetParam"]), float(s), n) for i, (p, s) in enumerate(found)],
                                 "place int, reg_param double, elastic_net double, auc double, n_rows long")


@query("ml_family_matrix", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS tree_quantity, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS tree_flag, round((l_quantity - m) / s, 7) + 0.0 AS linear_quantity,
  (l_returnflag = 'A')::INT AS flag_a, (l_returnflag = 'N')::INT AS flag_n, (l_returnflag = 'R')::INT AS flag_r FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 5 < 4)""")
def ml_family_matrix(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    train = l.filter(split_col("l_orderkey") == "train")
    tree = E.family_chain("tree", ["l_quantity"], {}, ["l_returnflag"]).fit(train)
    lin = E.family_chain("linear", ["l_quantity"], {}, ["l_returnflag"]).fit(train)
    both = tree.apply(l.withColumn("q", C("l_quantity")).withColumn("flag", C("l_returnflag"))).withColumnsRenamed({"l_quantity": "tree_quantity", "l_returnflag": "tree_flag", "q": "l_quantity", "flag": "l_returnflag"})
    out = lin.apply(both)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "tree_quantity", "tree_flag", (F.round("l_quantity", 7) + 0.0).alias("linear_quantity"),
                      *[C(f"l_returnflag_{v}").alias(f"flag_{v.lower()}") for v in "ANR"])


@query("ml_importance")
def ml_importance(spark, d):
    m = orders_matrix(spark, d)
    rows = ML.importances(ML.forest()(m), COLS, 5)
    n = m.count()
    return spark.createDataFrame([(*r, n) for r in rows], "place int, feature string, importance double, n_rows long")


@query("ml_tier_benchmark")
def ml_tier_benchmark(spark, d):
    return ML.tier_benchmark(orders_matrix(spark, d), FOLDS, {"linear": ML.logistic(), "tree": ML.forest(trees=8, depth=4)})


@query("bl_stack_logit")
def bl_stack_logit(spark, d):
    s = scores_wide(spark, d).withColumn("y", C("y").cast("double"))
    return ML.stack_logistic(s, ["a", "b", "c"], range(5))


@query("bl_soft_vote")
def bl_soft_vote(spark, d):
    m = orders_matrix(spark, d)
    members = {"logit": ML.logistic(), "forest": ML.forest(trees=8, depth=4)}
    parts = [ML.oof_loop(m, FOLDS, fit, ["row_id", "y"]).withColumn("run", F.lit(n)) for n, fit in members.items()]
    return B.mean_score(parts[0].unionByName(parts[1]), ["row_id", "y"])


@query("dr_adversarial")
def dr_adversarial(spark, d):
    from loomwright.operators.metrics import roc_auc

    l = split_lines(spark, d).select("l_orderkey", (C("split") == "test").cast("double").alias("y"), (C("l_orderkey") % 3).cast("int").alias("fold"),
                                     "l_quantity", "l_extendedprice", "l_discount")
    v = ML.assemble(l, ["l_quantity", "l_extendedprice", "l_discount"])
    v = cut(v.select("l_orderkey", "y", "fold", "features"))  # every fold reads the assembled rows
    oof = ML.oof_loop(v, FOLDS, ML.boosted(rounds=5), ["l_orderkey", "y"])
    return roc_auc(oof, []).withColumn("n_rows", F.lit(v.count()))


# ---- anomaly -----------------------------------------------------------------------------------


def vectors(spark, d, dims=None):
    e = C("embedding").cast("array<double>")
    v = table(spark, d, "embeddings").select("vec_id", (F.slice(e, 1, dims) if dims else e).alias("v"), flag(C("label") == 0).alias("y"))
    train = split_col("vec_id") == "train"
    return v.filter(train), v.filter(~train)


@query("an_pca_recon")
def an_pca_recon(spark, d):
    tr, te = vectors(spark, d)
    return A.pca_reconstruction(tr, te, "v", 15).select("vec_id", "y", "score")


@query("an_gmm")
def an_gmm(spark, d):
    tr, te = vectors(spark, d, 8)
    return A.gmm(tr, te, "v", k=4).select("vec_id", "y", "score")


def _dims(df, n):
    return df.select("vec_id", "y", *[F.get("v", F.lit(i)).alias(f"d{i}") for i in range(n)])


@query("an_mahalanobis", """WITH e AS (SELECT vec_id, (label = 0)::INT AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM e WHERE vec_id % 5 < 4)
  SELECT vec_id, y, round((vb * (a - ma) ** 2 + va * (b - mb) ** 2 - 2 * c * (a - ma) * (b - mb)) / (va * vb - c * c), 6) AS score FROM e, m WHERE vec_id % 5 >= 4""")
def an_mahalanobis(spark, d):
    tr, te = vectors(spark, d, 2)
    return rounded(A.mahalanobis(_dims(tr, 2), _dims(te, 2), ["d0", "d1"]).select("vec_id", "y", "score"))


@query("an_mahalanobis_trimmed")
def an_mahalanobis_trimmed(spark, d):
    tr, te = vectors(spark, d, 6)
    cols = [f"d{i}" for i in range(6)]
    return A.scaled(A.mahalanobis(_dims(tr, 6), _dims(te, 6), cols, rounds=3)).select("vec_id", "y", "score")


@query("an_iforest")
def an_iforest(spark, d):
    l = table(spark, d, "lineitem").select(
        F.concat_ws("|", *[C(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]).alias("row_id"),
        "l_orderkey", "l_quantity", "l_extendedprice", (C("l_discount") + 0.0).alias("l_discount"), "l_tax")
    train = split_col("l_orderkey") == "train"
    out = A.isolation_forest(l.filter(train), l.filter(~train), "row_id", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return A.scaled(cut(out.select("row_id", "score")))


def near_sql(points: str, k: int) -> str:
    """CTEs on ``points`` (vec_id, v, base): the bucket search's table ``near`` (q, bid, dist, rk)."""
    width = N.BITS + 1
    x = f"(({{t}} * {width} + {{b}}) * 64 + i)::BIGINT"
    coefficient = f"(({x} * {x} * {x} * {N.CUBE} + {x} * {x} * {N.SQUARE} + {x} * {N.LINE}) % {N.MODULUS}) / {N.MODULUS}::DOUBLE - 0.5"
    on = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (" + coefficient + ")))"
    code = f"list_sum(list_transform(range({N.BITS}), lambda b: CASE WHEN {on.format(t='t', b='b')} >= 0 THEN (1 << ({N.BITS - 1} - b))::BIGINT ELSE 0 END))"
    return f"""pts AS ({points}), mid AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM pts, range(1, 65) r(i) GROUP BY i)),
  coded AS (SELECT vec_id, v, base, t, {code} AS code, round({on.format(t='t', b=N.BITS)}, {N.DIGITS}) AS along FROM pts, mid, range({N.TABLES}) tabs(t)),
  placed AS (SELECT *, floor((row_number() OVER (PARTITION BY t ORDER BY code, along, vec_id) - 1) * ceil(count(*) OVER (PARTITION BY t) / {N.BUCKET}) / count(*) OVER (PARTITION BY t)) AS bucket FROM coded),
  near AS (SELECT * FROM (SELECT q, bid, dist, row_number() OVER (PARTITION BY q ORDER BY dist, bid) AS rk FROM (
    SELECT DISTINCT x.vec_id AS q, y.vec_id AS bid, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) ** 2))) AS dist
    FROM placed x JOIN placed y ON x.t = y.t AND x.bucket = y.bucket AND x.vec_id <> y.vec_id AND y.base)) WHERE rk <= {k})"""


_D = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - b.v[i]) ** 2)))"


@query("an_lof", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT * FROM e WHERE vec_id % 5 < 4),
  p AS (SELECT x.vec_id AS q, b.vec_id AS bid, {_D} AS dist FROM e x, b WHERE x.vec_id <> b.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, bid) AS rk FROM p) WHERE rk <= 20),
  r AS (SELECT q AS bid, max(dist) AS kd FROM k WHERE q % 5 < 4 GROUP BY 1), l AS (SELECT q, 1.0 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM k JOIN r USING (bid) GROUP BY 1)
  SELECT k.q AS vec_id, round(avg(lb.lrd) / any_value(lq.lrd), 6) AS score FROM k JOIN l lb ON lb.q = k.bid JOIN l lq ON lq.q = k.q WHERE k.q % 5 >= 4 GROUP BY 1""")
def an_lof(spark, d):
    tr, te = vectors(spark, d)
    return rounded(A.local_outlier_factor(tr, te, "vec_id", "v", 20))


@query("an_rule_flags", """SELECT avg((v = 1)::INT) FILTER (v IS NOT NULL) * count(v) / count(*) AS rate_one, count(*) FILTER (v = 0) / count(*)::DOUBLE AS rate_zero, count(*) FILTER (v < 0) / count(*)::DOUBLE AS rate_negative, count(*) FILTER (v IS NULL) / count(*)::DOUBLE AS rate_missing
  FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 1 WHEN event_id % 7 = 2 THEN 0 WHEN event_id % 7 = 3 THEN -value ELSE value END AS v FROM events)""".replace(
    "avg((v = 1)::INT) FILTER (v IS NOT NULL) * count(v) / count(*)", "count(*) FILTER (v = 1) / count(*)::DOUBLE"))
def an_rule_flags(spark, d):
    k = C("event_id") % 7
    v = F.when(k == 0, None).when(k == 1, 1.0).when(k == 2, 0.0).when(k == 3, -C("value")).otherwise(C("value"))
    return A.rule_flags(table(spark, d, "events").select(v.alias("v")), "v")


_UNIT = "('0x' || substr(md5(synthetic::VARCHAR || '{}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("smp_smote", f"""WITH {near_sql("SELECT vec_id, embedding::DOUBLE[] AS v, true AS base FROM embeddings WHERE label = 0 AND vec_id % 5 < 4", 5)},
  size AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS m FROM embeddings WHERE vec_id % 5 < 4), numbered AS (SELECT vec_id, v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || 'smote'), vec_id) AS place FROM pts),
  draws AS (SELECT *, floor({_UNIT.format("neighbour")} * least(5, m - 1)) + 1 AS rk, {_UNIT.format("gap")} AS gap FROM (SELECT unnest(range(n - 2 * m)) AS synthetic, m FROM size))
  SELECT d.synthetic, a.vec_id AS base_id, b.vec_id AS neighbour_id, d.gap, round(a.v[1] + (b.v[1] - a.v[1]) * d.gap, 9) + 0.0 AS v0, round(a.v[2] + (b.v[2] - a.v[2]) * d.gap, 9) + 0.0 AS v1
  FROM draws d JOIN numbered a ON a.place = d.synthetic % d.m + 1 JOIN near ON near.q = a.vec_id AND near.rk = d.rk JOIN pts b ON b.vec_id = near.bid""")
def smp_smote(spark, d):
    tr, _ = vectors(spark, d)
    out = A.smote(tr, "vec_id", "v", C("y") == 1)
    return out.select("synthetic", "base_id", "neighbour_id", "gap", *[(F.round(F.get("v", F.lit(i)), 9) + 0.0).alias(f"v{i}") for i in range(2)])


@query("pub_score_report")
def pub_score_report(spark, d):
    """Per-split score range of the out-of-fold member."""
    from loomwright.operators.publish import score_distribution

    return score_distribution(_oof(spark, d, ML.logistic()), ["split"], "score").withColumn("n", F.lit(orders_matrix(spark, d).agg(row_count().alias("n")).first()["n"]))
