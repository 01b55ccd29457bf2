"""Queries of the metric and decision sections."""

from pyspark.sql import functions as F

from loomwright.functions.expr import flag, row_count
from loomwright.operators import decide as D
from loomwright.operators import metrics as M
from loomwright.queries.fixtures import CLASS_LONG, SCORES, SCORES_WIDE, class_probs, scores, scores_wide, split_col
from loomwright.queries.history import cents, rounded
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
K = 5
_G = f"(SELECT run, score, sum(y) AS pos, count(*) AS n FROM {SCORES} GROUP BY 1, 2)"


def auc_sql(src, keys, score="score", y="y"):
    """Rank-sum AUC over any source text."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    lead = "".join(f"{k}, " for k in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {lead}(sum(r) FILTER (__y = 1) - count(*) FILTER (__y = 1) * (count(*) FILTER (__y = 1) + 1) / 2.0::DOUBLE)
      / nullif(count(*) FILTER (__y = 1) * count(*) FILTER (__y = 0), 0)::DOUBLE AS auc FROM (SELECT {lead}{y} AS __y,
      rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0::DOUBLE AS r FROM {src}) {by}"""


@query("met_roc_auc", f"SELECT run, round(auc, 10) AS auc FROM ({auc_sql(SCORES, ['run'])})")
def met_roc_auc(spark, d):
    return rounded(M.roc_auc(scores(spark, d), ["run"]), 10)


_HITS = f"(SELECT run, score, pos, n, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY run) AS P FROM {_G} WINDOW w AS (PARTITION BY run ORDER BY score DESC))"


@query("met_average_precision", f"SELECT run, round(sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos), 8) AS ap FROM {_HITS} GROUP BY 1")
def met_average_precision(spark, d):
    return rounded(M.average_precision(scores(spark, d), ["run"]), 8)


_CLIP = "CASE WHEN score < 1e-15 THEN 1e-15 WHEN score > 1 - 1e-15 THEN 1 - 1e-15 ELSE score END"


@query("met_log_loss", f"SELECT run, round(avg(-ln(CASE WHEN y = 1 THEN {_CLIP} ELSE 1 - ({_CLIP}) END)), 8) AS log_loss FROM {SCORES} GROUP BY 1")
def met_log_loss(spark, d):
    return rounded(M.log_loss(scores(spark, d), ["run"]), 8)


@query("met_log_loss_multi", f"""SELECT round(avg(-ln(p)), 8) AS log_loss, (SELECT round(sum(-s * ln(s)), 8) FROM (SELECT count(*) / (SELECT count(*) FROM orders)::DOUBLE AS s FROM orders GROUP BY o_orderpriority)) AS prior_log_loss,
  round(ln(5.0), 8) AS uniform_log_loss FROM {CLASS_LONG} WHERE c = y""")
def met_log_loss_multi(spark, d):
    return rounded(M.log_loss_multi(class_probs(spark, d), K), 8)


@query("met_brier", f"SELECT run, round(avg((score - y) * (score - y)), 8) AS brier FROM {SCORES} GROUP BY 1")
def met_brier(spark, d):
    return rounded(M.brier(scores(spark, d), ["run"]), 8)


@query("met_rmse", "SELECT round(sqrt(avg((l_quantity - l_linenumber * 6.5) * (l_quantity - l_linenumber * 6.5))), 6) AS rmse FROM lineitem")
def met_rmse(spark, d):
    return rounded(table(spark, d, "lineitem").agg(M.rmse("l_quantity", C("l_linenumber") * 6.5).alias("rmse")))


@query("met_rmsle", "SELECT round(sqrt(avg((ln(1 + l_quantity) - ln(1 + CASE WHEN q < 0 THEN 0 ELSE q END)) ** 2)), 6) AS rmsle FROM (SELECT l_quantity, l_linenumber * 9.0 - 12 AS q FROM lineitem)")
def met_rmsle(spark, d):
    return rounded(table(spark, d, "lineitem").agg(M.rmsle("l_quantity", C("l_linenumber") * 9.0 - 12).alias("rmsle")))


@query("met_accuracy", f"SELECT run, round(avg((y = (score >= 0.5)::INT)::INT), 8) AS accuracy FROM {SCORES} GROUP BY 1")
def met_accuracy(spark, d):
    return rounded(scores(spark, d).groupBy("run").agg(M.accuracy("y", D.apply_threshold("score", 0.5)).alias("accuracy")), 8)


PRED = f"(SELECT row_id, y, fold, c AS pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rk FROM {CLASS_LONG}) WHERE rk = 1)"


def preds(spark, d):
    return class_probs(spark, d).select("row_id", "y", "fold", M.argmax("p").alias("pred"))


@query("met_balanced_accuracy", f"SELECT y, count(*) AS support, round(avg((y = pred)::INT), 8) AS recall, round(avg(avg((y = pred)::INT)) OVER (), 8) AS balanced_accuracy FROM {PRED} GROUP BY 1")
def met_balanced_accuracy(spark, d):
    p = preds(spark, d)
    per = M.recall_by_class(p, "pred")
    return rounded(per.withColumn("balanced_accuracy", F.lit(M.balanced_accuracy(p, "pred").first()[0])), 8)


@query("met_f1_binary", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p = 0) AS fn, count(*) AS n,
  count(*) FILTER (quality = p) AS ok FROM (SELECT quality, (doc_id % 3 > 0)::INT AS p FROM labels))
  SELECT tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, ok / n::DOUBLE AS accuracy FROM c""")
def met_f1_binary(spark, d):
    return M.f1_binary(table(spark, d, "labels"), [], flag(C("doc_id") % 3 > 0), "quality")


_F1 = f"""(SELECT c AS class, count(*) FILTER (y = c) AS support, 2 * count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (pred = c), 0)::DOUBLE AS f1 FROM {PRED}, range(5) t(c) GROUP BY 1)"""


@query("met_f1_macro", f"SELECT class::INT AS class, support, f1, round(avg(f1) OVER (), 8) AS f1_macro FROM {_F1}")
def met_f1_macro(spark, d):
    p = preds(spark, d)
    return M.f1_by_class(p, "pred").withColumn("f1_macro", F.round(F.lit(M.f1_macro(p, "pred").first()[0]), 8))


@query("met_confusion", f"SELECT run, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM {SCORES} GROUP BY 1")
def met_confusion(spark, d):
    return M.confusion(scores(spark, d), ["run"], D.apply_threshold("score", 0.5))


_RK = f"(SELECT row_id, y, c, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, c) AS rk FROM {CLASS_LONG})"


@query("met_mapk3", f"SELECT round(avg(CASE WHEN rk <= 3 THEN 1.0::DOUBLE / rk ELSE 0 END), 8) AS map3 FROM {_RK} WHERE c = y")
def met_mapk3(spark, d):
    return rounded(class_probs(spark, d).agg(M.mapk(M.class_scores("p", K), "y").alias("map3")), 8)


_FLAT = f"(SELECT row_id, c AS class, p AS score, (y = c)::INT AS y FROM {CLASS_LONG})"


@query("met_pooled_auc", f"SELECT round(auc, 10) AS auc FROM ({auc_sql(_FLAT, [])})")
def met_pooled_auc(spark, d):
    return rounded(M.pooled_auc(M.flatten(class_probs(spark, d))), 10)


@query("met_macro_auc", f"SELECT round(avg(auc), 8) AS macro_auc, count(auc) AS n_classes FROM ({auc_sql(_FLAT, ['class'])})")
def met_macro_auc(spark, d):
    return rounded(M.macro_auc(M.flatten(class_probs(spark, d))), 8)


_RN = f"(SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS score FROM {_FLAT})"


@query("met_pooled_auc_ranknorm", f"SELECT round(auc, 10) AS auc FROM ({auc_sql(_RN, [])})")
def met_pooled_auc_ranknorm(spark, d):
    return rounded(M.pooled_auc_ranknorm(M.flatten(class_probs(spark, d))), 10)


@query("met_pr_curve", f"SELECT run, score AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / P::DOUBLE AS recall, tp::BIGINT AS tp, fp::BIGINT AS fp FROM {_HITS}")
def met_pr_curve(spark, d):
    return M.pr_curve(scores(spark, d), ["run"]).drop("P")


@query("met_fold_summary", f"SELECT run, round(avg(auc), 8) AS mean, round(stddev_pop(auc), 8) AS std, round(min(auc), 8) AS worst, round(max(auc), 8) AS best FROM ({auc_sql(SCORES, ['run', 'fold'])}) GROUP BY 1")
def met_fold_summary(spark, d):
    return rounded(M.fold_summary(scores(spark, d), ["run"]), 8)


@query("met_covered_only", """WITH j AS (SELECT l.quality AS y, CASE WHEN d.n_chars IS NOT NULL THEN (d.n_chars % 2)::INT END AS p FROM labels l LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'fr')) d USING (doc_id)),
  c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(p) AS n, count(*) FILTER (y = p) AS ok, count(*) AS total FROM j)
  SELECT tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, ok / n::DOUBLE AS accuracy, n / total::DOUBLE AS coverage FROM c""")
def met_covered_only(spark, d):
    labels = table(spark, d, "labels").select("doc_id", C("quality").alias("y"))
    answered = table(spark, d, "documents").filter("lang in ('en', 'fr')").select("doc_id", (C("n_chars") % 2).cast("int").alias("label"))
    return M.covered_only(labels, answered, "doc_id")


@query("met_naive_baseline", """SELECT 'majority_accuracy' AS metric, round(max(n) / sum(n)::DOUBLE, 8) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) UNION ALL
  SELECT 'prior_log_loss', round(-(p * ln(p) + (1 - p) * ln(1 - p)), 8) FROM (SELECT avg((o_orderstatus = 'F')::INT) AS p FROM orders) UNION ALL
  SELECT 'mean_rmse', round(stddev_pop(l_quantity), 8) FROM lineitem""")
def met_naive_baseline(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    top = o.groupBy("o_orderpriority").agg(row_count().alias("n")).agg((F.max("n") / F.sum("n")).alias("value"))
    y = o.select(flag(C("o_orderstatus") == "F").alias("y"))
    p = y.agg(F.avg("y")).first()[0]
    loss = y.agg(F.avg(M.log_loss_term(F.lit(p), "y")).alias("value"))
    mean = l.agg(F.avg("l_quantity")).first()[0]
    err = l.agg(M.rmse("l_quantity", F.lit(mean)).alias("value"))
    named = [f.select(F.lit(n).alias("metric"), "value") for n, f in (("majority_accuracy", top), ("prior_log_loss", loss), ("mean_rmse", err))]
    return rounded(named[0].unionByName(named[1]).unionByName(named[2]), 8)


@query("met_leaderboard", f"SELECT run, round(auc, 10) AS auc, round(auc - max(auc) OVER (), 10) + 0.0 AS delta FROM ({auc_sql(SCORES, ['run'])})")
def met_leaderboard(spark, d):
    return rounded(M.leaderboard(M.roc_auc(scores(spark, d), ["run"])), 10)


# ---- decisions ---------------------------------------------------------------------------------


@query("dec_threshold_f1", f"""WITH h AS (SELECT *, lag(score) OVER (PARTITION BY run ORDER BY score) AS below FROM {_HITS}), o AS (SELECT run, P, CASE WHEN below IS NULL THEN 0.0 ELSE (score + below) / 2 END AS threshold, tp, fp FROM h
  UNION ALL SELECT run, max(P), 1.0, max(CASE WHEN score >= 1 THEN tp ELSE 0 END), max(CASE WHEN score >= 1 THEN fp ELSE 0 END) FROM h GROUP BY 1)
  SELECT run, threshold, f1 FROM (SELECT run, threshold, coalesce(2 * tp / nullif(tp + fp + P, 0)::DOUBLE, 0) AS f1, row_number() OVER (PARTITION BY run ORDER BY 2 * tp / (tp + fp + P)::DOUBLE DESC, threshold) AS rn FROM o) WHERE rn = 1""")
def dec_threshold_f1(spark, d):
    return D.threshold_f1(scores(spark, d), ["run"])


_PR = f"(SELECT run, score AS threshold, tp / (tp + fp)::DOUBLE AS p, tp / P::DOUBLE AS r FROM {_HITS})"


@query("dec_threshold_pr", f"SELECT run, threshold, round(f1, 8) AS f1 FROM (SELECT run, threshold, 2 * p * r / greatest(p + r, 1e-12) AS f1, row_number() OVER (PARTITION BY run ORDER BY 2 * p * r / greatest(p + r, 1e-12) DESC, threshold) AS rn FROM {_PR}) WHERE rn = 1")
def dec_threshold_pr(spark, d):
    return D.threshold_pr(scores(spark, d), ["run"]).withColumn("f1", F.round("f1", 8))


@query("dec_precision_floor", f"SELECT run, threshold, p AS precision, r AS recall FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY r DESC, threshold) AS rn FROM {_PR} WHERE p >= 0.4) WHERE rn = 1")
def dec_precision_floor(spark, d):
    return D.precision_floor(scores(spark, d), ["run"], 0.4)


@query("dec_apply_threshold", f"SELECT row_id, run, (score >= 0.45)::INT AS label FROM {SCORES} WHERE row_id % 5 = 4")
def dec_apply_threshold(spark, d):
    s = scores(spark, d).filter(split_col("row_id") == "test")
    return s.select("row_id", "run", D.apply_threshold("score", 0.45).alias("label"))


@query("dec_weighted_argmax", f"SELECT row_id, c AS label FROM (SELECT row_id, c, row_number() OVER (PARTITION BY row_id ORDER BY p * [1.0::DOUBLE, 0.75::DOUBLE, 1.25::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE][c + 1] DESC, c) AS rk FROM {CLASS_LONG}) WHERE rk = 1")
def dec_weighted_argmax(spark, d):
    return class_probs(spark, d).select("row_id", D.weighted_argmax("p", [1.0, 0.75, 1.25, 0.5, 1.5]).alias("label"))


_PB = "(SELECT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN month(o_orderdate) END, -1) AS bin, left(o_orderpriority, 1)::INT - 1 AS y FROM orders)"


@query("dec_prior_corrected", f"""WITH b AS {_PB}, n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1), pr AS (SELECT c, count(*) FILTER (y = c) / count(*)::DOUBLE AS p FROM b, range(5) t(c) GROUP BY 1),
  s AS (SELECT bin, c, count(*) FILTER (y = c) AS s FROM b, range(5) t(c) GROUP BY 1, 2)
  SELECT bin::INT AS bin, n, c::INT AS label FROM (SELECT bin, n, c, row_number() OVER (PARTITION BY bin ORDER BY (s + 1e-9) / (n + 5e-9) / p DESC, c) AS rk FROM s JOIN n USING (bin) JOIN pr USING (c)) WHERE rk = 1""")
def dec_prior_corrected(spark, d):
    o = table(spark, d, "orders").select(F.when(C("o_orderkey") % 7 != 0, F.month("o_orderdate")).alias("b"),
                                         (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"))
    return D.prior_corrected(o, "b", "y", K)


def prob_columns(spark, d):
    cols = [f"p{c}" for c in range(K)]
    return class_probs(spark, d).select("row_id", "y", "fold", *[F.get("p", F.lit(c)).alias(n) for c, n in enumerate(cols)]), cols


def _tuned(spark, d, search):
    df, cols = prob_columns(spark, d)
    kept = df.select("y", *cols).persist()
    try:
        counts = [r["n"] for r in kept.groupBy("y").agg(row_count().alias("n")).orderBy("y").collect()]
        scorer = lambda pairs: D.score_weights(kept, cols, "y", [w for _, w in pairs])
        weights, best = search(scorer, [c / sum(counts) for c in counts])[0]
    finally:
        kept.unpersist()
    w = F.array(*[F.lit(x) for x in weights])
    out = class_probs(spark, d).select("row_id", "y", D.weighted_argmax("p", weights).alias("label"))
    return out.groupBy("y").agg(row_count().alias("support"), M.accuracy("y", "label").alias("recall")).select(
        "y", "support", "recall", F.get(w, C("y")).alias("weight"), F.lit(best).alias("tuned_score"))


@query("dec_tune_weights")
def dec_tune_weights(spark, d):
    return _tuned(spark, d, lambda scorer, prior: D.tune_weights(scorer, prior))


@query("dec_tune_weights_geo")
def dec_tune_weights_geo(spark, d):
    return _tuned(spark, d, lambda scorer, prior: D.tune_weights_geo(scorer, K))


_VOTES = f"(SELECT row_id, (a >= 0.4)::INT AS d1, (b >= 0.4)::INT AS d2, CASE WHEN row_id % 6 <> 0 THEN (c >= 0.4)::INT END AS d3 FROM {SCORES_WIDE})"


def votes(spark, d):
    s = scores_wide(spark, d)
    return s.select("row_id", flag(C("a") >= 0.4).alias("d1"), flag(C("b") >= 0.4).alias("d2"),
                    F.when(C("row_id") % 6 != 0, flag(C("c") >= 0.4)).alias("d3"))


@query("dec_majority_vote", f"SELECT row_id, CASE WHEN d1 <> d2 THEN (d1 + d2 + coalesce(d3, d1) >= 2)::INT ELSE d1 END AS vote FROM {_VOTES}")
def dec_majority_vote(spark, d):
    return votes(spark, d).select("row_id", D.majority_vote("d1", "d2", "d3").alias("vote"))


@query("dec_route_ambiguous", f"SELECT row_id, d1, (d1 <> d2)::INT AS is_ambiguous, CASE WHEN d1 <> d2 THEN (d1 + d2 + coalesce(d3, d1) >= 2)::INT ELSE d1 END AS routed FROM {_VOTES}")
def dec_route_ambiguous(spark, d):
    v = votes(spark, d)
    answers = D.ambiguous(v, "d1", "d2").filter("d3 is not null").select("row_id", C("d3").alias("answer"))
    return D.route(v.drop("d3"), answers, "row_id", "d1", "d2").select("row_id", "d1", "is_ambiguous", "routed")


@query("dec_conflict_majority", """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT text, avg(y) AS m, count(*) AS n FROM x GROUP BY 1)
  SELECT doc_id, CASE WHEN n > 1 AND m > 0 AND m < 1 THEN (m > 0.5)::INT ELSE y END::INT AS y FROM x LEFT JOIN g USING (text)""")
def dec_conflict_majority(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", "text", F.when(C("doc_id") % 3 == 0, 1 - C("quality")).otherwise(C("quality")).cast("int").alias("y"))
    return D.repair_conflicts(x, "text", "y").select("doc_id", "y")


@query("dec_hierarchical", f"SELECT row_id, a AS low, (1 - a) * (1 - b) AS medium, (1 - a) * b AS high FROM {SCORES_WIDE}")
def dec_hierarchical(spark, d):
    low, mid, high = D.hierarchical("a", "b")
    return scores_wide(spark, d).select("row_id", low.alias("low"), mid.alias("medium"), high.alias("high"))


@query("dec_route_rest", f"SELECT row_id, y, a FROM {SCORES_WIDE} WHERE a < 0.5")
def dec_route_rest(spark, d):
    return D.route_rest(scores_wide(spark, d).select("row_id", "y", "a"), "a")


@query("dec_ovr_normalise", f"SELECT row_id, round(a / (0.0::DOUBLE + a + b + c), 10) AS p0, round(b / (0.0::DOUBLE + a + b + c), 10) AS p1, round(c / (0.0::DOUBLE + a + b + c), 10) AS p2 FROM {SCORES_WIDE}")
def dec_ovr_normalise(spark, d):
    s = scores_wide(spark, d).select("row_id", D.ovr_normalise(F.array("a", "b", "c")).alias("p"))
    return s.select("row_id", *[F.round(F.get("p", F.lit(i)), 10).alias(f"p{i}") for i in range(3)])
