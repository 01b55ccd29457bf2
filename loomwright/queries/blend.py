"""Queries of the blend and ensemble section (members from spark.ml are with the models)."""

from pyspark.sql import functions as F

from loomwright.functions.expr import flag, row_count
from loomwright.operators import blend as B
from loomwright.operators import metrics as M
from loomwright.plans.store import cut
from loomwright.queries.fixtures import CLASS_RUNS, SCORES, SCORES_WIDE, class_runs, class_runs_long, scores, scores_wide
from loomwright.queries.history import rounded
from loomwright.queries.metrics_decide import auc_sql
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col
K = 5
RUNS = ["m0", "m1", "m2"]


@query("bl_mean", f"SELECT row_id, c, round(avg(score), 10) AS score FROM {CLASS_RUNS} GROUP BY 1, 2")
def bl_mean(spark, d):
    return rounded(B.mean_score(class_runs_long(spark, d), ["row_id", "c"]), 10)


@query("bl_weighted", f"SELECT row_id, round(sum(score * CASE run WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END), 9) AS score FROM {SCORES} GROUP BY 1")
def bl_weighted(spark, d):
    return rounded(B.weighted_score(scores(spark, d), ["row_id"], {"a": 5.0, "b": 3.0, "c": 2.0}), 9)


def _rank(src, part, form):
    r = f"(rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0::DOUBLE)"
    n = f"(count(*) OVER (PARTITION BY {part}))"
    return f"(SELECT *, {r} / {n} AS r FROM {src})" if form == "n" else f"(SELECT *, ({r} - 1) / ({n} - 1)::DOUBLE AS r FROM {src})"


@query("bl_rank_n", f"SELECT row_id, round(avg(r), 10) AS score FROM {_rank(SCORES, 'run', 'n')} GROUP BY 1")
def bl_rank_n(spark, d):
    return rounded(B.rank_blend(scores(spark, d), ["run"], ["row_id"]), 10)


@query("bl_rank01", f"SELECT row_id, round(sum(r * CASE run WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END), 9) AS score FROM {_rank(SCORES, 'run', '01')} GROUP BY 1")
def bl_rank01(spark, d):
    return rounded(B.rank_blend(scores(spark, d), ["run"], ["row_id"], "01", {"a": 5.0, "b": 3.0, "c": 2.0}), 9)


@query("bl_rank_percol", f"SELECT row_id, c, round(avg(r), 10) AS score FROM {_rank(CLASS_RUNS, 'run, c', 'n')} GROUP BY 1, 2")
def bl_rank_percol(spark, d):
    return rounded(B.rank_blend(class_runs_long(spark, d), ["run", "c"], ["row_id", "c"]), 10)


@query("bl_rank_global", f"SELECT row_id, c, round(avg(r), 10) AS score FROM {_rank(CLASS_RUNS, 'run', 'n')} GROUP BY 1, 2")
def bl_rank_global(spark, d):
    return rounded(B.rank_blend(class_runs_long(spark, d), ["run"], ["row_id", "c"]), 10)


_GRID = f"(SELECT i / 20.0::DOUBLE AS weight, y, fold, (i / 20.0::DOUBLE) * a + (1.0::DOUBLE - i / 20.0::DOUBLE) * b AS score FROM {SCORES_WIDE}, range(21) t(i))"


@query("bl_grid_weight", f"""WITH g AS ({auc_sql(_GRID, ['weight'])}), b AS (SELECT weight FROM g ORDER BY auc DESC, weight LIMIT 1), f AS ({auc_sql(_GRID, ['weight', 'fold'])})
  SELECT 'all' AS part, weight, round(auc, 10) AS auc FROM g UNION ALL SELECT 'fold' || fold::VARCHAR, weight, round(auc, 10) FROM f JOIN b USING (weight)""")
def bl_grid_weight(spark, d):
    w = scores_wide(spark, d)
    grid = cut(B.grid_weight(w, "a", "b", "y"))
    best = B.best_weight(grid)
    blend = w.select("fold", "y", (F.lit(best) * C("a") + F.lit(1.0 - best) * C("b")).alias("score"))
    folds = M.roc_auc(blend, ["fold"]).select(F.concat(F.lit("fold"), C("fold").cast("string")).alias("part"), F.lit(best).alias("weight"), "auc")
    return rounded(grid.select(F.lit("all").alias("part"), "weight", "auc").unionByName(folds), 10)


def _steps(spark, rows, scale, name="members"):
    """The chosen members beside the number of scored rows."""
    spec = spark.createDataFrame(rows, "step int, run string, score double")
    return spec.withColumn("n_rows", F.lit(scale))


@query("bl_hillclimb")
def bl_hillclimb(spark, d):
    wide = class_runs(spark, d).select("y", *RUNS).persist()
    try:
        n = wide.count()
        scorer = lambda trials: B.score_picks(wide, RUNS, "y", K, lambda s, y: M.mapk(s, y), trials)
        _, _, trace = B.hillclimb(scorer, RUNS)
    finally:
        wide.unpersist()
    return _steps(spark, trace, n)


@query("bl_hillclimb_step", f"""WITH w AS (SELECT row_id, y, c, sum(score) FILTER (run = 'm0') AS m0, sum(score) FILTER (run = 'm1') AS m1, sum(score) FILTER (run = 'm2') AS m2 FROM {CLASS_RUNS} GROUP BY 1, 2, 3),
  t AS (SELECT 'm0' AS run, row_id, y, c, m0 * 2 AS s FROM w UNION ALL SELECT 'm1', row_id, y, c, m0 + m1 FROM w UNION ALL SELECT 'm2', row_id, y, c, m0 + m2 FROM w),
  r AS (SELECT run, y, c, row_number() OVER (PARTITION BY run, row_id ORDER BY s DESC, c) AS rk FROM t)
  SELECT run, round(avg(CASE WHEN rk <= 3 THEN 1.0::DOUBLE / rk ELSE 0 END), 6) AS map3 FROM r WHERE c = y GROUP BY 1""")
def bl_hillclimb_step(spark, d):
    """One greedy step after m0: every candidate scored in one job."""
    trials = [{"m0": 2}, {"m0": 1, "m1": 1}, {"m0": 1, "m2": 1}]
    got = B.score_picks(class_runs(spark, d), RUNS, "y", K, lambda s, y: M.mapk(s, y), trials)
    return rounded(spark.createDataFrame(list(zip(RUNS, got)), "run string, map3 double"))


@query("bl_hillclimb_tuned")
def bl_hillclimb_tuned(spark, d):
    wide = class_runs(spark, d).select("y", *RUNS).persist()
    try:
        counts = [r["n"] for r in wide.groupBy("y").agg(row_count().alias("n")).orderBy("y").collect()]
        prior = [c / sum(counts) for c in counts]

        scorer = lambda trials: B.score_tuned_picks(wide, RUNS, "y", K, trials, prior, rounds=2, grid=9)
        _, _, trace = B.hillclimb(scorer, RUNS, steps=3, worthwhile=B.gains_more_than(1e-6))
    finally:
        wide.unpersist()
    return _steps(spark, trace, sum(counts))


_GR = f"""SELECT round(sum(a * a), 6) AS aa, round(sum(a * b), 6) AS ab, round(sum(a * c), 6) AS ac, round(sum(b * b), 6) AS bb, round(sum(b * c), 6) AS bc, round(sum(c * c), 6) AS cc,
  round(sum(a * y), 6) AS ay, round(sum(b * y), 6) AS by, round(sum(c * y), 6) AS cy FROM {SCORES_WIDE}"""


@query("bl_nnls_gram", _GR)
def bl_nnls_gram(spark, d):
    st = B.gram(scores_wide(spark, d), ["a", "b", "c"], "y")[()]
    g, b = st[3], st[4]
    row = [float(v) for v in (g[0, 0], g[0, 1], g[0, 2], g[1, 1], g[1, 2], g[2, 2], *b)]
    return rounded(spark.createDataFrame([row], "aa double, ab double, ac double, bb double, bc double, cc double, ay double, by double, cy double"), 6)


@query("bl_nnls")
def bl_nnls(spark, d):
    s = scores_wide(spark, d)
    w = B.nnls_weights(B.gram(s, ["a", "b", "c"], "y")[()])
    return s.select("row_id", "y", B.linear(["a", "b", "c"], w).alias("score"))


@query("bl_nnls_cv")
def bl_nnls_cv(spark, d):
    s = scores_wide(spark, d)
    per = B.fold_weights(B.gram(s, ["a", "b", "c"], "y", ["fold"]))
    blended = s.withColumn("score", B.pick_by_fold("fold", {f: B.linear(["a", "b", "c"], w) for f, w in per.items()}))
    return blended.groupBy("fold").agg(row_count().alias("n"), M.rmse("y", "score").alias("rmse"))


@query("bl_ridge_meta")
def bl_ridge_meta(spark, d):
    s = scores_wide(spark, d)
    alphas = [10 ** (-3 + 5 * i / 19) for i in range(20)]
    per = B.ridge_by_fold(s, ["a", "b", "c"], "y", "fold", alphas)
    blended = s.withColumn("score", B.pick_by_fold("fold", {f: B.linear(["a", "b", "c"], w, b) for f, (_, w, b) in per.items()}))
    alpha = B.pick_by_fold("fold", {f: F.lit(a) for f, (a, _, _) in per.items()})
    return blended.groupBy("fold").agg(row_count().alias("n"), M.rmse("y", "score").alias("rmse"), F.max(alpha).alias("alpha"))


@query("bl_fold_bag", f"SELECT row_id, round(avg(score * (1 + fold / 10.0)), 10) AS score FROM (SELECT row_id, score, f AS fold FROM {SCORES}, range(5) t(f) WHERE run = 'a') GROUP BY 1")
def bl_fold_bag(spark, d):
    s = scores(spark, d).filter("run = 'a'").select("row_id", "score", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f"))
    return rounded(B.mean_score(s.withColumn("score", C("score") * (1 + C("f") / 10.0)), ["row_id"]), 10)


@query("bl_seed_average", f"""WITH s AS (SELECT row_id, y, seed::INT AS seed, score * (1 + ((row_id * seed) % 7) / 70.0::DOUBLE) AS score FROM {SCORES}, range(3) t(seed) WHERE run = 'a'),
  u AS (SELECT 'seed' || seed::VARCHAR AS name, row_id, y, score FROM s UNION ALL SELECT 'mean', row_id, y, round(avg(score), 12) FROM s GROUP BY row_id, y) SELECT name, round(auc, 8) AS auc FROM ({auc_sql('u', ['name'])})""")
def bl_seed_average(spark, d):
    s = scores(spark, d).filter("run = 'a'").select("row_id", "y", "score", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed"))
    s = s.withColumn("score", C("score") * (1 + ((C("row_id") * C("seed")) % 7) / 70.0))
    mean = B.mean_score(s, ["row_id", "y"]).select(F.lit("mean").alias("name"), "y", F.round("score", 12).alias("score"))
    each = s.select(F.concat(F.lit("seed"), C("seed").cast("string")).alias("name"), "y", "score")
    return rounded(M.roc_auc(each.unionByName(mean), ["name"]), 8)


@query("bl_swap_average", f"""SELECT row_id, (m0[1] + m1[2]) / 2 AS p_a, (m0[2] + m1[1]) / 2 AS p_b, (m0[3] + m1[3]) / 2 AS p_tie FROM (SELECT row_id, list(score ORDER BY c) FILTER (run = 'm0') AS m0, list(score ORDER BY c) FILTER (run = 'm1') AS m1 FROM {CLASS_RUNS} GROUP BY 1)""")
def bl_swap_average(spark, d):
    s = class_runs(spark, d).select("row_id", B.swap_average("m0", "m1", [1, 0, 2]).alias("p"))
    return s.select("row_id", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p_a", "p_b", "p_tie"))])


@query("bl_align_classes", f"SELECT row_id, c AS code, CASE WHEN c = 3 THEN 0.0 ELSE score END AS score FROM {CLASS_RUNS} WHERE run = 'm0'")
def bl_align_classes(spark, d):
    names = [f"class {c}" for c in range(K)]
    long = class_runs_long(spark, d).filter("run = 'm0' and c <> 3")
    named = long.select("row_id", F.concat(F.lit("class "), C("c").cast("string")).alias("class"), "score")
    return B.align_classes(named, names)


@query("bl_pick_best", f"SELECT run, round(auc, 10) AS auc FROM ({auc_sql(SCORES, ['run'])}) ORDER BY auc DESC, run LIMIT 1")
def bl_pick_best(spark, d):
    return rounded(B.pick_best(M.roc_auc(scores(spark, d), ["run"]), "run", "auc"), 10)


@query("bl_available_members", f"""SELECT run, count(score) FILTER (ok) AS n_scored, count(*) AS n_rows, count(score) FILTER (ok) = (SELECT count(*) FROM orders) AND count(*) = (SELECT count(*) FROM orders) AS usable
  FROM (SELECT run, score, NOT (run = 'b' AND row_id % 97 = 0) AS ok FROM {SCORES} WHERE NOT (run = 'c' AND row_id % 50 = 0)) GROUP BY 1""")
def bl_available_members(spark, d):
    s = scores(spark, d).filter(~((C("run") == "c") & (C("row_id") % 50 == 0)))
    s = s.withColumn("score", F.when((C("run") == "b") & (C("row_id") % 97 == 0), F.lit(float("nan"))).otherwise(C("score")))
    return B.available_members(s, table(spark, d, "orders").count())
