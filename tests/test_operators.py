"""Exact values and invariants of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as FT
from loomwright.operators import anomaly as A
from loomwright.operators import blend as B
from loomwright.operators import checks, decide, encode, history, metrics, missing, neighbours, profile, publish, sets
from loomwright.operators import target_encoding as TE
from loomwright.operators import text as T


def one(df):
    return df.first()[0]


def scored(spark, pairs):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(pairs)], "row_id int, y int, score double")


def test_auc_values(spark):
    assert one(metrics.roc_auc(scored(spark, [(0, .1), (0, .2), (1, .8), (1, .9)]), [])) == 1.0
    assert one(metrics.roc_auc(scored(spark, [(1, .1), (1, .2), (0, .8), (0, .9)]), [])) == 0.0
    assert one(metrics.roc_auc(scored(spark, [(0, .5), (1, .5), (0, .5), (1, .5)]), [])) == 0.5
    assert one(metrics.roc_auc(scored(spark, [(1, .5), (1, .5)]), [])) is None


def test_average_precision(spark):
    # ranked 1, 0, 1: (1 + 2/3) / 2
    got = one(metrics.average_precision(scored(spark, [(1, .9), (0, .8), (1, .7)]), []))
    assert got == pytest.approx((1 + 2 / 3) / 2)


def test_map3(spark):
    df = spark.createDataFrame([(0, .6, .3, .1, .0), (1, .6, .3, .1, .0), (2, .6, .3, .1, .0)], "y int, a double, b double, c double, d double")
    got = one(df.agg(metrics.mapk([F.col(c) for c in "abcd"], "y")))
    assert got == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    tied = spark.createDataFrame([(3, .25, .25, .25, .25)], "y int, a double, b double, c double, d double")
    assert one(tied.agg(metrics.mapk([F.col(c) for c in "abcd"], "y"))) == 0.0


def test_balanced_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0), (2, 1)], "y int, pred int")
    assert one(metrics.balanced_accuracy(df, "pred")) == pytest.approx((1 + .5 + 0) / 3)


def test_threshold_f1_brute_force(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(rng.random() < .4), round(float(rng.random()), 1)) for _ in range(120)]
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    u = np.unique(s)
    best_t, best = .5, -1.0
    for t in np.r_[0.0, (u[:-1] + u[1:]) / 2, 1.0]:
        p = s >= t
        tp = (p & (y == 1)).sum()
        f1 = 2 * tp / (p.sum() + y.sum()) if p.sum() + y.sum() else 0.0
        if f1 > best:
            best_t, best = t, f1
    got = decide.threshold_f1(scored(spark, pairs), []).first()
    assert got["threshold"] == pytest.approx(best_t) and got["f1"] == pytest.approx(best)


def test_precision_floor_error(spark):
    with pytest.raises(Exception, match="no threshold reaches"):
        decide.precision_floor(scored(spark, [(0, .9), (1, .1)]), [], 0.99).collect()


def test_tuned_weights_never_worse(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.choice(3, p=[.8, .15, .05])), *map(float, rng.dirichlet([4, 2, 1]))) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double").cache()
    scorer = lambda pairs: decide.score_weights(df, ["p0", "p1", "p2"], "y", [w for _, w in pairs])
    prior = [np.mean([r[0] == c for r in rows]) for c in range(3)]
    (w, best), = decide.tune_weights(scorer, prior, rounds=2, grid=7)
    start = [1 / p for p in prior]
    assert best >= scorer([(0, start)])[0] and np.mean(w) == pytest.approx(1.0)
    (w2, best2), = decide.tune_weights_geo(scorer, 3, rounds=1, grid=7)
    assert best2 >= scorer([(0, [1, 1, 1])])[0]


def test_majority_vote(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(decide.majority_vote("a", "b", "c")).collect()] == [1, 1, 0, 0]


def test_label_repair(spark):
    df = spark.createDataFrame([("t", 1), ("t", 1), ("t", 0), ("u", 1), ("u", 0), ("v", 1)], "text string, y int")
    got = sorted((r["text"], r["y"]) for r in decide.repair_conflicts(df, "text", "y").collect())
    assert got == [("t", 1)] * 3 + [("u", 0)] * 2 + [("v", 1)]


def test_label_repair_keeps_rows_without_text(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), ("t", 1), ("t", 0), ("t", None)], "text string, y int")
    got = [(r["text"], r["y"]) for r in decide.repair_conflicts(df, "text", "y").collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (None, 0)] + [("t", 0)] * 3, key=str)


def test_rank_blend_keeps_rows_without_score(spark):
    df = spark.createDataFrame([("a", 1, .2), ("a", 2, None), ("a", 3, .9), ("b", 1, .5), ("b", 2, .1), ("b", 3, .7)], "run string, id int, score double")
    got = {r["id"]: r["score"] for r in B.rank_blend(df, ["run"], ["id"]).collect()}
    assert got == {1: pytest.approx((1 / 2 + 2 / 3) / 2), 2: None, 3: pytest.approx(1.0)}


def test_hillclimb_takes_first_of_equals_and_respects_steps():
    picks, best, trace = B.hillclimb(lambda trials: [float(sum(t.values())) for t in trials], ["a", "b"], steps=3)
    assert picks == {"a": 3} and best == 3.0 and trace == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]


def test_head_tail_and_assembly(spark):
    df = spark.createDataFrame([("a b c d e f g", "x"), ("a b", None)], "t string, u string")
    t = F.split("t", " ")
    assert [r[0] for r in df.select(T.head_tail(t, 5)).collect()] == [["a", "b", "e", "f", "g"], ["a", "b"]]
    packed = df.select(T.assemble([T.Field("P: ", F.col("t"), 1), T.Field("", F.lit("y z"), 1)], 11)).collect()
    assert packed[0][0] == ["[CLS]", "P:", "a", "f", "g", "[SEP]", "y", "z", "[SEP]"]


def test_nnls_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.random((200, 4))
    y = x @ np.array([.7, 0, .3, 0]) - .4 * x[:, 3] + rng.normal(0, .01, 200)
    w = B.nnls(x.T @ x, x.T @ y)
    assert (w >= 0).all()
    pull = x.T @ (y - x @ w)
    assert np.all(pull[w == 0] <= 1e-6) and np.allclose(pull[w > 0], 0, atol=1e-6)


def test_ridge_by_fold_matches_dense(spark):
    rng = np.random.default_rng(4)
    x = rng.random((90, 3))
    y = x @ [1.0, -.5, .2] + rng.normal(0, .3, 90)
    df = spark.createDataFrame([(*map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    alphas = [0.01, 0.1, 1.0, 10.0]
    got = B.ridge_by_fold(df, ["a", "b", "c"], "y", "fold", alphas)
    for f in range(3):
        tr = np.arange(90) % 3 != f
        xc, yc = x[tr] - x[tr].mean(0), y[tr] - y[tr].mean()
        loo = []
        for a in alphas:
            h = xc @ np.linalg.inv(xc.T @ xc + a * np.eye(3)) @ xc.T
            loo.append((((yc - h @ yc) / (1 - np.diag(h) - 1 / tr.sum())) ** 2).sum())
        a = alphas[int(np.argmin(loo))]
        w = np.linalg.solve(xc.T @ xc + a * np.eye(3), xc.T @ yc)
        assert got[f][0] == a and np.allclose(got[f][1], w)


def test_hillclimb_stops_and_never_loses():
    table = {("a",): .5, ("b",): .6, ("c",): .4}
    score = lambda trials: [table.get(tuple(sorted(t)), .61 if set(t) == {"a", "b"} and sum(t.values()) == 2 else .55) for t in trials]
    picks, best, trace = B.hillclimb(score, ["a", "b", "c"])
    assert best >= .6 and trace[0][1] == "b" and sum(picks.values()) == len(trace)


def test_history_example(spark):
    rows = spark.createDataFrame([(1, -20, -18, 100, 80), (1, -10, -12, 100, 100), (2, -5, -5, 50, 50)], "client int, days_due int, days_paid int, due int, paid int")
    full = rows.withColumns({"months": F.lit(-1), "instalments": F.lit(1), "dpd": F.lit(0), "line_status": F.lit("Active"), "balance": F.lit(1),
                             "credit_limit": F.lit(1), "min_due": F.lit(1), "number": F.lit(1)})
    out = {r["client"]: r for r in history.aggregate_sets([history.instalment_set(history.line_columns(full))], "client")[0].collect()}
    assert out[1]["INSTAL_DAYS_LATE_MAX"] == 2 and out[1]["INSTAL_SHORTFALL_SUM"] == 20 and out[1]["INSTAL_IS_LATE_MEAN"] == .5
    assert out[2]["INSTAL_RECORD_COUNT"] == 1


def test_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    row = df.groupBy("k").agg(*history.stat_list(["x"], "P")).first()
    assert row["P_X_SUM"] == 0 and row["P_X_MEAN"] is None


def test_leave_one_out_excludes_own_label(spark):
    long = spark.createDataFrame([(i, "c", "k", y) for i, y in enumerate([1, 0, 1])], "row_id int, combo string, key string, y int")
    got = {r["row_id"]: r["te1"] for r in TE.leave_one_out(long, "y", 0.0, [.5, .5], 2).collect()}
    assert got == {0: .5, 1: 1.0, 2: .5}
    alone = spark.createDataFrame([(0, "c", "k", 1)], "row_id int, combo string, key string, y int")
    assert TE.leave_one_out(alone, "y", 0.0, [.3, .7], 2).first()["te1"] == .7


def test_kfold_encoding_ignores_own_fold(spark):
    rows = [(i, "c", "k", i % 2, i % 2) for i in range(8)]
    long = spark.createDataFrame(rows, "row_id int, combo string, key string, y int, fold int")
    got = {r["te1"] for r in TE.kfold_oof(long.filter("fold = 1"), "y", "fold", 0.0, [.5, .5], 2).collect()}
    assert got == {.5}  # nothing but the prior is left outside the fold
    both = {(r["fold"], r["te1"]) for r in TE.kfold_oof(long, "y", "fold", 0.0, [.5, .5], 2).collect()}
    assert both == {(0, 1.0), (1, 0.0)}


def test_row_alone_equals_row_in_batch(spark):
    train = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(10)], "x double, c string")
    chain = encode.family_chain("linear", ["x"], {}, ["c"]).fit(train)
    alone = chain.apply(train.filter("x = 3")).first()
    assert alone == chain.apply(train).filter(F.col("c_b") == 1).orderBy("x").collect()[1]


def test_stage_errors(spark):
    with pytest.raises(ValueError):
        encode.family_chain("other", [], {}, [])
    with pytest.raises(RuntimeError):
        encode.standard_scaler(["x"]).apply(spark.range(1))


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(Exception, match="unknown class"):
        encode.encode_label(df, "c", ["a"], "code").collect()


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        checks.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert missing.mode_values(df, ["c"]) == {"c": "a"}


def test_text_cleaning(spark):
    raw = "Fire &amp; SMOKE!! @bob see http://t.co/x #wildfire  &lt;now&gt; &#233;&eacute &notit; &#128;"
    df = spark.createDataFrame([(raw,)], "t string")
    import html
    assert one(df.select(FT.unescape_html("t"))) == html.unescape(raw)
    assert one(df.select(FT.clean_full("t"))) == "fire smoke!! see wildfire now it"
    assert one(df.select(FT.url_unquote(F.lit("forest%20fire+x")))) == "forest fire+x"
    assert one(df.select(FT.url_unquote(F.lit("100%zz")))) == "100%zz"


def test_parse_turns(spark):
    df = spark.createDataFrame([('["a", null, 3, "b"]',), ("[oops",), ('"x"',), ("[]",)], "c string")
    assert [list(r[0]) for r in df.select(T.parse_turns("c")).collect()] == [["a", "", "", "b"], ["[oops"], ["x"], []]


def test_parse_label(spark):
    texts = ['{"label": 0}', "I think 0 then 1", "not a disaster", "a real one", "", "hm"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.parse_label("t")).collect()] == [0, 1, 0, 1, None, None]


def test_char_grams_of_short_words(spark):
    df = spark.createDataFrame([(1, "ab ab c")], "id int, t string")
    got = {r["term"]: r["tf"] for r in T.char_counts(df, "id", "t").collect()}
    assert got == {" ab": 2, "ab ": 2, " ab ": 2, " c ": 1}


def test_word_terms(spark):
    df = spark.createDataFrame([(1, "Été à la Mer la mer"), (2, "x")], "id int, t string")
    got = {r["term"]: r["tf"] for r in T.word_counts(df, "id", "t").filter("id = 1").collect()}
    assert got == {"ete": 1, "la": 2, "mer": 2, "ete la": 1, "la mer": 2, "mer la": 1}


def brute_knn(a, b, k, same=False):
    out = {}
    for i, x in a.items():
        d = sorted((math.dist(x, y), j) for j, y in b.items() if not (same and i == j))
        out[i] = [j for _, j in d[:k]]
    return out


def test_knn_of_one_bucket_is_exact(spark):
    rng = np.random.default_rng(5)
    # half of the points sit in one tight cluster
    pts = {i: tuple(map(float, rng.normal(0, .01 if i % 2 else 3, 4))) for i in range(120)}
    df = spark.createDataFrame([(i, list(p), True) for i, p in pts.items()], "id long, v array<double>, base boolean")
    got = {}
    for r in neighbours.knn(df, 3, "id", "v").orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append(r["bid"])
    assert got == brute_knn(pts, pts, 3, True)


def test_knn_buckets_are_full_and_find_most(spark):
    """A third of the rows are copies of one point, the rest clusters: equal buckets, and a recall well above chance."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (60, 16))
    pts = {i: tuple(map(float, centres[0] if i % 3 == 0 else centres[i % 60] + rng.normal(0, .15, 16))) for i in range(3000)}
    df = spark.createDataFrame([(i, list(p), i % 5 < 4) for i, p in pts.items()], "id long, v array<double>, base boolean").repartition(5)
    sizes = neighbours.bucketed(df, "id", "v", bucket=128).groupBy("tab", "bucket").count().agg(F.max("count"), F.min("count"), F.count("*")).first()
    assert sizes[0] <= 128 and sizes[1] >= 120 and sizes[2] == neighbours.TABLES * 24
    got = {}
    for r in neighbours.knn(df, 10, "id", "v", bucket=128).collect():
        got.setdefault(r["qid"], set()).add(r["bid"])
        assert r["bid"] % 5 < 4 and r["bid"] != r["qid"]
    x = np.array([pts[i] for i in range(3000)])
    base = np.array([i for i in range(3000) if i % 5 < 4])
    found = total = 0
    for q in range(1, 3000, 29):
        if q % 3:
            d = np.sqrt(((x[base] - x[q]) ** 2).sum(1))
            near = [b for _, b in sorted(zip(d, base)) if b != q][:10]
            found, total = found + len(got[q] & set(near)), total + 10
    assert all(len(g) == 10 for g in got.values()) and len(got) == 3000 and found / total >= .9


def test_smote_lies_between(spark):
    rows = [(i, [float(i), 0.0], int(i < 6)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = A.smote(df, "id", "v", F.col("y") == 1, k=2).collect()
    assert len(out) == 8
    for r in out:
        lo, hi = sorted((r["base_id"], r["neighbour_id"]))
        assert lo <= r["v"][0] <= hi and r["base_id"] != r["neighbour_id"] and hi < 6


def test_isolation_forest_finds_outlier(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(300)] + [(300, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = A.isolation_forest(df, df, "id", ["a", "b"], trees=30, size=64).orderBy(F.desc("score")).first()
    assert out["id"] == 300 and 0 < out["score"] < 1


def plain_forest(rows, trees, size, seed):
    """Tree by tree, row by row, on samples picked by a full sort."""
    x = np.array([r[1:] for r in rows])
    limit = math.ceil(math.log2(size))
    turn = A._mixed((np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * A._SPREAD[0])
    total = np.zeros(len(x))
    for t in range(trees):
        marks = A._mixed(np.array([r[0] for r in rows], np.int64).view(np.uint64) ^ turn[t])
        order = sorted(range(len(x)), key=lambda k: (marks[k], *x[k]))[:size]
        tree = A._grow(x[order], np.random.default_rng([seed, t]), limit)
        for k, row in enumerate(x):
            at = 0
            while tree["child"][at] != at:
                at = tree["child"][at] + (row[tree["feature"][at]] >= tree["threshold"][at])
            total[k] += tree["path"][at]
    return 2.0 ** (-total / trees / A.average_path(min(size, len(x))))


def test_isolation_forest_equals_a_plain_one_on_any_partitioning(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))], "id long, a double, b double")
    marked = df.select(F.xxhash64("id", "a", "b"), "a", "b", "id").orderBy("id").collect()
    want = plain_forest([tuple(r)[:3] for r in marked], 12, 32, 5)
    first = None
    for parts in (1, 7):
        got = [r["score"] for r in A.isolation_forest(df.repartition(parts), df, "id", ["a", "b"], trees=12, size=32, seed=5).orderBy("id").collect()]
        assert np.allclose(got, want, rtol=1e-12) and (first is None or got == first)
        first = got
    assert A.isolation_forest(df.limit(0), df, "id", ["a", "b"], trees=3).filter("score is null").count() == 500


def test_t_test_p_value():
    assert profile.t_two_sided_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert profile.t_two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_validation_report(spark):
    t = spark.createDataFrame([(1,), (2,)], "id int")
    good = spark.createDataFrame([(1, .2), (2, .4)], "id int, prediction double")
    publish.require_valid(publish.validate(good, t, "id", "prediction", 0, 1, ["id", "prediction"]))
    bad = spark.createDataFrame([(1, 1.5), (3, float("nan"))], "id int, prediction double")
    with pytest.raises(ValueError, match="n_missing_ids=1"):
        publish.require_valid(publish.validate(bad, t, "id", "prediction", 0, 1, ["id", "prediction"]))


def test_undersample_and_keep(spark):
    df = spark.range(50).withColumn("y", (F.col("id") < 7).cast("int"))
    got = {r["y"]: r["count"] for r in sets.undersample(df, "id", "y").groupBy("y").count().collect()}
    assert got == {0: 7, 1: 7}
    assert sets.keep_positives(df, "id", F.col("y") == 1, 10).count() == 17


def test_sparse_onehot_of_many_levels(spark):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 100_000).cast("string").alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("d"))
    out = encode.sparse_onehot(["c", "d"], missing_level=True).fit(df).apply(df.union(spark.createDataFrame([(-1, "new", 9)], "id long, c string, d long")))
    rows = {r["id"]: r["onehot"] for r in out.filter("id < 4 or id = 99999").collect()}
    place = {c: i for i, c in enumerate(sorted(str(k) for k in range(100_000)))}
    assert all(r["size"] == 100_004 for r in rows.values()) and rows[-1]["indices"] == []
    assert rows[0]["indices"] == [place["0"], 100_003] and rows[1]["indices"] == [place["1"], 100_001] and rows[2]["indices"] == [place["2"], 100_002]
    assert out.select(F.explode("onehot.indices").alias("i")).filter("i < 100000").distinct().count() == 100_000


def test_cooccurrence_of_many_labels(spark):
    rng = np.random.default_rng(1)
    rows = [(r, f"l{v:03d}") for r in range(40) for v in rng.choice(400, 30, replace=False)] + [(50, "l001"), (50, "l001"), (51, None), (52, "l001"), (52, "l002"), (53, "l001"), (53, "l002")]
    df = spark.createDataFrame(rows, "r int, label string")
    want, by = {}, {}
    for r, v in rows:
        by.setdefault(r, set()).add(v)
    for labels in by.values():
        for a in labels:
            for b in labels:
                if a is not None and b is not None and a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for block in (64, 7):
        assert {(r["label_a"], r["label_b"]): r["n"] for r in history.cooccurrence(df, "r", "label", block).collect()} == want


def test_exact_neighbours_are_all_the_nearest(spark):
    """Spread-out points in 12 dimensions with copies, in small blocks: the bucket search misses some of their neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)) + 1000
    x[700:760] = x[0]
    base = np.arange(900) % 5 < 4
    df = spark.createDataFrame([(i, [float(c) for c in v], bool(b)) for i, (v, b) in enumerate(zip(x, base))], "id long, v array<double>, base boolean")
    got = {}
    for r in neighbours.knn_exact(df, 6, "id", "v", block=200).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append(r["bid"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {i: sorted((j for j in range(900) if base[j] and j != i), key=lambda j: (d[i, j], j))[:6] for i in range(900)}
    assert got == want


def test_outer_chain_deals_the_widest_frame_once(spark):
    from loomwright.operators.joins import full_outer_chain

    def frame(ids, *names):
        return spark.createDataFrame([(k, *[k * 10 + i for i in range(len(names))]) for k in ids], ", ".join(f"{n} int" for n in ("k", *names)))

    wide, narrow, other = frame([1, 2, 3], "a", "b", "c", "d"), frame([2, 4], "e"), frame([1, 5], "f", "g")
    out = full_outer_chain([wide, narrow, other], "k")
    assert out.columns == ["k", "a", "b", "c", "d", "e", "f", "g"]
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (10, 11, 12, 13, None, 10, 11), 2: (20, 21, 22, 23, 20, None, None), 3: (30, 31, 32, 33, None, None, None),
                   4: (None, None, None, None, 40, None, None), 5: (None, None, None, None, None, 50, 51)}
    # the first join is of the narrow frames, the wide one comes after them
    plan = out._jdf.queryExecution().analyzed().toString()
    tail = plan[plan.rindex("FullOuter"):]
    assert max(tail.index("e#"), tail.index("f#")) < tail.index("a#")
