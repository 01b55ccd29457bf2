"""Fits side by side: all folds at once, and the scores of a search without a last fit."""

import threading

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from loomwright.operators import models as ML


def frame(spark, n=240):
    rng = np.random.default_rng(5)
    rows = [(i, float(a + rng.normal() > 0), i % 3, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return ML.assemble(spark.createDataFrame(rows, "row_id int, y double, fold int, a double, b double"), ["a", "b"]).cache()


def test_folds_are_fitted_at_the_same_time(spark):
    meet, logit = threading.Barrier(3, timeout=60), ML.logistic()

    def fit(train):
        meet.wait()  # with one fold after the other nobody comes
        return logit(train)

    df = frame(spark)
    got = ML.oof_loop(df, [0, 1, 2], fit, ["row_id", "y"]).collect()
    alone = ML.oof_loop(df, [0, 1, 2], logit, ["row_id", "y"], at_once=1).collect()
    assert sorted(got) == sorted(alone) and len(got) == 240


def test_search_fits_each_fold_and_no_more(spark):
    df, fits = frame(spark), []

    class Counted(LogisticRegression):
        def _fit(self, dataset):
            fits.append(dataset)
            return super()._fit(dataset)

    space = {"regParam": lambda r: 10 ** r.uniform(-3, 0), "elasticNetParam": [0.0, 0.5, 1.0]}
    found = ML.random_search(df, Counted(featuresCol="features", labelCol="y", maxIter=15), space, 2, 3)
    assert len(fits) == 6
    est = LogisticRegression(featuresCol="features", labelCol="y", maxIter=15)
    maps = [{est.getParam(n): v for n, v in p.items()} for p, _ in found]
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=3, foldCol="fold")
    assert np.allclose(cv.fit(df).avgMetrics, [s for _, s in found])


def test_members_are_read_once_for_all_folds(spark, monkeypatch):
    stored = []
    keep = ML.cut
    monkeypatch.setattr(ML, "cut", lambda df: stored.append(df) or keep(df))
    df = frame(spark).select("row_id", "y", "fold", "a", "b").withColumn("y", F.col("y"))
    assert ML.stack_logistic(df, ["a", "b"], [0, 1, 2]).count() == 240 and len(stored) == 1


def test_adversarial_rows_are_stored_before_the_folds(spark, monkeypatch):
    from loomwright.queries import models as Q

    seen = []
    monkeypatch.setattr(Q.ML, "oof_loop", lambda df, *a, **k: seen.append(df) or df.selectExpr("l_orderkey", "y", "'oof' split", "fold fold_no", "y score"))
    Q.dr_adversarial(spark, "/root/testdata/sf0.001").collect()
    assert all("/cut/" in f for f in seen[0].inputFiles())


def test_boosted_trees_on_cells_are_those_on_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=12000), rng.integers(0, 9, 12000), np.where(rng.random(12000) < 0.5, 0.0, rng.exponential(size=12000))
    y = (a + 0.3 * b - c + rng.normal(size=12000) > 1).astype(float)
    rows = [(i, float(y[i]), i % 3, float(a[i]), float(b[i]), float(c[i])) for i in range(12000)]
    df = ML.assemble(spark.createDataFrame(rows + rows[:50], "row_id int, y double, fold int, a double, b double, c double"), ["a", "b", "c"])
    fitted, plain = [], ML.GBTClassifier._fit
    monkeypatch.setattr(ML.GBTClassifier, "_fit", lambda self, data: fitted.append(data.count()) or plain(self, data))

    def scores():
        return ML.oof_loop(df, [0, 1, 2], ML.boosted(rounds=4), ["row_id", "y"]).orderBy("row_id", "score").toPandas()

    cells = scores()
    # what is trained on are the cells of one label: 32 * 9 * 32 of them at most, though there are many more rows
    assert len(fitted) == 3 and all(n < 6000 for n in fitted)
    monkeypatch.setattr(ML, "CELLS", 0)
    whole = scores()
    assert all(n > 8000 for n in fitted[3:]) and cells.score.nunique() > 20
    assert (cells.row_id == whole.row_id).all() and np.allclose(cells.score, whole.score, atol=1e-12, rtol=0)
