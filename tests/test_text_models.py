"""Text classifiers inside folds: naive Bayes against plain numpy, and nothing of a fold in its own model."""

import re
from collections import Counter

import numpy as np
import pytest

from loomwright.operators import models as ML
from loomwright.operators import text_models as TM

FOLDS = [0, 1, 2]
WORDS = "storm fire calm happy rain river party flood cake sun".split()


def rows(seed=2, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < .5)
        odds = np.array([3, 3, 1, 1, 1, 1, 1, 3, 1, 1] if y else [1, 1, 3, 3, 1, 1, 3, 1, 3, 1], float)
        pick = rng.choice(WORDS, rng.integers(1, 7), p=odds / odds.sum())
        out.append((i, float(y), " ".join(pick) + (" ab\u00e9" if i % 9 == 0 else ""), i % 3))
    return [*out, (n, 1.0, "", 0), (n + 1, 0.0, None, 1)]


def frame(spark, data):
    return spark.createDataFrame(data, "row_id int, y double, text string, fold int").repartition(3)


def terms(text):
    plain = re.findall(r"\w{2,}", (text or "").lower().replace("\u00e9", "e"))
    word = Counter(plain) + Counter(f"{a} {b}" for a, b in zip(plain, plain[1:]))
    char = Counter(f" {w} "[k:k + n] for w in (text or "").lower().split() for n in (3, 4, 5) for k in range(len(w) + 3 - n))
    return {"word": word, "char": char}


def plain_nb(data, alpha=.3):
    counted = {i: terms(t) for i, _, t, _ in data}
    scores = {}
    for f in FOLDS:
        train = [r for r in data if r[3] != f]
        df = {k: Counter(t for i, *_ in train for t in counted[i][k]) for k in TM.LEAST}
        known = {k: {t: n for t, n in df[k].items() if n >= TM.LEAST[k]} for k in df}

        def vector(i):
            out = {}
            for k in known:
                w = {(k, t): (1 + np.log(c)) * (np.log((1 + len(train)) / (1 + known[k][t])) + 1) for t, c in counted[i][k].items() if t in known[k]}
                size = np.sqrt(sum(x * x for x in w.values()))
                out.update({t: x / size for t, x in w.items()})
            return out

        share = {}
        for y in (0, 1):
            total = Counter({(k, t): alpha for k in known for t in known[k]})
            for i, label, *_ in train:
                if label == y:
                    total.update(vector(i))
            whole = sum(total.values())
            share[y] = {t: np.log(x / whole) for t, x in total.items()}
        for i, *_, fold in data:
            if fold == f:
                scores[i] = 1 / (1 + np.exp(-sum(x * (share[1][t] - share[0][t]) for t, x in vector(i).items())))
    return scores


def test_naive_bayes_equals_a_plain_one(spark):
    got = {r["row_id"]: r["score"] for r in TM.complement_nb(frame(spark, rows()), "row_id", "text", FOLDS).collect()}
    want = plain_nb(rows())
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want) and got[60] == 0.5


def test_word_and_character_terms_of_one_array(spark):
    text = "Storm at\u00e9 a storm"
    got = Counter(frame(spark, [(1, 0.0, text, 0)]).select(TM.text_terms("text")).first()[0])
    want = terms(text)
    assert got == Counter({**{f"w{t}": n for t, n in want["word"].items()}, **{f"c{t}": n for t, n in want["char"].items()}})


@pytest.mark.parametrize("kind", ["nb", "svc"])
def test_a_fold_says_nothing_about_its_own_model(spark, kind):
    """Texts and labels of all other validation rows change; the score of one that stays does not."""
    def scores(data):
        df = frame(spark, data).filter("text is not null")
        if kind == "nb":
            out = TM.complement_nb(df, "row_id", "text", FOLDS)
        else:
            out = ML.oof_loop(TM.hashed_counts(df, "text", 1 << 10), FOLDS, ML.svc(), ["row_id", "y"], TM.hashed_tfidf)
        return {r["row_id"]: r["score"] for r in out.collect()}

    before = scores(rows())
    after = scores([r if r[3] != 0 or r[0] == 3 else (r[0], 1 - r[1], "storm new words here", 0) for r in rows()])
    assert before[3] == pytest.approx(after[3], abs=1e-12) and before[6] != after[6]
    assert len(before) == len(after) == 61


def test_net_stops_on_labels_that_are_noise(spark):
    """Labels drawn at random: the validation loss soon rises, the best round is kept, and a clear label trains on."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6))
    rows = [(*map(float, r), float(rng.random() < .5), float(r[0] + r[1] > 0), i % 3 == 0) for i, r in enumerate(x)]
    df = ML.assemble(spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(6)) + ", noise double, clear double, held boolean"), [f"x{i}" for i in range(6)])
    noise = ML.perceptron_with_stop([6, 12, 2], "held", round_iter=10, max_rounds=15, patience=2)(df.withColumnRenamed("noise", "y"))
    assert len(noise.losses) < 15 and noise.best == int(np.argmin(noise.losses[:noise.best + 1])) and len(noise.losses) - 1 - noise.best == 2
    held = df.filter("held").withColumnRenamed("noise", "y")
    assert ML.log_loss_of(noise.transform(held)) == pytest.approx(noise.losses[noise.best])
    clear = ML.perceptron_with_stop([6, 12, 2], "held", round_iter=10, max_rounds=6, patience=2)(df.withColumnRenamed("clear", "y"))
    assert clear.losses[clear.best] < 0.2 < noise.losses[noise.best]


def test_regressions_do_not_see_their_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(3 * a + rng.normal(0, .1)), i % 3) for i, a in enumerate(rng.normal(size=90))]

    def scores(data):
        df = ML.assemble(spark.createDataFrame(data, "row_id int, x double, y double, fold int"), ["x"])
        out = ML.regressions_oof(df, FOLDS, {"ridge": ML.linear_member(0.01, 0.0), "lasso": ML.linear_member(0.01, 1.0)})
        return {r["row_id"]: (r["ridge"], r["lasso"]) for r in out.collect()}

    before, after = scores(rows), scores([(i, x, y + 50 if f == 0 else y, f) for i, x, y, f in rows])
    assert len(before) == 90 and all(np.allclose(before[i], after[i]) for i in range(0, 90, 3)) and not np.allclose(before[1], after[1])
    assert all(abs(before[i][0] - y) < 1 for i, _, y, _ in rows)


def test_rows_of_a_document_and_term_are_not_stored(spark, monkeypatch):
    """A term's class sums leave a block once, however many documents have it (before: a row for each of them)."""
    stored = []
    monkeypatch.setattr(TM, "cut", lambda df: stored.append(df.localCheckpoint()) or stored[-1])
    data = [(i, float(i % 2), "storm fire calm", i % 3) for i in range(60)]
    assert TM.complement_nb(frame(spark, data), "row_id", "text", FOLDS).count() == 60
    many = {len(terms("storm fire calm")["word"]) + len(terms("storm fire calm")["char"])}
    assert {df.count() for df in stored if "term" in df.columns} == many


def test_hashed_features_equal_those_of_spark_ml(spark, monkeypatch):
    """Places, counts and weights are spark.ml's; what is stored for all folds is packed, without the text (before: vectors, and the text)."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.sql import functions as F

    monkeypatch.setattr(TM, "COUNTED", 40)
    data = [*rows(), (90, 1.0, "straße 日本語 x naïve \U0001f600\U0001f600 a_b storm storm " + "long" * 30, 2)]
    df = frame(spark, data)
    for features in (1 << 10, 1 << 18):
        terms = df.withColumn("t", F.coalesce(TM.text_terms("text"), F.array().cast("array<string>")))
        plain = HashingTF(inputCol="t", outputCol="tf", numFeatures=features).transform(terms)
        idf = IDF(inputCol="tf", outputCol="w", minDocFreq=2).fit(plain.filter("fold <> 1"))
        want = {r["row_id"]: r["x"] for r in Normalizer(inputCol="w", outputCol="x").transform(idf.transform(plain)).collect()}
        counted = TM.hashed_counts(df, "text", features)
        assert counted.columns == ["row_id", "y", "fold", "tf"] and dict(counted.dtypes)["tf"] == "struct<at:binary,n:binary>"
        got = {r["row_id"]: r["features"] for r in TM.hashed_tfidf().fit(counted.filter("fold <> 1")).apply(counted).collect()}
        assert got.keys() == want.keys() and all(got[i].size == features and list(got[i].indices) == list(want[i].indices) for i in want)
        assert all(np.allclose(got[i].values, want[i].values, rtol=1e-12, atol=0) for i in want) and len(got[60].indices) == 0
