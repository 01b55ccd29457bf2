"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic; unlabelled are documents of any kind, their labels unused. Features are the
words of the whole text (runs of letters, lower case), each present or absent, weighted by the log ratio of its rates in
both samples, so that words which say nothing weigh nothing and long texts gain no score by length; words
whose rates differ by less than ``SURE`` standard errors are left out. Several linear models are trained in numpy on random halves, each by full-batch gradients of the risk

    prior * mean_P[loss(+g)] + max(0, mean_U[loss(-g)] - prior * mean_P[loss(-g)]),

the logistic loss and the class prior from the labels; where the second term is negative its gradient is walked back.
The mean of their probabilities is the score. Samples are bounded: about ``POSITIVES`` and ``UNLABELLED`` rows by a hash
of id and text (equal rows count once); they are trained on in one task, the driver gets the weights. All rows are scored.

NULL and empty texts have no words and score what the bias says. Without a positive every score is the prior's. Rows
that share a doc_id share a label: toxic if one label says so. Result columns replace columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.sampling import about, drawn
from loomwright.llm.words import slices

POSITIVES, UNLABELLED, LEAST_POSITIVES = 3000, 9000, 3
MODELS, STEPS, RATE, DECAY, SMOOTH, SURE = 5, 200, 0.1, 2e-4, 0.5, 4.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


@dataclass
class Model:
    """Weights of every model for each known word, and their biases."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray

    def score(self, text: str | None) -> float:
        g = self.bias.copy()
        for w in self.weights.keys() & words_of(text):
            g += self.weights[w]
        return float(_sigmoid(g).mean())


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


class _Rows:
    """Sparse rows of present words: forward and backward products."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.of = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.at = np.concatenate(rows) if rows else np.empty(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.of], self.width)


def direction(w: np.ndarray, pos: _Rows, unl: _Rows, ratio: np.ndarray, prior: float) -> np.ndarray:
    """Gradient by weights and bias (last) of the corrected risk; of the negative part alone, turned round, where that is below zero."""
    scaled, bias = w[:-1] * ratio, w[-1]
    gp, gu = pos.times(scaled) + bias, unl.times(scaled) + bias
    sp, su = _sigmoid(gp), _sigmoid(gu)
    negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
    # d loss(+g) = s - 1, d loss(-g) = s
    toward, unlabelled, back = prior * (sp - 1) / pos.n, su / unl.n, prior * sp / pos.n
    dp, du = (toward - back, unlabelled) if negative >= 0 else (back, -unlabelled)
    return np.concatenate([(pos.back(dp) + unl.back(du)) * ratio, [dp.sum() + du.sum()]])


def fit_one(pos: _Rows, unl: _Rows, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights by word and the bias of one non-negative PU model (Adam on the whole batch)."""
    width = len(ratio)
    w = np.zeros(width + 1)
    w[width] = np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        grad = direction(w, pos, unl, ratio, prior)
        grad[:width] += DECAY * w[:width]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:width] * ratio, w[width]


def train(positive: pa.ListArray, unlabelled: pa.ListArray, prior: float, seed: int = 3) -> Model:
    """Models of two lists of documents, each the list of its distinct words."""
    prior = min(max(prior, 1e-3), 0.999)
    n_pos, n_unl = len(positive), len(unlabelled)
    if not n_pos or not n_unl:
        return Model({}, np.full(1, np.log(prior / (1 - prior))))
    coded = pa.concat_arrays([positive.flatten(), unlabelled.flatten()]).dictionary_encode()
    codes, split = coded.indices.to_numpy(), len(positive.flatten())
    df_p, df_u = (np.bincount(c, minlength=len(coded.dictionary)) for c in (codes[:split], codes[split:]))
    rate_p, rate_u = (df_p + SMOOTH) / (n_pos + 2 * SMOOTH), (df_u + SMOOTH) / (n_unl + 2 * SMOOTH)
    both = (rate_p * n_pos + rate_u * n_unl) / (n_pos + n_unl)
    sure = np.abs(rate_p - rate_u) / np.sqrt(both * (1 - both).clip(1e-9) * (1 / n_pos + 1 / n_unl))
    known = np.flatnonzero((df_p >= min(LEAST_POSITIVES, n_pos)) & (sure >= SURE))
    names = coded.dictionary.take(pa.array(known)).to_pylist()
    order = sorted(range(len(known)), key=lambda k: (-sure[known[k]], names[k]))
    names, known = [names[k] for k in order], known[order]
    ratio = np.log(rate_p[known] / rate_u[known])
    place = np.full(len(coded.dictionary), -1)
    place[known] = np.arange(len(known))
    rows = [_known_words(place[c], docs) for c, docs in ((codes[:split], positive), (codes[split:], unlabelled))]
    rng = np.random.default_rng(seed)
    weights, bias = [], []
    for _ in range(MODELS):
        some = [_Rows([r[k] for k in sorted(rng.choice(len(r), max(1, len(r) * 2 // 3), replace=False))], len(names)) for r in rows]
        w, b = fit_one(*some, ratio, prior)
        weights.append(w)
        bias.append(b)
    stacked = np.array(weights).T
    return Model({w: stacked[k] for k, w in enumerate(names)}, np.array(bias))


def _known_words(places: np.ndarray, docs: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(docs.value_lengths().to_numpy())[:-1]
    return [np.sort(part[part >= 0]) for part in np.split(places, ends)]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Train on the rows that are not held out: whole texts, bounded samples, in one task; the driver gets the weights."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    pool = docs.select(F.col("doc_id"), F.col(text).alias("text")).filter("text is not null").filter(~held_out(F.col("doc_id")))
    # rows drawn go by id and text, so equal ones are drawn together and count once
    toxic = about(marks.filter("toxic = 1"), POSITIVES, "__id")
    # about POSITIVES ids and twice as many at most: of a proven size
    positive = pool.join(F.broadcast(toxic.select("__id")), F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"])
    unlabelled = drawn(pool, UNLABELLED, "doc_id", "text").dropDuplicates(["doc_id", "text"])
    sides = [side.select("text", F.lit(role).alias("role")) for role, side in enumerate((positive, unlabelled))]
    lists = sides[0].unionByName(sides[1]).mapInArrow(_word_lists, "role int, words array<string>")
    got = lists.repartition(1).sortWithinPartitions("role", F.xxhash64("words")).mapInArrow(_trainer(share), "word string, weights array<double>").toArrow()
    words, weights = got.column(0).to_pylist(), got.column(1).to_pylist()
    if not words:  # no rows at all: the task had nothing to train on
        return train(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), share)
    return Model({w: np.array(x) for w, x in zip(words, weights) if w is not None}, np.array(weights[words.index(None)]))


def _trainer(prior: float):
    """The whole sample in one task: a row for each known word, and one without a word for the biases."""

    def run(batches):
        sides = ([], [])
        for batch in batches:
            roles, lists = batch.column(0).to_numpy(), batch.column(1)
            for role, held in enumerate(sides):
                held.append(lists.filter(pa.array(roles == role)))
        both = [pa.concat_arrays([pa.array([], pa.list_(pa.string())), *[x.cast(pa.list_(pa.string())) for x in held]]) for held in sides]
        if len(both[0]) or len(both[1]):
            model = train(*both, prior)
            words = [None, *model.weights]
            rows = [model.bias.tolist(), *[w.tolist() for w in model.weights.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rows, pa.list_(pa.float64()))], ["word", "weights"])

    return run


def _word_lists(batches):
    for batch in slices(batches):
        lists = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.string()))], ["role", "words"])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    rows = docs.select(*[f.name for f in kept])
    place = [f.name for f in kept].index(text)

    def run(batches):
        for batch in slices(batches):
            scores = np.array([shared.value.score(t) for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
