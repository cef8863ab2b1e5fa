"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled text train a linear model that
minimises the non-negative unbiased risk (Kiryo et al., 2017)

    pi R_p(+) + max(0, R_u(-) - pi R_p(-))

with the sigmoid loss. The class prior pi is estimated first: a plain positive-vs-
unlabelled ranker is fitted on one half of the sample, and on the other half the share of
unlabelled over the share of positive documents above a cut, with a confidence
slack, is smallest where only positives remain (best bin estimation, Garg et
al., 2021). Labels 0 are not learnt from: every document outside the fold that is no chosen
positive, whatever its label, counts as unlabelled.

Features are style counts of a whole text: frequencies of pairs of character
classes, repetition of words and lines, lengths. They are computed on the
executors; the driver sees at most ``sample`` rows of each kind, ``WIDTH`` doubles each.

Defined cases: null and empty texts have all counts 0 and are scored like any
other; rows with a null key are not sampled; held-out rows are never learnt
from; without positives or without other documents outside the fold every score is 0.5;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.storage import ship

SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
CLASSES = 13
WIDTH = CLASSES * CLASSES + 8


def _classes() -> np.ndarray:
    """Class of each byte: letters, digits, spaces, sentence marks, other signs."""
    table = np.full(256, 12)
    for i, signs in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:?", "!", "'\"()-", "|", "#", "$%&*+=<>", "@/\\_~^`[]{}")):
        table[[ord(c) for c in signs]] = i
    return table


TABLE = _classes()


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    x = np.zeros(WIDTH)
    if not data:
        return x
    codes = TABLE[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(codes[:-1] * CLASSES + codes[1:], minlength=CLASSES * CLASSES)
    x[: CLASSES * CLASSES] = np.sqrt(pairs / max(len(codes) - 1, 1))
    words = data.split()
    lines = [s for s in data.split(b"\n") if s.strip()]
    n = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    thirds = len(set(zip(words, words[1:], words[2:])))
    x[CLASSES * CLASSES :] = [
        math.log1p(len(words)) / 10,
        len(set(words)) / n,
        same / n,
        1 - thirds / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        min(sum(map(len, words)) / n, 40) / 10,
        float(len(words) < 20),
        math.log1p(len(words) / max(len(lines), 1)) / 10,
    ]
    return x


def held_out(key, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _matrix(batches):
    for b in batches:
        rows = [features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary()), b.column(1)], ["x", "p"])


def _risk_descent(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Full-batch Adam on the non-negative risk; the last weight is the intercept."""
    xp, xu = np.column_stack([xp, np.ones(len(xp))]), np.column_stack([xu, np.ones(len(xu))])
    w, m, v = np.zeros(xp.shape[1]), np.zeros(xp.shape[1]), np.zeros(xp.shape[1])

    def loss(z):
        s = 1 / (1 + np.exp(np.clip(z, -30, 30)))  # sigmoid loss of margin z
        return s.mean(), -s * (1 - s)

    for t in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        _, gp = loss(zp)
        rpn, gpn = loss(-zp)
        run, gun = loss(-zu)
        positive = prior * xp.T @ gp / len(xp)
        negative = -(xu.T @ gun) / len(xu) + prior * xp.T @ gpn / len(xp)
        # Below zero the negative part is ascended, as the paper does.
        g = positive + negative if run - prior * rpn >= 0 else -negative
        g = g + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _ranker(xp: np.ndarray, xu: np.ndarray) -> np.ndarray:
    """Ridge regression of positive against unlabelled, balanced."""
    x = np.column_stack([np.vstack([xp, xu]), np.ones(len(xp) + len(xu))])
    y = np.append(np.ones(len(xp)), -np.ones(len(xu)))
    s = np.append(np.full(len(xp), 0.5 / len(xp)), np.full(len(xu), 0.5 / len(xu)))
    return np.linalg.solve(x.T @ (x * s[:, None]) + 1e-3 * np.eye(x.shape[1]), x.T @ (s * y))


def estimate_prior(xp: np.ndarray, xu: np.ndarray, confidence: float = 0.1) -> float:
    """Best bin estimate of the share of positives among the unlabelled."""
    a, b = slice(0, None, 2), slice(1, None, 2)
    if min(len(xp), len(xu)) < 4:
        return 0.5
    w = _ranker(xp[a], xu[a])
    zp, zu = np.sort(xp[b] @ w[:-1]), np.sort(xu[b] @ w[:-1])
    cuts = np.unique(np.append(zp, zu))
    qp = 1 - np.searchsorted(zp, cuts) / len(zp)
    qu = 1 - np.searchsorted(zu, cuts) / len(zu)
    slack = math.sqrt(math.log(4 / confidence) / (2 * len(zp))) + math.sqrt(math.log(4 / confidence) / (2 * len(zu)))
    ok = qp > 0
    best = np.argmin((qu[ok] + slack) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


def training_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, sample: int) -> DataFrame:
    """(text, p): at most ``sample`` positives and ``sample`` other documents, those
    with the smallest hashes. Broadcast are only the chosen keys."""
    good = labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    keys = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("__k")).distinct()

    def first(rows: DataFrame, p: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("__k", F.lit(p)), "__k").limit(sample).select("__k", F.lit(p).alias("p"))

    positive = first(keys.join(good, "__k", "left_semi"), 1)
    chosen = positive.unionByName(first(keys.join(F.broadcast(positive.select("__k")), "__k", "left_anti"), 0))
    return docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), "__k").select("text", "p")


class Model:
    def __init__(self, weights: np.ndarray, middle: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.middle, self.scale, self.prior = weights, middle, scale, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.middle) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    rows = training_sample(docs, labels, text, key, sample).mapInArrow(_matrix, "x binary, p int").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
    p = rows["p"].to_numpy()
    order = np.lexsort([*x.T, p])  # the same sums whatever order the rows came in
    x, p = x[order], p[order]
    xp, xu = x[p == 1], x[p == 0]
    if not len(xp) or not len(xu):
        return Model(np.zeros(WIDTH + 1), np.zeros(WIDTH), np.ones(WIDTH), 0.5)
    middle, scale = xu.mean(0), np.maximum(xu.std(0), 0.02)
    xp, xu = np.clip((xp - middle) / scale, -5, 5), np.clip((xu - middle) / scale, -5, 5)
    mixed = np.random.default_rng(0)
    xp, xu = mixed.permutation(xp), mixed.permutation(xu)
    prior = estimate_prior(xp, xu)
    return Model(_risk_descent(xp, xu, prior), middle, scale, prior)


def _score(model):
    def run(batches):
        for b in batches:
            texts, m = b.column(1), model.value
            x = np.array([features(t.as_py()) for t in texts]).reshape(-1, WIDTH)
            x = m.middle + np.clip((x - m.middle) / m.scale, -5, 5) * m.scale
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.round(m.scores(x), 9), pa.float64())], ["key", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row a document: (key, held_out, score, predicted)."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, text, key, sample))
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key), F.col(text), held_out(key).alias("held_out")).mapInArrow(_score(model), f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
