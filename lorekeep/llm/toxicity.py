"""Toxicity: noisy-channel deobfuscation, then scores of the restored text.

1. A character bigram model is counted over all documents (a fixed number of
   cells a partition, added up).
2. A suspicious token (letters mixed with look-alike signs, letters repeated,
   or letters and such signs spelt out one by one) spans a lattice of the
   characters it may stand for. Viterbi decoding under the character model and
   fixed channel costs restores the likeliest reading.
3. Restored words and their beginnings vote by log odds learnt from labels; a
   logistic model over a document's few vote statistics gives the score.

Labels are learnt from at most ``sample`` labelled rows (a documented bound, the
rows with the smallest hashes of their keys), which keeps the lexicon (``lexicon`` entries)
and the design matrix small; the character model covers the whole corpus.

Defined cases: null and empty texts have no votes and get the model's base rate;
rows with a null key or label are not learnt from; of several labels of a key
the largest counts; with one class or no labels every score is the share of toxic rows (0 without
rows); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.storage import materialise, ship

SAMPLE = 20_000
LEXICON = 4096
FOLDS, HELD_OUT = 3, 1
CUT = 0.7
LETTERS = 0x250  # characters of the model: Latin blocks; any other is one class
#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs in nats: reading a sign as a letter, keeping a sign, dropping a repeat, one of two letters, a separator.
AS_LETTER, AS_SIGN, DROP_REPEAT, DROP_DOUBLE, DROP_BREAK = 1.5, 3.0, 0.5, 2.5, 0.5

EDGES = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>#*$%&|=_-~^/\\`"
ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£]+[^\W\d_]|^[0-9@$!|+(€£]{1,2}[^\W\d_]{2}|[^\W\d_]{2}[0-9@$€£]{1,2}$|([^\W\d_])\1|[^\W\d_][.\-_*][^\W\d_](?:[.\-_*]|$)")
SPELT = re.compile(r"(?<![^\s\"'“‘«])(?:[^\W_]|[@$!|+(€£])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+(€£]))+[ .\-_*]{1,2}(?:[^\W_]|[@$+€£])(?![^\s.,;:!?\"')\]}”’»])")
#: What may stand around a token but is no look-alike of a letter there.
BEFORE, AFTER = ".,;:?\"'[{<“‘«", ".,;:?!\"')]}>”’»"
BREAKS = " .-_*"


def count_characters(batches):
    cells = np.zeros(LETTERS * LETTERS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            if t := text.as_py():
                codes = np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                codes[codes < 33] = 32
                codes[codes >= LETTERS] = 0
                cells += np.bincount(codes[:-1] * LETTERS + codes[1:], minlength=LETTERS * LETTERS)
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells[at], pa.int64())], ["cell", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of the next character, add-half smoothed. What reaches
    the driver is at most LETTERS ** 2 counts whatever the corpus size."""
    rows = docs.select(text).mapInArrow(count_characters, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.full(LETTERS * LETTERS, 0.5)
    cells[rows["cell"].to_numpy()] += rows["n"].to_numpy()
    cells = cells.reshape(LETTERS, LETTERS)
    return np.log(cells / cells.sum(1, keepdims=True)).astype(np.float32)


class Restorer:
    """Viterbi decoding of suspicious tokens; readings are cached by token."""

    def __init__(self, model: np.ndarray):
        self.model, self.cache = model, {}

    def step(self, a: str, b: str) -> float:
        x, y = ord(a), ord(b)
        return -float(self.model[x if x < LETTERS else 0, y if y < LETTERS else 0])

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each position the strings it may stand for, with channel costs."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                # A run may stand for one letter, two, or what it says.
                options = [(c * n, DROP_REPEAT * (j - i - n)) for n in {1, 2, j - i} if n <= j - i] if j - i >= 3 else [(c * (j - i), 0.0), (c, DROP_DOUBLE)][: j - i]
            elif c in BREAKS:
                options = [("", DROP_BREAK), (c, AS_SIGN)]
            else:
                options = [(c * (j - i), AS_SIGN * (j - i))]
                for x in LOOKALIKES.get(c, ""):
                    options.append((x * (j - i), AS_LETTER * (j - i)))
                    if j - i > 1:
                        options.append((x, AS_LETTER + DROP_REPEAT * (j - i - 1)))
            out.append(options)
            i = j
        return out

    def decode(self, token: str) -> str:
        if (known := self.cache.get(token)) is not None:
            return known
        best = {" ": (0.0, "")}  # by last character: cost, reading
        for options in self.lattice(token):
            following: dict[str, tuple[float, str]] = {}
            for last, (cost, read) in best.items():
                for s, channel in options:
                    c, a = cost + channel, last
                    for b in s:
                        c += self.step(a, b)
                        a = b
                    if a not in following or (c, read + s) < following[a]:
                        following[a] = (c, read + s)
            best = following
        read = min((cost + self.step(a, " "), read) for a, (cost, read) in best.items())[1]
        if len(self.cache) > 100_000:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = read
        return read

    def words(self, text: str | None) -> set[str]:
        """Distinct lower-case words of the restored text."""
        low = (text or "").lower()
        found = set()
        for token in set(low.split()):
            t = token.strip(EDGES)
            found.add(t)
            bare = token.lstrip(BEFORE).rstrip(AFTER)
            if bare[:1] == "(" and ")" in token:
                bare = bare.lstrip("(")
            if ODD.search(bare):
                found.add(self.decode(bare).strip(EDGES))
        for m in SPELT.finditer(low):
            units = [c for c in m[0] if c not in BREAKS]
            if len(set(units)) > 1 and 3 * sum(c.isalpha() for c in units) >= len(units):
                found.add(self.decode(m[0]).strip(EDGES))
        found.discard("")
        return found


def votes(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n)]


def statistics(words: set[str], weights: dict[str, float], cache: dict[str, float]) -> list[float]:
    """The strongest vote, the three strongest together, strong votes and their share."""
    got = []
    for w in words:
        v = cache.get(w)
        if v is None:
            v = max((weights.get(x, 0.0) for x in votes(w)), default=0.0)
            if len(cache) > 200_000:
                cache.clear()
            cache[w] = v
        if v > 0:
            got.append(v)
    got.sort(reverse=True)
    n = max(len(words), 1)
    return [got[0] if got else 0.0, sum(got[:3]), math.log1p(sum(v > 3 for v in got)), sum(got) / math.sqrt(n), 10 * sum(v > 3 for v in got) / n]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key, folds: int = FOLDS, fold: int = HELD_OUT):
    """Whether crc32 of the key as text falls into the fold; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, sample: int, folds: int, fold: int) -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows outside the fold. The
    chosen keys are broadcast: their number is bounded by ``sample``."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds, fold))
        .groupBy(F.col(key).alias("__k"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("__k"), "__k")
        .limit(sample)
    )
    return docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), "__k").select("__k", "text", "y").dropDuplicates(["__k"]).select("text", "y")


def _features(model):
    def run(batches):
        r = Restorer(model.value)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = sorted({v for w in r.words(text) for v in votes(w)})
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([y] * len(f), pa.int32())], ["f", "y"])

    return run


def _statistics(model, weights):
    def run(batches):
        r, cache = Restorer(model.value), {}
        for b in batches:
            rows = [statistics(r.words(t), weights.value, cache) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    return run


def _scores(model, weights, fitted):
    def run(batches):
        r, cache, w = Restorer(model.value), {}, fitted
        for b in batches:
            x = [[*statistics(r.words(t), weights.value, cache), 1.0] for t in b.column(1).to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, len(w)) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.round(s, 9), pa.float64())], ["key", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, lexicon: int = LEXICON, cut: float = CUT) -> DataFrame:
    """One row a document: (key, held_out, score, predicted)."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    model = sc.broadcast(character_model(docs, text))
    rows = materialise(labelled(docs, labels, "toxic", text, key, sample, FOLDS, HELD_OUT), "toxic-sample")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    kind = docs.schema[key].dataType.simpleString()
    if n0 and n1:
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
        words = (
            rows.mapInArrow(_features(model), "f string, y int")
            .groupBy("f")
            .agg(F.sum("y").cast("long").alias("n1"), F.sum(1 - F.col("y")).cast("long").alias("n0"))
            .where("n1 >= 3")
            .withColumn("w", odds)
            .where("w > 1")
            .orderBy((F.col("w") * F.sqrt("n1")).desc(), "f")
            .limit(lexicon)
            .collect()
        )
        weights = sc.broadcast({r.f: r.w for r in words})
        design = rows.mapInArrow(_statistics(model, weights), "x array<double>, y int").toArrow()
        x = np.array(design["x"].to_pylist(), np.float64).reshape(-1, 5)
        order = np.lexsort([*x.T, design["y"].to_numpy()])
        fitted = fit_logistic(x[order], design["y"].to_numpy()[order].astype(float))
    else:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        weights = sc.broadcast({})
        fitted = np.array([0.0] * 5 + [math.log(max(share, 1e-12) / max(1 - share, 1e-12))])
    scored = docs.select(F.col(key), F.col(text), held_out(key).alias("held_out")).mapInArrow(_scores(model, weights, fitted), f"key {kind}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
