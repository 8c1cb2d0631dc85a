"""Quality by positive-unlabelled learning: non-negative unbiased risk of a linear model.

Trusted positives are the labelled training rows of quality 1; the unlabelled set is every training document. With class prior
p and logistic loss, the risk is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)); its unbiased part is convex and
found by Newton steps, and where the second part falls below zero the step goes against its gradient instead. All rows
take part: features are a table in the shared folder, and each step is one aggregate over it.

The prior needs no negatives: for any threshold, the share of unlabelled scores beyond it is at least p times that of positive
ones, and equal to it where no negative lies beyond. Its estimate is the least quotient over thresholds that leave REACH of the
positives, by a first model fitted with prior 1/2.

Scores are shifted so that THRESHOLD lies where a share p of the training documents' scores lies beyond; within ROOM of it
(or twice the error with which p is known), in
the widest gap between scores, of which equal ones make one.

Features of a text: shares of pairs of adjacent byte kinds, and of repeated, short, capital and mixed words, by
logarithm of length.

Defined results: null and empty texts have the features of an empty text (and a score like any other); repeated
rows are scored alike; rows with a null doc_id are unlabelled training rows; with no positives all scores are 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import binary_parts, forget, small_batches, text_slices, written
from .textcore import words
from .toxicity import held_out

ROUNDS, DECAY = 12, 1e-3
THRESHOLD = 0.7
#: Positives beyond a threshold from which the prior is read, and how far from the expected share the decision may lie.
REACH, ROOM = 0.25, 0.01
#: Scores are counted in so many steps for a unit of log-odds.
STEPS = 50

#: Byte kinds: small letter, capital, digit, space, line end, sentence end, comma, other mark, beyond ASCII.
KIND = np.full(256, 7, np.uint8)
for _c in range(256):
    if 97 <= _c < 123:
        KIND[_c] = 0
    elif 65 <= _c < 91:
        KIND[_c] = 1
    elif 48 <= _c < 58:
        KIND[_c] = 2
    elif _c in (32, 9):
        KIND[_c] = 3
    elif _c in (10, 13):
        KIND[_c] = 4
    elif _c in b".":
        KIND[_c] = 5
    elif _c in b",;:":
        KIND[_c] = 6
    elif _c >= 128:
        KIND[_c] = 8
KINDS = 9
FEATURES = KINDS * KINDS + 5


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES values for each text."""
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    size = np.diff(off)
    if len(data):
        doc = np.repeat(np.arange(n), size)
        k = KIND[data].astype(np.int64)
        pair = (doc[:-1] * KINDS + k[:-1]) * KINDS + k[1:]
        same = doc[:-1] == doc[1:]
        out[:, : KINDS * KINDS] = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] = np.sqrt(out[:, : KINDS * KINDS] / np.maximum(size, 1)[:, None])
        w, s, e, first = words(data, off)
        count = np.diff(first)
        at = np.repeat(np.arange(n), count)
        low = np.maximum(count, 1)
        if len(w):
            again = np.zeros(len(w), bool)
            again[1:] = (w[1:] == w[:-1]) & (at[1:] == at[:-1])
            o = np.lexsort((w, at))
            fresh = np.ones(len(w), bool)
            fresh[1:] = (w[o][1:] != w[o][:-1]) | (at[1:] != at[:-1])
            j = KINDS * KINDS
            out[:, j] = np.bincount(at, again, n) / low
            out[:, j + 1] = np.bincount(at, fresh, n) / low
            out[:, j + 2] = np.bincount(at, e - s, n) / low / 8
            out[:, j + 3] = np.bincount(at, k[s] == 1, n) / low
        out[:, KINDS * KINDS + 4] = np.log1p(count) / 8
    return out


class Model:
    """Means and scales of the features, weights of the scaled ones and of a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, np.zeros(len(mean) + 1)

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.ready(x) @ self.weights, -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, f: features as bytes of float32)."""

    def run(batches):
        for part, data, off in text_slices(batches, "text"):
            f = features(data, off).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in f], pa.binary())], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f binary")


def summed(table: DataFrame, size: int, what) -> np.ndarray:
    """Sum over all rows (f, good) of what(features, whether positive), an array of `size` numbers; one partial sum a task."""

    def run(batches):
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                raw, _ = binary_parts(b.column(0))
                out += what(np.frombuffer(raw.tobytes(), np.float32).reshape(b.num_rows, -1).astype(float), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    parts = [np.frombuffer(r[0]) for r in table.select("f", "good").mapInArrow(run, "s binary").collect()]
    return np.sum(sorted(parts, key=bytes), axis=0) if parts else np.zeros(size)


def minimised(model: Model, table: DataFrame, prior: float, n: float, n_good: float) -> None:
    """Sets the weights that minimise the risk at a prior."""
    k = len(model.weights)

    def terms(x, good):
        r = model.ready(x)
        z = np.clip(r @ model.weights, -30, 30)
        s = 1 / (1 + np.exp(-z))
        loss = np.log1p(np.exp(z))
        return np.concatenate([[loss.sum(), loss[good].sum()], s @ r, s[good] @ r[good], r[good].sum(0), ((r * (s * (1 - s))[:, None]).T @ r).ravel()])

    for _ in range(ROUNDS):
        t = summed(table, 2 + 3 * k + k * k, terms)
        g_all, g_good, x_good, h = t[2 : 2 + k] / n, t[2 + k : 2 + 2 * k] / n_good, t[2 + 2 * k : 2 + 3 * k] / n_good, t[2 + 3 * k :].reshape(k, k) / n
        h = h + np.diag(np.full(k, DECAY))
        if t[0] / n - prior * t[1] / n_good < 0:
            step = -(g_all - prior * g_good)
        else:
            step = g_all - prior * x_good + DECAY * model.weights
        step = np.linalg.solve(h, step)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-3:
            break


def histogram(model: Model, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many of all rows and of the positives have log-odds in each step."""
    size = 60 * STEPS + 1

    def terms(x, good):
        at = np.round((model.odds(x) + 30) * STEPS).astype(int)
        return np.concatenate([np.bincount(at, minlength=size), np.bincount(at[good], minlength=size)])

    t = summed(table, 2 * size, terms)
    return t[:size], t[size:]


def estimated_prior(every: np.ndarray, good: np.ndarray) -> float:
    beyond, positive = np.cumsum(every[::-1]) / every.sum(), np.cumsum(good[::-1]) / good.sum()
    at = positive >= REACH
    # Twice the standard error of the positives' share stands against reading the least of many noisy quotients.
    error = 2 * np.sqrt(beyond * (1 - beyond) / every.sum() + beyond**2 * (1 - positive) / np.maximum(positive, 1e-9) / good.sum())
    return float(np.clip(((beyond + error) / np.maximum(positive, 1e-9))[at].min(), 0.02, 0.98))


def decision(every: np.ndarray, prior: float, n_good: float = np.inf) -> float:
    """The log-odds between training scores that leave about a share `prior`, read from n_good positives, beyond."""
    at = np.flatnonzero(every)
    if len(at) < 2:
        return at[0] / STEPS - 30 if len(at) else 0.0
    below = np.cumsum(every[at])[:-1] / every.sum()
    off = np.abs(below - (1 - prior))
    width = np.where(off <= max(ROOM, 2 * np.sqrt(prior * (1 - prior) / n_good), off.min()), np.diff(at), 0)
    i = int(np.lexsort((off, -width))[0])
    return (at[i] + at[i + 1]) / 2 / STEPS - 30


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    train = docs.filter(~held_out(F.col("doc_id"), 4, 2))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id"), 4, 2))
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).filter("y > 0").select("doc_id", F.lit(True).alias("good"))
    table = written(vectors(train).join(marks, "doc_id", "left").select("f", F.coalesce("good", F.lit(False)).alias("good")), "features")
    t = summed(table, 2 + 2 * FEATURES, lambda x, good: np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)]))
    n, n_good = t[:2]
    model = None
    if n_good:
        mean = t[2 : 2 + FEATURES] / n
        model = Model(mean, np.sqrt(np.maximum(t[2 + FEATURES :] / n - mean**2, 0)) + 1e-3)
        minimised(model, table, 0.5, n, n_good)
        prior = estimated_prior(*histogram(model, table))
        minimised(model, table, prior, n, n_good)
        model.weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - decision(histogram(model, table)[0], prior, n_good)
    forget(table)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text) to (doc_id, held_out, score, predicted)."""
    model = fit(docs.select("doc_id", "text"), labels)

    def run(batches):
        for part, data, off in text_slices(batches, "text"):
            s = model.score(features(data, off).astype(np.float32).astype(float)) if model else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names)

    names = ["doc_id", "held_out", "score", "predicted"]
    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
