"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes ratios.

Features of a text are which byte n-grams it has: single bytes, pairs, hashed triples, and hashed runs of five character
classes. The log-count ratio of a feature compares its smoothed frequency in the two classes; a text's vector holds the
ratios of its features at unit length. The hinge loss is minimised by dual coordinate descent (Hsieh et al., 2008), and
margins become scores by a logistic curve fitted to margins of folds that were left out of their own fit.

The fit uses ``max_train`` labelled rows and ``train_bytes`` bytes of feature numbers at most (rows of least hash of
doc_id), bounds that do not grow; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, text_bytes
from .langid import held_out

MAX_TRAIN = 6000
TRAIN_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
THRESHOLD = 0.3
BITS = 16
SIZE = 256 + 3 * (1 << BITS)
COST = 1.0
EPOCHS = 12

_CLASS = np.full(256, 5, np.uint32)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 1, 2, 3, 4
_CLASS[[0x20, 0x09, 0x0D]] = 0
_CLASS[0x0A] = 6
for _c in b"!#$%&*|<>{}@":
    _CLASS[_c] = 7


def features(text: bytes) -> np.ndarray:
    """Numbers of the features a text has, ascending; long texts are taken in pieces that overlap by four bytes."""
    if len(text) <= PIECE_BYTES:
        return _features(text)
    has = np.zeros(SIZE, bool)
    for at in range(0, len(text), PIECE_BYTES):
        has[_features(text[at : at + PIECE_BYTES + 4])] = True
    return np.flatnonzero(has)


def _features(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    top = np.uint32((1 << BITS) - 1)
    pair = b[:-1] << 8 | b[1:]
    triple = ((pair[:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> (32 - BITS)
    c = _CLASS[b]
    two = c[:-1] << 3 | c[1:]
    run = two[:-3] << 9 | two[2:-1] << 3 | c[4:]
    found = np.concatenate((b, pair + np.uint32(256), triple + np.uint32(256 + (1 << BITS)), (run & top) + np.uint32(256 + (2 << BITS))))
    found.sort()
    return found[np.concatenate((found[:1] >= 0, found[1:] != found[:-1]))].astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the ratio of a feature's smoothed share among positives to that among negatives."""
    counts = [np.full(SIZE, alpha), np.full(SIZE, alpha)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss machine; rows are (feature numbers, values), labels 0 or 1.

    Each step solves the dual in one coordinate exactly: alpha_i moves by minus the gradient over the squared length,
    clipped to 0 and ``cost``. The bias is the weight of a feature of value 1 that all rows have.
    """
    w, bias = np.zeros(SIZE), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of largest likelihood, with Platt's softened targets, by Newton steps."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray  # of an indicator, ratio included
    bias: float
    slope: float
    offset: float

    def score(self, text: bytes) -> float:
        """Between 0 and 1; an empty text has the bias alone."""
        at = features(text)
        length = float(np.sqrt((self.ratios[at] ** 2).sum())) or 1.0
        margin = float(self.weights[at].sum()) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """A model from feature numbers and labels 0 or 1; with one class or no rows at all, scores are that class's share."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))

    def train(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratios = log_count_ratios([rows[i] for i in k], labels[k])
        vectors = [(rows[i], ratios[rows[i]] / (np.linalg.norm(ratios[rows[i]]) or 1.0)) for i in k]
        return ratios, *dual_coordinate_descent(vectors, labels[k])

    margins = np.zeros(len(rows))
    number = np.arange(len(rows))
    for f in range(folds):
        out = number % folds == f
        inner = number[~out]
        if len(set(labels[inner].tolist())) < 2:
            continue
        ratios, w, bias = train(inner)
        for i in number[out]:
            r = ratios[rows[i]]
            margins[i] = float(w[rows[i]] @ r) / (np.linalg.norm(r) or 1.0) + bias
    ratios, w, bias = train(number)
    return Model(ratios, (w * ratios), bias, *logistic_curve(margins, labels))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on the texts of ``docs`` whose doc_id has a ``quality`` of 0 or 1 in ``labels``: ``max_train`` of them at most,
    and no more than have ``train_bytes`` bytes of feature numbers together.

    Only feature numbers of those rows come to the driver. A doc_id with several labels counts with the largest, one
    with several texts with that of least SHA-256. Null texts count as empty; without any
    labelled text the model gives every text 0.5.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "quality")
    chosen = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [features(t).astype(np.int32).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary()), part.column(3)], names=["doc_id", "quality", "f", "sha"])

    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.sha2("text", 256).alias("sha"))
    found = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, f binary, sha string").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("f", "sha").alias("f"))
    found = scratch.table(found.withColumn("h", F.xxhash64("doc_id")), "features")
    total, last = 0, None
    for r in found.select("h", "doc_id", F.length("f").alias("size")).orderBy("h", "doc_id").collect():
        total += r.size
        if total > train_bytes:
            break
        last = (r.h, r.doc_id)
    rows = [] if last is None else sorted(found.filter((F.col("h") < last[0]) | (F.col("h") == last[0]) & (F.col("doc_id") <= last[1])).select("doc_id", "quality", "f").collect())
    scratch.drop(found)
    return fit([np.frombuffer(r.f, np.int32) for r in rows], np.array([r.quality for r in rows], np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    Null texts score as empty ones, repeated rows alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [shared.value.score((t or "").encode()) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, by a model fitted without the held-out fold."""
    model = learn(docs, labels.filter(~held_out(folds, fold)).select("doc_id", "quality"), max_train)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(folds, fold).alias("held_out"), "score", "predicted")
