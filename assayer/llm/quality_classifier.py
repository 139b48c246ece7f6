"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal (operator 2).

A text is read as words and runs of punctuation; a word equal to the one before it is read as one
fixed token, so that repetition is a feature of its own whatever the word. One- and two-grams are
hashed to ``2**BITS`` indices; a document's vector holds the square roots of their counts, scaled to
length one, beside a constant. Training goes over a bounded sample of labelled documents in an order
fixed by hash, with the follow-the-regularised-leader update of each coordinate met; scoring is a
sparse dot product and the logistic function, over whole texts.

The sample (``TRAIN_ROWS``) is the only bound: the rows with the least hash of doc_id among the
labelled rows of the training folds. Its vectors are made by the executors, fitted in one task, and
only the weights (``4 * 2**BITS`` bytes) come to the driver.

Defined results: a null or empty text has the constant only and gets the share that it stands for; a
row without doc_id is not held out and never trains; repeated rows get equal scores; contradicting
labels of one document count as the lowest; without any label every score is 0.5; an empty table gives
an empty table. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import add_columns, table

BITS = 18
FOLDS = 5
TRAIN_ROWS = 12_000
EPOCHS = 4
#: FTRL-proximal: step, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.3
KNOWN_WORDS = 600_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = "\x00same"
_DIM = 1 << BITS
_MASK = _DIM - 1
_known: dict[str, int] = {}


def release() -> None:
    """Empties the worker's table."""
    _known.clear()


def token_hashes(text: str | None) -> np.ndarray:
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    for t in set(tokens).difference(_known):
        _known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    h[same] = zlib.crc32(_SAME.encode())
    return h


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values); index 0 is the constant."""
    h = token_hashes(text)
    if not len(h):
        return np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.float32)
    pairs = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA77) & 0xFFFFFFFFFFFF
    grams = np.concatenate([h, pairs ^ (pairs >> 21)])
    grams = (grams ^ (grams >> 15)) & _MASK
    index, count = np.unique(np.maximum(grams, 1), return_counts=True)
    value = np.sqrt(count)
    value /= np.sqrt((value * value).sum())
    return np.concatenate([[0], index]).astype(np.int32), np.concatenate([[1.0], value]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        index, value = vector(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[index] @ value, -35, 35))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (label, indices, values), in the given order."""
    z, n = np.zeros(_DIM), np.zeros(_DIM)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(epochs):
        for label, i, v in rows:
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - label) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return Model(weights(np.arange(_DIM)).astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` labelled documents of the training folds."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    n = marks.count()
    if not n:
        return Model(np.zeros(_DIM, dtype=np.float32))
    order = F.xxhash64("doc_id", F.lit(7))
    share = F.pmod(order, F.lit(1 << 20)) < F.lit(min(1 << 20, int(rows * (1 << 20) / n) + 1))
    # at most the sample is broadcast: its rows are bounded by the parameter
    sample = F.broadcast(marks.where(share))
    # of a repeated id the least text, so that a fit can be repeated
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("place", order)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [vector(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["place", "label", "i", "v"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = [(int(y), np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for b in batches for y, i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array([train(rows_).weights.tobytes()], pa.binary())], names=["weights"])

    featured = texts.select("place", "label", "text").mapInArrow(vectors, "place long, label int, i binary, v binary")
    got = featured.repartition(1).sortWithinPartitions("place").mapInArrow(one, "weights binary").first()
    return Model(np.frombuffer(got.weights, dtype=np.float32) if got else np.zeros(_DIM, dtype=np.float32))


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 at ``THRESHOLD`` or above)."""
    side = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 * 2**BITS bytes
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def compute(_: object, texts: list) -> list:
        model_ = Model(side.value)
        scores = [model_.score(t) for t in texts]
        return [scores, [int(s >= THRESHOLD) for s in scores]]

    return add_columns(docs, [text], compute, fields, keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
