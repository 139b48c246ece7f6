"""Embedding whitening by a tall-skinny QR (operator 12).

Vectors become exact integers x = floor(256 c). Sums of the distinct vectors are taken exactly, as two
halves of each number, so that no total overflows. Each task centres its rows with the exact sums (the
numerator n x - S is formed in whole numbers before the one division) and folds them, block by block,
into the triangular factor R of a QR; the factors meet in a tree of ``FAN`` at a time, and the last R,
of at most dimension x dimension numbers, goes through an SVD. Its right vectors and singular values
whiten: V = R'R / n is never formed, so small components keep their digits.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped; of
vectors of different lengths the most frequent length counts (ties: the longest), others are dropped; a
number beyond 64 bits stands at the limit; repeated rows are answered each, and count once in the fit; a
component whose singular value is below the rounding of the largest is none, so equal vectors give no rows
and a table may have fewer components than asked for; deviation is null where it does not fit 64 bits;
an empty table gives an empty table. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import materialise, scratch_name, table, without

COMPONENTS = 4
SCALE = 256
#: Rows that are folded into R together, and factors that meet in one task of the tree.
BLOCK, FAN = 4096, 8
_HALF = 32


def grid(vector: str) -> Column:
    """The vector as exact integers."""
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))


def usable(vector: str) -> Column:
    c = F.col(f"`{vector}`")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(False))


@dataclass
class Fit:
    """n, the exact sums S, unit components (dimension x k), their eigenvalues, and the trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype=np.int64)


def numerators(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """n x - S exactly: int64 where it fits, else whole numbers of any length."""
    most = max(int(np.max(x)), -int(np.min(x)), 1) if x.size else 1
    if most * n + max(abs(s) for s in sums) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(list(sums), dtype=object)


def centred(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(np.float64)


def exact_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of rows, and the sum of each dimension: one row of partial sums a dimension and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                high, low = x >> _HALF, x & ((1 << _HALF) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dimension)), pa.array(np.full(dimension, len(x))), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0))],
                    names=["d", "n", "high", "low"],
                )

    parts = fit.select("x").mapInArrow(run, "d long, n long, high long, low long")
    total = parts.groupBy("d").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).collect()  # a row a dimension
    by = {r.d: r for r in total}
    return (int(by[0].n), [(int(by[d].high) << _HALF) + int(by[d].low) for d in range(dimension)]) if by else (0, [0] * dimension)


def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def tsqr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: a QR in each task, then a tree of ``FAN``."""
    dimension = len(sums)

    def batch(number: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.ascontiguousarray(r, dtype="<f8").tobytes()], pa.binary())], names=["part", "r"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = np.empty((0, dimension)), None
        for b in batches:
            if b.num_rows and part is None:
                part = b.column(0)[0].as_py()
            x = _matrix(b.column(1))
            for at in range(0, len(x), BLOCK):
                r = fold(r, centred(x[at : at + BLOCK], n, sums))
        if part is not None:
            yield batch(part, r)

    def meet(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, dimension))
        for b in tables:
            for one in b.column("r"):
                r = fold(r, np.frombuffer(one.as_buffer(), dtype="<f8").reshape(-1, dimension))
        yield batch(key[0].as_py(), r)

    schema = "part long, r binary"
    parts = fit.rdd.getNumPartitions()
    factors = materialise(fit.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(leaves, schema), "factors")
    while parts > 1:
        parts = -(-parts // FAN)
        up = factors.select(F.floor(F.col("part") / FAN).alias("part"), "r")
        factors = materialise(up.groupBy("part").applyInArrow(meet, schema), "factors")
    last = factors.select("r").first()
    return np.frombuffer(bytes(last.r), dtype="<f8").reshape(-1, dimension) if last else np.zeros((0, dimension))


def fit_whitening(rows: DataFrame, dimension: int, components: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """``rows``: x (array of long). The fit, and the distinct vectors that it was made of."""
    fit = materialise(rows.select("x").distinct(), "fit-vectors")
    n, sums = exact_sums(fit, dimension)
    _, singular, right = np.linalg.svd(tsqr(fit, n, sums), full_matrices=False)
    values = singular**2 / max(n, 1)
    floor = (np.finfo(float).eps * max(n, dimension) ** 0.5 * (singular[0] if len(singular) else 0)) ** 2 / max(n, 1)
    k = int(min(components, (values > floor).sum()))
    vectors = right[:k].T
    for j in range(k):  # the sign: the largest entry is positive
        vectors[:, j] *= 1 if vectors[np.argmax(np.abs(vectors[:, j])), j] > 0 else -1
    return Fit(n, sums, vectors, values[:k], float(values.sum())), fit


def scores(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit.n, fit.sums) @ fit.vectors / np.sqrt(fit.values)


def identity_error(fit: DataFrame, made: Fit) -> float:
    """The largest entry of |covariance of the whitened fit rows - identity|, measured over all of them."""
    k = len(made.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                z = scores(_matrix(b.column(0)), made)
                first, second = first + z.sum(axis=0), second + z.T @ z
        flat = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    total = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # k + k^2 numbers
    flat = np.array([r.v for r in total]) / made.n
    mean = flat[:k]  # z are centred: what is left of their mean is rounding, and taken off
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: the other columns of ``df`` with component, n,
    deviation, whitened, explained and identity_error; columns of these names are replaced."""
    made_names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = without(df, [*made_names, vector])
    schema = ", ".join(f"{a} {b}" for a, b in zip(made_names, ["int", "long", "long", "double", "double", "double"], strict=True))
    good = df.where(usable(vector))
    length = good.groupBy(F.size(f"`{vector}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = length.d if length else 0
    good = good.where(F.size(f"`{vector}`") == dimension)
    x = scratch_name(df, "x")
    rows = good.select(*[f"`{c}`" for c in kept], grid(vector).alias(x))
    if dimension:
        made, fit = fit_whitening(rows.select(F.col(x).alias("x")), dimension, components)
        error = identity_error(fit, made)
    else:
        made, error = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0), 0.0
    side = df.sparkSession.sparkContext.broadcast(made)  # dimension x components numbers
    k = len(made.values)
    limit = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = side.value
        for b in batches:
            m = _matrix(b.column(b.num_columns - 1))
            if not len(m) or not k:
                continue
            top = numerators(m, fit.n, fit.sums)
            if top.dtype == object or float(np.abs(top).max()) ** 2 * top.shape[1] >= 2.0**62:
                top = top.astype(object)
            deviation = [v if v <= limit else None for v in (top * top).sum(axis=1).tolist()]
            z = scores(m, fit)
            again = pa.array(np.repeat(np.arange(len(m)), k))
            count = len(m) * k
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(i).take(again) for i in range(len(kept))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(count, fit.n)),
                    pa.array(deviation, pa.int64()).take(again),
                    pa.array(z.ravel()),
                    pa.array(np.tile(fit.values / fit.trace, len(m))),
                    pa.array(np.full(count, error)),
                ],
                names=[*kept, *made_names],
            )

    from pyspark.sql import types as T

    out = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(schema).fields])
    return rows.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
