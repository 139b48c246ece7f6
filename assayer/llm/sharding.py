"""Byte-balanced sharding by histogram sort (operator 6).

Documents are ordered by (hash of the text, doc_id), so equal texts lie side by side. The splitters
between shards are found by probing: exact bytes and rows are counted below evenly spaced candidate
boundaries (bins of the key's bits) over all partitions, the bin that holds a target is probed again
with finer boundaries, and so on until each splitter is within tolerance of its share of the bytes or
its bin holds one row. A group of equal texts larger than the tolerance is split by doc_id. Only
counts reach the driver: at most 2^``COLLECT_BITS`` in a round, however many bins are open. Rows are then exchanged
once, straight to their place.

The law is ``bytes``: each shard's size is within twice the tolerance, or the size of one document, of
the mean. A boundary falls between groups of equal texts whenever that meets the tolerance.

Defined results: a null text counts no bytes (16 for the row) and is not the same as an empty text; a
null id sorts first; repeated rows are adjacent and cannot be told apart, so no boundary parts them;
with no rows the result is empty. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import materialise, shielded, table, without

SHARDS = 40
ROW_BYTES = 16
#: Of a shard's size.
TOLERANCE = 0.001
#: A round refines open bins by at most so many bits, and gathers at most 2^COLLECT_BITS counts in all.
BIN_BITS, COLLECT_BITS = 12, 18
#: A shard is exchanged in so many tasks that each has about this many bytes, to a limit.
TASK_BYTES = 64_000_000
MAX_TASKS = 16_384
_FLIP = -(1 << 63)


@dataclass
class Splitters:
    """Boundary i: the first (key, id) right of it, as unsigned numbers, and exact counts below it."""

    keys: np.ndarray
    ids: np.ndarray
    bytes_below: np.ndarray
    rows_below: np.ndarray

    def place(self, key: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The number of boundaries at or below each row."""
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = low.astype(np.int64)
        for i in np.flatnonzero(high > low):  # rows of a key that a boundary splits
            out[i] = low[i] + np.searchsorted(self.ids[low[i] : high[i]], own[i], "right")
        return out


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def size_of(text: str = "text"):
    return F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def key_of(text: str = "text"):
    """Order-preserving unsigned form (sign bit flipped) of the text's hash; null texts have their own."""
    t = F.col(f"`{text}`").cast("string")
    return F.xxhash64(t.isNull(), t).bitwiseXOR(F.lit(_FLIP))


def id_of(doc_id: str = "doc_id"):
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_FLIP)).bitwiseXOR(F.lit(_FLIP))


def find_splitters(sizes: DataFrame, targets: np.ndarray, slack: np.ndarray) -> Splitters:
    """``sizes``: k, i (unsigned key and id as long) and size. ``targets``: bytes below each boundary."""
    n = len(targets)
    keys, ids = [0] * n, [0] * n
    below, rows = np.zeros(n), np.zeros(n, dtype=np.int64)
    # an open bin: (column, bits fixed, prefix, the key that is fixed) -> targets inside, counts below it
    open_: dict[tuple[int, int, int, int], list[int]] = {(0, 0, 0, 0): list(range(n))}
    base = {(0, 0, 0, 0): (0, 0)}
    while open_:
        finer = max(1, min(BIN_BITS, COLLECT_BITS - (len(open_) - 1).bit_length()))
        counts = _count(sizes, list(open_), finer)
        following: dict[tuple[int, int, int, int], list[int]] = {}
        next_base = {}
        for where, inside in open_.items():
            column, bits, prefix, fixed = where
            take = min(finer, 64 - bits)
            size, number = np.zeros(1 << take, dtype=np.int64), np.zeros(1 << take, dtype=np.int64)
            for b, s, c in counts.get(where, ()):
                size[b], number[b] = s, c
            edges = base[where][0] + np.concatenate([[0], np.cumsum(size)])
            numbers = base[where][1] + np.concatenate([[0], np.cumsum(number)])
            for t in inside:
                b = int(min(np.searchsorted(edges, targets[t], "right") - 1, (1 << take) - 1))
                b = max(b, 0)
                edge = b if targets[t] - edges[b] <= edges[b + 1] - targets[t] else b + 1
                low = prefix << take | b
                fixed_bits = bits + take
                last = column == 1 and fixed_bits == 64
                if abs(edges[edge] - targets[t]) <= slack[t] or number[b] <= 1 or last:
                    value = (prefix << take | b) + (edge - b) << (64 - fixed_bits)
                    if column == 0:
                        keys[t], ids[t] = value, 0
                    else:
                        keys[t], ids[t] = fixed, value
                    below[t], rows[t] = edges[edge], numbers[edge]
                    continue
                nxt = (column, fixed_bits, low, fixed) if fixed_bits < 64 else (1, 0, 0, low)
                following.setdefault(nxt, []).append(t)
                next_base[nxt] = (int(edges[b]), int(numbers[b]))
        open_, base = following, next_base
    # a boundary after the last value does not fit 64 bits: nothing lies right of it
    top = (1 << 64) - 1
    for t in range(n):
        if ids[t] > top:
            keys[t], ids[t] = keys[t] + 1, 0
        if keys[t] > top:
            keys[t], ids[t] = top, top
    order = sorted(range(n), key=lambda t: (keys[t], ids[t]))
    return Splitters(np.array([keys[t] for t in order], dtype=np.uint64), np.array([ids[t] for t in order], dtype=np.uint64), below[order], rows[order])


def _count(sizes: DataFrame, bins: list[tuple[int, int, int, int]], finer: int) -> dict[tuple[int, int, int, int], list[tuple[int, int, int]]]:
    """Exact bytes and rows in the next finer bins of each open bin: one pass over all partitions."""
    out: dict[tuple[int, int, int, int], list[tuple[int, int, int]]] = {}
    by_kind: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for b in bins:
        by_kind.setdefault(b[:2], []).append(b)
    for (column, bits), some in by_kind.items():
        take = min(finer, 64 - bits)
        x = F.col("k" if column == 0 else "i")
        prefix = F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")
        rows = sizes
        if column == 1:
            rows = rows.where(F.col("k").isin([_signed(b[3]) for b in some]))
        if bits:
            rows = rows.where(prefix.isin([_signed(b[2]) for b in some]))
        bin_ = F.shiftrightunsigned(F.shiftleft(x, bits), 64 - take)
        fixed = F.col("k") if column == 1 else F.lit(0).cast("long")
        got = rows.groupBy(prefix.alias("p"), fixed.alias("f"), bin_.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("c"))
        for r in got.collect():  # 2^finer for each open bin
            out.setdefault((column, bits, _unsigned(r.p), _unsigned(r.f)), []).append((int(r.b), int(r.s), int(r.c)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot (the row's place in its shard), exchanged once."""
    spark = docs.sparkSession
    sizes = materialise(docs.select(key_of(text).alias("k"), id_of(doc_id).alias("i"), size_of(text).alias("size")), "shard-sizes")
    total, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(MAX_TASKS // shards, math.ceil(total / shards / TASK_BYTES)))
    n = shards * tasks
    at = np.arange(1, n)
    slack = np.where(at % tasks == 0, TOLERANCE * total / shards, 0.4 * total / n)
    found = find_splitters(sizes, total * at / n, slack)
    start = np.concatenate([[0], found.rows_below])
    first = start - start[(np.arange(n) // tasks) * tasks]  # rows of the shard before each task
    side = spark.sparkContext.broadcast((found, first))  # bounded by MAX_TASKS

    @F.pandas_udf("task int, base long")
    def place(k: pd.Series, i: pd.Series) -> pd.DataFrame:
        splitters, before = side.value
        task = splitters.place(k.to_numpy().view(np.uint64), i.to_numpy().view(np.uint64))
        return pd.DataFrame({"task": task.astype(np.int32), "base": before[task]})

    docs, named_back = shielded(docs, ("_k", "_i", "_to"))
    own = docs.select(*[f"`{c}`" for c in without(docs, ["size", "shard", "slot"])])
    rows_ = own.withColumns({"_k": key_of(text), "_i": id_of(doc_id), "size": size_of(text)})
    rows_ = rows_.withColumn("_to", place("_k", "_i"))
    rows_ = rows_.repartitionById(n, F.col("_to.task")).sortWithinPartitions("_to.task", *(F.col(c).bitwiseXOR(F.lit(_FLIP)) for c in ("_k", "_i")))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows_ = rows_.withColumns({"shard": F.floor(F.col("_to.task") / tasks).cast("int"), "slot": F.col("_to.base") + local})
    return named_back(rows_.drop("_k", "_i", "_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.coalesce(F.crc32("text"), F.lit(0).cast("long"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
