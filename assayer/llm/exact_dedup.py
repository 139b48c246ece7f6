"""Exact deduplication with a split for heavy hitters (operator 11).

Texts are equal when they are identical after lower-casing A-Z; a SHA-256 digest of the normalised text
stands for it. Each task folds its digests into a Misra-Gries summary of ``counters`` entries. Summaries
add up: the sum of a digest's counters falls short of its count by at most rows / counters in all, so
with 2 / share counters every digest of at least ``share`` of the rows keeps half of that. The digests
that reach the half are at most 2 / share, whatever the input; their exact counts and the row that stays
are verified over all rows, by partial sums in each task. Verified winners (at most 1 / share rows of
some tens of bytes) are broadcast, and rows of those digests get their answer where they are, without
an exchange. The remaining digests, each of fewer than ``share`` of the rows, are grouped and joined by
ordinary shuffles. Texts are read once and never exchanged by ``mark_duplicates``.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, a
null id only where no row has one, and of repeated rows with that id one; every row is told, dropped ones
too; an empty table gives an empty table. Columns other than id and text are not looked at, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import materialise, table

#: A digest of at least this share of all rows is a heavy hitter.
SHARE = 0.001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: str = "text") -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _UPPER, _LOWER).cast("binary"), 256))


def fold(counts: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries summary of two summaries: at most ``counters`` entries stay, and what is taken off
    every entry is what the next largest one had."""
    for d, n in more.items():
        counts[d] = counts.get(d, 0) + n
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {d: n - off for d, n in counts.items() if n > off}


def _summaries(counters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            met = pc.value_counts(b.column(0))
            counts = fold(counts, dict(zip(met.field("values").to_pylist(), met.field("counts").to_pylist(), strict=True)), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return run


def candidates(digests: DataFrame, rows: int, share: float = SHARE) -> DataFrame:
    """(digest): every digest of at least ``share`` of the rows is among them; at most 2 / share."""
    summaries = digests.select("digest").mapInArrow(_summaries(math.ceil(2 / share)), "digest binary, n long")
    return summaries.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= share * rows / 2).select("digest")


def _settled(rows: DataFrame) -> DataFrame:
    """(digest, group_size, stays): the count of each digest and the row that stays, by partial sums."""
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("stays"))


def winners(digests: DataFrame, rows: int, share: float = SHARE) -> DataFrame:
    """``_settled`` of the heavy hitters alone, from exact counts; at most 1 / share rows."""
    some = digests.join(F.broadcast(candidates(digests, rows, share)), "digest", "left_semi")
    return _settled(some).where((F.col("group_size") > 1) & (F.col("group_size") >= share * rows))


def told(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(id, row, digest, group_size, stays) of every row; ``row`` numbers the rows of this run."""
    digests = docs.select(F.col(f"`{doc_id}`").alias("id"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    # written, so that row numbers hold and texts are read and hashed once
    digests = materialise(digests, "digests")
    heavy = materialise(winners(digests, digests.count(), share), "heavy-digests")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    names = ["id", "row", "digest", "group_size", "stays"]
    return marked.where("group_size IS NOT NULL").select(*names).unionByName(rest.join(_settled(rest), "digest").select(*names))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and text_sha256 of every row."""
    kept = F.col("row") == F.col("stays.row")
    return told(docs, doc_id, text, share).select(F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows that stay, with all their columns. Of rows with one id and equal texts the one with the
    least hash of the whole row stays, so that the choice does not hang on the order of reading."""
    digest, own, whole = "digest", "own", "whole"  # beside no column of the input, which is inside the struct
    stay = told(docs, doc_id, text, share).where("row = stays.row").select(F.col("digest").alias(digest), F.col("id").alias(own))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), digest_of(text).alias(digest), F.col(f"`{doc_id}`").alias("other"))
    met = rows.join(stay, (rows[digest] == stay[digest]) & rows["other"].eqNullSafe(stay[own]), "left_semi")
    order = F.xxhash64(F.to_json(whole))
    return met.groupBy(digest).agg(F.min_by(whole, order).alias(whole)).select(f"`{whole}`.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
