"""SimHash near-duplicate detection over a byte-position inverted index (operator 5).

A fingerprint has eight bytes. Two fingerprints that differ in at most ``MAX_BITS`` = 2 bits differ
in at most 2 bytes, so they share at least 6 of their 8 positional bytes: that is the guaranteed
minimum for count filtering. A posting list for a single positional byte holds 1/256 of all
fingerprints and would make pairs by the square of the input; the index therefore posts pairs of
neighbouring bytes (four slots) and looks up two slots at once: at most 2 differing bytes leave at
least two of the four slots whole, so every pair of the guaranteed kind meets in one of the six
lists keyed by (two slots, their four bytes). Pairs that meet are tallied (shared positional bytes),
kept at 6 or more, and verified by the Hamming distance.

Equal fingerprints are one entry, so copies make no pairs. A list of more than ``LIST_MAX``
fingerprints (a large family of near copies) is not paired: within it the two whole slots are
shared, and two members are within 2 bits exactly if some value is within 1 bit of both. Each member
is posted under the 33 values within 1 bit of its other four bytes and all who meet are linked in a
star, which has the same components as all pairs. That grows in proportion to the list.

Defined results: null and empty texts and texts without words have fingerprint zero, linked like any
other; a row without doc_id is fingerprinted and linked but cannot give its group its number (the
number is null if no row has one); repeated rows share their group; an empty table gives an empty
table. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import jaccard
from assayer.llm.common import add_columns, discard, encode, free_shuffles, materialise, table
from assayer.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
MIN_SHARED = 8 - MAX_BITS
LIST_MAX = 64
SEED = 42
_SLICE = 65_536


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of the word shingles, repeats included."""
    parts = encode(text).lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _SLICE):  # a very long text needs no more memory than this
        end = min(n, start + _SLICE)
        if words == 3 and n > 1:
            some = parts[start : end + 2]
            h = [digest(b"%b %b %b" % x, SEED) for x in zip(some, some[1:], some[2:], strict=False)]
        else:
            h = [digest(b" ".join(parts[i : i + words]), SEED) for i in range(start, end)]
        octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Append simhash (long: the 64 bits as a signed number)."""

    def compute(_: object, texts: list) -> list:
        return [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)]

    return add_columns(docs, [text], compute, [T.StructField("simhash", T.LongType())], keep=keep)


def _slot(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(0xFF))


def _lists(fps: DataFrame) -> DataFrame:
    """(slots, value, fp): six postings for each fingerprint."""
    fp = F.col("fp")
    posts = [F.struct(F.lit(k).alias("slots"), F.shiftleft(_slot(fp, a), 16).bitwiseOR(_slot(fp, b)).alias("value")) for k, (a, b) in enumerate(itertools.combinations(range(4), 2))]
    return fps.select("fp", F.inline(F.array(*posts)))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) links whose components are those of all pairs within two differing bits.

    ``fps``: distinct fingerprints ``fp`` (long).
    """
    posted = _lists(fps)
    sizes = posted.groupBy("slots", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = posted.join(sizes, ["slots", "value"])
    met = materialise(met, "postings")
    # short lists: bounded arrays, then pairs with tally and verification
    short = met.where(F.col("n") <= LIST_MAX).groupBy("slots", "value").agg(F.sort_array(F.collect_list("fp")).alias("list"))
    pairs = short.select("list", F.posexplode("list").alias("i", "u")).select("u", F.explode(F.slice("list", F.col("i") + 2, F.greatest(F.size("list") - F.col("i") - 1, F.lit(0)))).alias("v"))
    shared = reduce(lambda a, b: a + b, [(_byte(F.col("u"), i) == _byte(F.col("v"), i)).cast("int") for i in range(8)])
    verified = pairs.where(shared >= MIN_SHARED).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    # long lists: a star around each value within one bit of the members
    fp = F.col("fp")
    free = [[i for i in range(4) if i not in pair] for pair in itertools.combinations(range(4), 2)]
    masks = [F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << (16 * s + b))) for s in slots for b in range(16))) for slots in free]
    near = F.element_at(F.array(*masks), F.col("slots") + 1)
    around = met.where(F.col("n") > LIST_MAX).select("fp", "slots", F.explode(near).alias("mask")).select("fp", "slots", fp.bitwiseXOR(F.col("mask")).alias("z"))
    least = around.groupBy("slots", "z").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x").select("slots", "z", "m")
    stars = around.join(least, ["slots", "z"]).where("fp <> m").select(fp.alias("u"), F.col("m").alias("v"))
    return verified.select("u", "v").unionByName(stars).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, simhash) -> (simhash, component_id): the least doc_id that is reachable."""
    fps = materialise(docs.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked"))
    alone = named.where(~F.col("linked")).select("fp", F.col("least").alias("component_id"))
    linked = named.where("linked")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return alone.unionByName(linked.join(first, "root").select("fp", "component_id")).withColumnRenamed("fp", "simhash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, simhash, component_id of every row."""
    marked = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"])
    marked = materialise(marked, "simhash")
    return marked.join(groups(marked), "simhash")


def drop_near_duplicates(docs: DataFrame, words: int = jaccard.WORDS, threshold: float = jaccard.THRESHOLD) -> DataFrame:
    """One row of each group stays: the row with the least doc_id (a null id last), and one of it.

    A group is linked by fingerprints within ``MAX_BITS`` bits and by sets of ``words``-word shingles
    with a Jaccard similarity of ``threshold`` or more.
    """
    key = F.md5(F.col("text").cast("binary")).alias("_key")  # null for a null text
    marked = fingerprints(docs.select("doc_id", "text", key), keep=["doc_id", "_key", "text"])
    last = jaccard.frequent(docs, words)
    free_shuffles(docs.sparkSession)
    full = materialise(jaccard.signatures(marked, last, words, threshold, keep=["doc_id", "_key", "simhash"]), "signatures")
    narrow, sets = materialise(full.drop("prefix", "size", "bits"), "simhash"), jaccard.distinct_sets(full)
    discard(full)
    near = jaccard.links(sets, docs.select(key, "text"), words, threshold)
    # nodes are fingerprints and sets (64-bit hashes both); a document ties its two together
    ties = narrow.select(F.col("simhash").alias("u"), F.col("sid").alias("v")).distinct()
    prints = links(narrow.select(F.col("simhash").alias("fp")).distinct())
    roots = components(ties.unionByName(prints).unionByName(near))
    rooted = narrow.join(roots, narrow.simhash == roots.node, "left").withColumn("root", F.coalesce("root", "simhash"))
    # groups are told apart by their root: ids may be null or repeated
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")
    first = rooted.groupBy("root").agg(F.min(place).alias("_first")).select("root", F.col("_first.doc_id").alias("_fid"), F.col("_first._key").alias("_fkey"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), key)
    # rows that may stay; of those with one id and one text the one with the least hash of all its columns
    held = own.join(first, F.col("_key").eqNullSafe(F.col("_fkey")) & F.col("_id").eqNullSafe(F.col("_fid")))
    return held.groupBy("root").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
