"""All pairs of texts whose word-shingle sets have a Jaccard similarity of a threshold or more.

A set is the distinct 64-bit hashes of a text's ``WORDS``-word shingles. All sets are put into one
order, shingles that are frequent in a sample last, and each set posts its first n - ceil(t n) + 1
shingles: two sets at similarity t or more share one of them, whatever the order is. Sets that meet in
a list are compared by their sizes and by the most that they can still share, and what is left is
verified exactly on the whole sets. Nothing is sampled or capped, so no pair is missed; the sample
only keeps lists short.

A pair is verified on its texts only if the bitmaps of its sets allow it: each shingle flips one of
``BITS`` bits, so two bitmaps differ in at most as many bits as the sets have shingles not in common. In the
last step the join itself asks them (folded to ``FEW_BITS`` for small sets), so that members of a large family
that are alike but not similar are not put out in pairs. Texts
are exchanged for a slice of the pairs at a time, so that what lies on disk stays a share of the corpus.

Equal sets are one entry. In a list of more than two sets each member is compared with one centre, drawn by
a hash, so that a large family is most likely to give it. A member is in many lists, so it is first compared
with one of their centres; then, where that left them apart, with the centre of each list, drawn anew in
every step. Steps begin and go on while lists hold many pairs of sets that are not connected yet and a step connects
a share of them; then members that are still apart are compared with each other, in pieces of ``LIST_MAX``. A
family of near copies is mostly connected after one verification a member, and its pairs are never put out.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import add_columns, discard, encode, free_shuffles, materialise
from assayer.llm.components import components

WORDS = 5
THRESHOLD = 0.8
LIST_MAX = 64
SEED = 5
#: A sample of so many texts, of one in ``SHARE_MAX`` at least, names at most so many frequent shingles. The share
#: does not fall with the corpus: else shingles of a few dozen texts pass as rare, and lists grow with the input.
SAMPLE, SHARE_MAX = 20_000, 3
FREQUENT_MAX = 200_000
FREQUENT_AT = 3
#: Stars go on while lists hold more pairs of sets still apart than so many for each posting, and while a step
#: rules out at least this share of them.
OPEN, PROGRESS = 1.0, 0.1
#: Of a set's bitmap, and of what postings of sets of at most ``FEW_BITS`` shingles carry of it.
BITS, FEW_BITS = 1024, 256
#: The texts exchanged at once have at most this share of the shingles of all sets.
SLICE = 0.5
_EPS = 1e-9
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (uint64); a text of fewer words is one shingle, without words none."""
    parts = encode(text).lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(b" ".join(parts), SEED)], dtype=np.uint64)
    known = {w: digest(w, SEED) for w in set(parts)}
    h = np.array([known[w] for w in parts], dtype=np.uint64)
    n = len(parts) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(words):
        out = (out ^ h[j : j + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return np.unique(out ^ (out >> np.uint64(32)))


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted shingles that recur in a sample of distinct texts, the most frequent first if they are many."""
    texts = docs.select(F.col("text").alias("_t")).where("_t IS NOT NULL")
    share = max(1, min(texts.count() // SAMPLE, SHARE_MAX))
    some = texts.where(F.pmod(F.xxhash64("_t"), F.lit(share)) == 0).dropDuplicates(["_t"])
    sets = add_columns(some, ["_t"], lambda _, t: [[shingles(x, words).view(np.int64) for x in t]], [T.StructField("s", T.ArrayType(T.LongType()))], keep=[])
    counts = sets.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT_AT)
    top = counts.orderBy(F.desc("count"), "s").limit(FREQUENT_MAX).select("s").toArrow()  # at most FREQUENT_MAX
    return np.sort(top.column("s").to_numpy().view(np.uint64))


def prefix(s: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles that a set posts, in the common order."""
    if not len(s):
        return s
    keep = len(s) - int(np.ceil(threshold * len(s) - _EPS)) + 1
    common = np.zeros(len(s), dtype=bool)
    if len(last):
        common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.concatenate([s[~common], s[common]])[:keep]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Which of ``BITS`` bits an odd number of the shingles fall on, as 64-bit numbers."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _bitmaps(keys: DataFrame) -> DataFrame:
    """sid, few (``FEW_BITS`` bits: bits of one place modulo that, folded into one) and many (all, for large sets)."""
    words = FEW_BITS // 64
    folded = [functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.get("bits", F.lit(i)) for i in range(k, BITS // 64, words)]) for k in range(words)]
    return keys.select("sid", F.array(*folded).alias("few"), F.when(F.col("size") > FEW_BITS, F.col("bits")).alias("many"))


def _bits_apart(a: str, b: str, name: str, n: int):
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.get(f"{a}{name}", F.lit(i)).bitwiseXOR(F.get(f"{b}{name}", F.lit(i)))) for i in range(n)])


def signatures(docs: DataFrame, last: np.ndarray, words: int, threshold: float, keep: list[str]) -> DataFrame:
    """Append sid (the set's hash), size, prefix and bits."""
    side = docs.sparkSession.sparkContext.broadcast(last)

    def compute(_: object, texts: list) -> list:
        sets = [shingles(t, words) for t in texts]
        sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        return [sid, [len(s) for s in sets], [prefix(s, side.value, threshold).view(np.int64) for s in sets], [bitmap(s) for s in sets]]

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("sid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("prefix", longs), T.StructField("bits", longs)]
    return add_columns(docs, ["text"], compute, fields, keep=keep)


#: Sets of so many texts of at most so many characters are kept by a worker: partners of one text follow each other.
_RECENT, _RECENT_CHARS = 64, 20_000
_recent = functools.lru_cache(maxsize=_RECENT)(shingles)


def similar(a: str | None, b: str | None, words: int, threshold: float) -> bool:
    x, y = ((_recent if t is None or len(t) <= _RECENT_CHARS else shingles)(t, words) for t in (a, b))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared + _EPS >= threshold * (len(x) + len(y) - shared)


def release() -> None:
    _recent.cache_clear()


def _verified(pairs: DataFrame, keys: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (u, v) of sids whose sets are similar; ``keys``: sid, _key, size, bits; ``texts``: _key,
    text.

    Texts travel, not sets: they are half as large, and pack.
    """
    spark = pairs.sparkSession
    side = lambda c: keys.select(F.col("sid").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits"))
    apart = F.aggregate(F.zip_with("u_bits", "v_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, n: a + n)
    room = (1 - threshold) / (1 + threshold)
    close = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(apart <= F.lit(room) * (F.col("u_size") + F.col("v_size")) + F.lit(_EPS))
    pairs = materialise(close.select("u", "v", (F.col("u_size") + F.col("v_size")).alias("size")), "pairs")
    asked, all_ = pairs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = max(1, -(-asked // max(1, int(SLICE * all_))))
    needed = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(keys.select("sid", "_key"), "sid")
    read = materialise(texts.join(needed, "_key").dropDuplicates(["sid"]).select("sid", "text"), "pair-texts")
    free_shuffles(spark)
    out = None
    for i in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(slices)) == i).select("u", "v")
        both = some.join(read.select(F.col("sid").alias("u"), F.col("text").alias("a")), "u").join(read.select(F.col("sid").alias("v"), F.col("text").alias("b")), "v")
        told = add_columns(both, ["a", "b"], lambda _, a, b: [[similar(x, y, words, threshold) for x, y in zip(a, b, strict=True)]], [T.StructField("_similar", T.BooleanType())], keep=["u", "v"])
        found = materialise(told.where("_similar").select("u", "v"), "similar")
        out = found if out is None else out.unionByName(found)
        del both, told
        free_shuffles(spark)
    discard(pairs, read)
    return out


def distinct_sets(marked: DataFrame) -> DataFrame:
    """sid, _key, size, prefix, bits once for each set that has a shingle. ``marked``: these of every row."""
    return materialise(marked.where("size > 0").groupBy("sid").agg(F.min(F.struct("_key", "size", "prefix", "bits")).alias("x")).select("sid", "x.*"), "sets")


def _rooted(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings with the root of their set, which is its own root where it is linked to none."""
    if roots is None:
        return met.withColumn("root", F.col("sid"))
    return met.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def links(sets: DataFrame, texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) links of sids whose components are those of all pairs at ``threshold`` or more.

    ``sets``: ``distinct_sets``, which go when they are done with; ``texts``: _key, text.
    """
    keys = materialise(sets.select("sid", "_key", "size", "bits"), "set-keys")
    posted = sets.select("sid", F.col("size").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # counts are a table of their own, so that the join is between exchanges and a frequent shingle is split
    lists = materialise(posted.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"), "lists")
    met = materialise(posted.join(lists, "token"), "postings")
    discard(sets, lists)
    free_shuffles(met.sparkSession)

    def fits(a: str, b: str):
        """a is the smaller set: can the two be similar, having met at these places?"""
        na, nb = F.col(f"{a}n"), F.col(f"{b}n")
        most = F.least(f"{a}pos", f"{b}pos") + F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
        return (na + F.lit(_EPS) >= F.lit(threshold) * nb) & (most + F.lit(_EPS) >= F.lit(threshold) / F.lit(1 + threshold) * (na + nb))

    postings, stars, roots, before, step = met.count(), None, None, None, 0
    while True:
        told = _rooted(met, roots)
        sizes = told.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        left = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        # few pairs are left to the last step at once, which is then the only one: each step costs some twenty jobs
        if left <= OPEN * postings or step > 1 and left > (1 - PROGRESS) * before:
            break
        # the first step's centres are those that many lists share, later ones are drawn by each list on its own
        place = F.xxhash64("sid") if step == 0 else F.xxhash64("sid", "token", F.lit(step))
        centre = F.struct(place.alias("place"), "sid", "n", "pos", "root")
        centres = told.where("members > 2").groupBy("token").agg(F.min(centre).alias("c"))
        met_c = told.join(centres, "token").select(*(F.col(x).alias(f"a{x}") for x in ("sid", "n", "pos", "root")), *(F.col(f"c.{x}").alias(f"b{x}") for x in ("sid", "n", "pos", "root")), "c.place")
        smaller = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("asid") < F.col("bsid"))
        near = met_c.where((F.col("aroot") != F.col("broot")) & F.when(smaller, fits("a", "b")).otherwise(fits("b", "a")))
        if step == 0:  # one of a member's centres
            near = near.groupBy("asid").agg(F.min_by("bsid", F.struct("place", "bsid")).alias("bsid"))
        found = _verified(near.select(F.least("asid", "bsid").alias("u"), F.greatest("asid", "bsid").alias("v")), keys, texts, words, threshold)
        stars = found if stars is None else stars.unionByName(found)
        if roots is not None:
            discard(roots)
        roots, before, step = materialise(components(stars), "roots"), left, step + 1
    rooted = _rooted(met, roots)
    if roots is not None:
        rooted = materialise(rooted, "postings")
        discard(met, roots)
        met = rooted
    # lists whose sets are all connected have no pair left
    apart = rooted.groupBy("token").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select("token")
    open_ = materialise(rooted.join(apart, "token").join(_bitmaps(keys), "sid"), "postings")
    discard(met)
    met = open_
    free_shuffles(met.sparkSession)
    root = F.col("root")
    parts = F.ceil(F.col("members") / LIST_MAX)
    cols = lambda p: [F.col("sid").alias(f"{p}sid"), F.col("n").alias(f"{p}n"), F.col("pos").alias(f"{p}pos"), root.alias(f"{p}root"), F.col("few").alias(f"{p}few"), F.col("many").alias(f"{p}many")]
    left = met.select("token", F.pmod(F.xxhash64("sid"), parts).alias("part"), *cols("a"))
    right = met.select("token", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), *cols("b"))
    order = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("asid") < F.col("bsid"))
    room = F.lit((1 - threshold) / (1 + threshold)) * (F.col("an") + F.col("bn")) + F.lit(_EPS)
    close = (_bits_apart("a", "b", "few", FEW_BITS // 64) <= room) & F.coalesce(_bits_apart("a", "b", "many", BITS // 64) <= room, F.lit(True))
    pairs = left.join(right, ["token", "part"]).where(order & (F.col("aroot") != F.col("broot")) & fits("a", "b") & close)
    found = _verified(pairs.select(F.col("asid").alias("u"), F.col("bsid").alias("v")), keys, texts, words, threshold)
    discard(keys, met)
    return found if stars is None else found.unionByName(stars)
