"""Exact removal of long repeated byte strings, by blockwise suffix sorting (operator 8).

A start is repeated if its ``LENGTH``-byte string also starts anywhere else, in any document; every
byte that a repeated start covers is removed.

Suffix buckets. Within the first ``WINDOW`` positions after a start lies one with the least hash of
16 bytes, its anchor. The anchor and its distance k depend on the start's own string alone, so equal
strings have equal k and equal text from the anchor on: starts can only be equal within one bucket,
keyed by the ``LENGTH - WINDOW + 1`` bytes after the anchor. Neighbouring starts with one anchor are
a run, and a bucket holds runs. A bucket of one run repeats nothing. A bucket whose runs have equal
text throughout repeats all of it. The others are sorted. Runs are of equal text if two independent
64-bit hashes of their bytes (polynomial, and XXH3) and their places agree: 128 bits, as the texts of
equal runs are not brought together.

Repeated texts. Rows of equal text have equal runs, which become one with a weight before anything is
exchanged by bucket or gathered for a document, so that no number of copies makes a longer list. Every run
of a repeated text is repeated; one of the rows lends its bytes to the buckets that need them.

Sorting. Runs of equal text are one member with a weight. For a block of buckets the ranks of the
suffixes at a difference cover (period 31: for any two positions some distance below 31 brings both
into the cover) are computed first, by doubling; then the suffixes of one bucket and distance are
sorted by their bytes before the next cover position, and ties are resolved by the cover rank
there. Equal strings end up side by side. A task holds one block, whatever the length of the ties.

A bucket of more than ``BUCKET_RUNS`` runs (a passage in very many documents) would not fit one task:
its strings are counted by a 128-bit hash, summed before the shuffle, and a string is repeated if its
weight is two or more. Both ways find the same strings.

Defined results: the kept bytes, as text, have U+FFFD where a cut goes through a character; null and empty texts have no bytes and lose none; texts shorter than ``LENGTH`` lose
none; repeated rows are repeats of each other, whatever their ids; a null id is kept; an empty table
gives an empty table. A text is named by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import discard, encode, free_shuffles, materialise, pieces, table

LENGTH = 400
WINDOW = 256
GRAM = 16
CORE = LENGTH - WINDOW + 1
BUCKET_RUNS = 2048
BLOCK_MEMBERS = 512
#: Starts hashed together; longer texts are taken in pieces.
SEGMENT = 400_000
#: A perfect difference set: every distance below 31 is a difference of two of these modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Roller:
    """64-bit hashes of any stretch of a buffer, from prefix sums."""

    _up = _powers(_BASE, SEGMENT + 2 * LENGTH + 1)
    _down = _powers(_BASE_INVERSE, SEGMENT + 2 * LENGTH + 1)

    def __init__(self, octets: np.ndarray):
        n = len(octets)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[octets] * self._up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return _finish((self.sums[start + size] - self.sums[start]) * self._down[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each stretch of ``width`` values."""
    span = 1
    out = values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :])


def find_runs(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of the starts of each piece: (piece, first start, anchor, last start, bucket, two hashes of
    the text). Pieces together must fit a ``Roller``."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    raw = b"".join(pieces)
    octets = np.frombuffer(raw, dtype=np.uint8)
    n = len(octets)
    roller = Roller(octets)
    place = np.arange(n - GRAM + 1, dtype=np.int64)
    grams = roller.hash(place, GRAM) & np.uint64(0xFFFFFFFFFF000000) | place.astype(np.uint64)
    anchor = (_least(grams, WINDOW) & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes - LENGTH + 1)
    count = sizes - LENGTH + 1
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - sizes, count)
    at = anchor[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, mid, own = start[first], start[last], at[first], piece[first]
    bucket = roller.hash(mid, CORE)
    text = roller.hash(low, high - low + LENGTH)
    text = _finish(text ^ ((mid - low).astype(np.uint64) << np.uint64(20)) ^ (high - low).astype(np.uint64))
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    more = np.fromiter((digest(view[a:b]) for a, b in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)), dtype=np.uint64, count=len(low))
    base = (ends - sizes)[own]
    return own, low - base, mid - base, high - base, bucket, text, more


def runs_of(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole texts; a text beyond ``SEGMENT`` is taken in pieces that overlap by LENGTH - 1."""
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def done() -> tuple[np.ndarray, ...]:
        own, low, mid, high, bucket, text, more = find_runs([p for _, _, p in group])
        base = np.array([b for _, b, _ in group], dtype=np.int64)[own]
        return np.array([i for i, _, _ in group], dtype=np.int64)[own], low + base, mid + base, high + base, bucket, text, more

    for i, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, SEGMENT):
            piece = t[at : at + SEGMENT + LENGTH - 1]
            if group and size + len(piece) > SEGMENT + LENGTH:
                yield done()
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield done()


def _head(octets: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place, zeros behind up to whole words, as big-endian 64-bit words: (word, place)."""
    rows = np.zeros((len(at), -(-size // 8) * 8), dtype=np.uint8)
    rows[:, :size] = np.lib.stride_tricks.sliding_window_view(octets, size)[at]
    return rows.view(">u8").astype(np.uint64).T


def cover_ranks(octets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the suffix at each cover position by its first ``depth`` bytes or more, 0 elsewhere; and the rank
    of the step before, by half as many bytes.

    By doubling with the period as step: position + period is in the cover as well. ``octets`` ends in
    zeros, at least ``depth`` of them doubled.
    """
    n = len(octets) - 2 * PERIOD
    sample = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    sample = sample[sample < n]
    words = _head(octets, sample, PERIOD)
    order = np.lexsort(words[::-1])
    fresh = np.zeros(len(sample), dtype=np.int64)
    fresh[order[1:]] = np.cumsum((words[:, order[1:]] != words[:, order[:-1]]).any(axis=0))
    rank = np.zeros(len(octets) + 2 * depth, dtype=np.int64)
    rank[sample] = fresh + 1
    reach, half = PERIOD, rank
    while reach < depth:
        half = rank.copy()
        key = rank[sample] * (len(sample) + 2) + rank[sample + reach]
        rank[sample] = np.unique(key, return_inverse=True)[1] + 1
        reach *= 2
    return rank, half


_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
#: So many bytes at most lie before the next cover position; two words hold them and a rank below 2 ** 32.
_GAP = int(_NEXT.max())


def repeated_starts(buckets: np.ndarray, distance: np.ndarray, runs: np.ndarray, weights: np.ndarray, slices: list[bytes]) -> list[np.ndarray]:
    """For each member (text slice, run length, distance of the anchor from its first start, weight) of
    a block of buckets: which starts of its run are repeated."""
    # lay the slices out so that anchors have one residue: equal strings then have the same residue
    place, total = [], 0
    for d, s in zip(distance.tolist(), slices, strict=True):
        total += (-(total + d)) % PERIOD
        place.append(total)
        total += len(s)
    octets = np.zeros(total + 2 * LENGTH + 4 * PERIOD, dtype=np.uint8)
    for at, s in zip(place, slices, strict=True):
        octets[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
    ranks, half = cover_ranks(octets, LENGTH)
    member = np.repeat(np.arange(len(slices)), runs)
    within = np.arange(len(member)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = np.array(place, dtype=np.int64)[member] + within
    group = np.unique(buckets, return_inverse=True)[1][member] * LENGTH + distance[member] - within
    skip = _NEXT[start % PERIOD]
    cover = start + skip
    rows = np.lib.stride_tricks.sliding_window_view(octets, _GAP)[start]
    rows = np.pad(np.where(np.arange(_GAP) < skip[:, None], rows, 0).astype(np.uint8), ((0, 0), (0, 16 - _GAP)))
    first, second = rows.view(">u8").astype(np.uint64).T
    tie = ranks[cover]
    order = np.lexsort((second | tie.astype(np.uint64), first, group))
    a, b = order[:-1], order[1:]
    near = (group[a] == group[b]) & (first[a] == first[b]) & (second[a] == second[b])
    same = near & (tie[a] == tie[b])  # equal for more than LENGTH bytes
    # equal for half of that: the bytes decide
    view = np.lib.stride_tricks.sliding_window_view(octets, LENGTH)
    open_ = np.flatnonzero(near & ~same & (half[cover[a]] == half[cover[b]]))
    for at in range(0, len(open_), 20_000):
        some = open_[at : at + 20_000]
        same[some] = (view[start[a[some]]] == view[start[b[some]]]).all(axis=1)
    again = weights[member] > 1
    again[a[same]] = True
    again[b[same]] = True
    return np.split(again, np.cumsum(runs)[:-1])


RUNS = "id long, th long, place long, bucket long, text_hash long, more_hash long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
#: A run's place: first start, then distance of the anchor and of the last start in ten bits each.
_LOW, _MID, _BITS = 20, 10, 1023


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, _KINDS.get(k)) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
        for own, low, mid, high, bucket, text, more in runs_of(encode(t.as_py()) for t in b.column(2)):
            yield _batch(RUNS, [ids[own], ths[own], low << _LOW | (mid - low) << _MID | (high - low), bucket.view(np.int64), text.view(np.int64), more.view(np.int64)])


STATE = (
    "doc_id long, id long, th long, n_bytes long, removed array<struct<first:long,end:long>>, kept_sha256 string, kept string, text string, pure array<struct<low:long,high:long>>, "
    "mixed array<struct<place:long,bucket:long,text_hash:long,more_hash:long>>, members array<struct<bucket:long,text_hash:long,more_hash:long,n:long,weight:long,distance:int,runs:int,slice:binary>>"
)
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_PURE = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
_MIXED = pa.list_(pa.struct([("place", pa.int64()), ("bucket", pa.int64()), ("text_hash", pa.int64()), ("more_hash", pa.int64())]))
_MEMBERS = pa.list_(pa.struct([("bucket", pa.int64()), ("text_hash", pa.int64()), ("more_hash", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("distance", pa.int32()), ("runs", pa.int32()), ("slice", pa.binary())]))


def _octets(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _items(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of a column of lists of structs: the row of each item, and the items' fields."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().flatten()


def _lists(own: np.ndarray, rows: int, fields: list[pa.Array], kind: pa.ListType, null: np.ndarray) -> pa.Array:
    """A list for each row of the items that it owns, which come in the order of rows; null where said."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]).astype(np.int32)
    items = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), items, type=kind, mask=pa.array(null))


def _merged(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed spans (row, first, end) of the repeated starts from low to high of each row, rows in order."""
    if not len(own):
        return own, low, high
    base = own.astype(np.int64) << 40  # rows lie apart on one line
    order = np.argsort(base + low, kind="stable")
    first, end = (base + low)[order], np.maximum.accumulate((base + high)[order] + LENGTH)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    row = first[new] >> 40
    return row, first[new] - (row << 40), end[np.append(new[1:] - 1, len(end) - 1)] - (row << 40)


def _finished(raws: list[bytes], own: np.ndarray, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> list[pa.Array]:
    """removed, kept_sha256 and kept of each row; null where it is open."""
    row, first, end = _merged(own, low, high)
    removed = _lists(row, len(raws), [pa.array(first, pa.int64()), pa.array(end, pa.int64())], _SPANS, open_)
    bounds = np.searchsorted(row, np.arange(len(raws) + 1)).tolist()
    first, end = first.tolist(), end.tolist()
    hashes, kept = [], []
    for i, (raw, wait) in enumerate(zip(raws, open_.tolist(), strict=True)):
        at, parts = 0, []
        for j in range(bounds[i], bounds[i + 1]):
            parts.append(raw[at : first[j]])
            at = end[j]
        left = b"".join([*parts, raw[at:]]) if parts else raw
        hashes.append(None if wait else hashlib.sha256(left).hexdigest())
        kept.append(None if wait else left.decode("utf-8", "replace") if parts else left)
    return [removed, pa.array(hashes, pa.string()), pa.array(kept, pa.string())]


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what the buckets say of them: finished where no run must be sorted, else kept with
    the text slices that this document lends to its buckets."""
    lenders: set[tuple[int, int]] = set()  # 16 bytes a text of this task: one row of each lends
    for b in pieces(batches):
        rows, raws = b.num_rows, _octets(b.column("text"))
        own, (kind, *told) = _items(b.column("told"))
        kind = kind.to_numpy()
        lends = np.zeros(rows, dtype=bool)
        ids, ths = b.column("id").to_numpy(), b.column("th").to_numpy()
        for i in np.unique(own[kind == 2]).tolist():
            name = (int(ids[i]), int(ths[i]))
            lends[i] = name not in lenders
            lenders.add(name)
        settled, unsettled, lent = kind == 0, kind == 1, (kind == 2) & lends[own]
        open_ = np.zeros(rows, dtype=bool)
        open_[own[unsettled | lent]] = True
        place = told[0].to_numpy()
        low, distance, last = place >> _LOW, place >> _MID & _BITS, place & _BITS
        done = settled & ~open_[own]
        finished = _finished(raws, own[done], low[done], (low + last)[done], open_)
        wait = settled & open_[own]
        pure = _lists(own[wait], rows, [pa.array(low[wait], pa.int64()), pa.array((low + last)[wait], pa.int64())], _PURE, ~open_)
        some = pa.array(unsettled)
        mixed = _lists(own[unsettled], rows, [x.filter(some) for x in told[:4]], _MIXED, ~open_)
        some = pa.array(lent)
        slices = pa.array([raws[i][at : at + n + LENGTH] for i, at, n in zip(own[lent].tolist(), low[lent].tolist(), last[lent].tolist(), strict=True)], pa.binary())
        fields = [*(x.filter(some) for x in told[1:]), pa.array(distance[lent], pa.int32()), pa.array(last[lent] + 1, pa.int32()), slices]
        nothing = np.bincount(own[lent], minlength=rows) == 0
        members = _lists(own[lent], rows, fields, _MEMBERS, nothing)
        text = b.column("text").take(pa.array(np.arange(rows), mask=~open_))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("id"), b.column("th"), pa.array([len(x) for x in raws], pa.int64()), *finished, text, pure, mixed, members],
            names=["doc_id", "id", "th", "n_bytes", "removed", "kept_sha256", "kept", "text", "pure", "mixed", "members"],
        )


def _end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        raws = _octets(b.column("text"))
        own, (low, high) = _items(b.column("pure"))
        part, (place, again) = _items(b.column("parts"))
        sizes = again.value_lengths().to_numpy()
        start = np.repeat(place.to_numpy() >> _LOW, sizes) + again.flatten().to_numpy()
        own, low, high = np.append(own, np.repeat(part, sizes)), np.append(low.to_numpy(), start), np.append(high.to_numpy(), start)
        finished = _finished(raws, own, low, high, np.zeros(len(raws), dtype=bool))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *finished], names=["doc_id", "n_bytes", "removed", "kept_sha256", "kept"])


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a block is whole buckets."""
    names = ["bucket", "text_hash", "more_hash", "weight", "distance", "runs", "slice"]
    held: list[tuple] = []

    def block(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[:3]: r for r in rows}.values())  # repeated rows gave their slice twice
        columns = list(zip(*rows, strict=True))
        found = repeated_starts(np.array(columns[0]), np.array(columns[4], dtype=np.int64), np.array(columns[5], dtype=np.int64), np.array(columns[3]), list(columns[6]))
        again = pa.array([np.flatnonzero(x).tolist() for x in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), again], names=["bucket", "text_hash", "more_hash", "again"])

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if len(held) >= BLOCK_MEMBERS and row[0] != held[-1][0]:
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def _repeated_members(members: DataFrame) -> DataFrame:
    """(bucket, text_hash, more_hash, again): the repeated starts of each member's run."""
    small = members.where(F.col("n") <= BUCKET_RUNS).select("bucket", "text_hash", "more_hash", "weight", "distance", "runs", "slice")
    small = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_blocks, "bucket long, text_hash long, more_hash long, again array<int>")
    # large buckets: count the strings themselves
    large = members.where(F.col("n") > BUCKET_RUNS).dropDuplicates(["bucket", "text_hash", "more_hash"])
    string = F.expr(f"substring(slice, p + 1, {LENGTH})")
    strings = large.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    strings = strings.select("bucket", "text_hash", "more_hash", "weight", "p", (F.col("distance") - F.col("p")).alias("k"), F.xxhash64(string).alias("g"), F.xxhash64(F.lit(1), string).alias("h"))
    twice = strings.groupBy("bucket", "k", "g", "h").agg(F.sum("weight").alias("w")).where("w > 1").drop("w")
    counted = strings.join(twice, ["bucket", "k", "g", "h"], "left_semi").groupBy("bucket", "text_hash", "more_hash").agg(F.collect_list("p").alias("again"))
    return small.unionByName(counted).where(F.size("again") > 0)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and th, 128 bits together, name a text."""
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.xxhash64(t).alias("id"), F.xxhash64(F.lit(8), t).alias("th"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), t.alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (byte spans), kept_sha256 (of the remaining bytes) and kept (those bytes
    as text).

    Texts are exchanged once; only those with a run to be sorted are kept for a second, later join.
    """
    rows = _keyed(docs, doc_id, text)
    # one row a run of a text, summed in each task before the exchange: copies add to its weight
    runs = rows.select("id", "th", "text").mapInArrow(_runs, RUNS).groupBy("id", "th", "place", "bucket", "text_hash", "more_hash").agg(F.count("*").alias("weight"))
    runs = materialise(runs, "suffix-runs")
    mixed_up = (F.min("text_hash") != F.max("text_hash")) | (F.min("more_hash") != F.max("more_hash"))
    several = runs.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("rows"), mixed_up.alias("mixed")).where("rows > 1").drop("rows")
    # a table of its own, one row a bucket: the join below is then between exchanges, and a bucket of very
    # many runs is split among tasks
    several = materialise(several, "suffix-several")
    met = materialise(runs.join(several, "bucket"), "suffix-buckets")
    discard(runs, several)
    free_shuffles(docs.sparkSession)
    mixed = met.where("mixed")
    lenders = mixed.groupBy("bucket", "text_hash", "more_hash", "n").agg(F.sum("weight").alias("weight"), F.min(F.struct("id", "th", "place")).alias("r"))
    none = F.lit(None).cast("long")
    # what is open to a sort is a run of a text that has no copy
    unsettled = F.col("mixed") & (F.col("weight") == 1)
    if_open = lambda c: F.when(unsettled, F.col(c)).alias(c)
    own = F.struct(unsettled.cast("int").alias("kind"), "place", if_open("bucket"), if_open("text_hash"), if_open("more_hash"), none.alias("n"), none.alias("weight"))
    lent = F.struct(F.lit(2).alias("kind"), F.col("r.place").alias("place"), "bucket", "text_hash", "more_hash", "n", "weight")
    told = met.select("id", "th", own.alias("x")).unionByName(lenders.select("r.id", "r.th", lent.alias("x"))).groupBy("id", "th").agg(F.collect_list("x").alias("told"))
    state = materialise(rows.join(told, ["id", "th"], "left").mapInArrow(_begin, STATE), "suffix-state")
    again = _repeated_members(state.where("members IS NOT NULL").select(F.inline("members")))
    parts = state.where("mixed IS NOT NULL").select("id", "th", F.inline("mixed")).join(again, ["bucket", "text_hash", "more_hash"]).groupBy("id", "th").agg(F.collect_list(F.struct("place", "again")).alias("parts"))
    open_ = state.where("text IS NOT NULL").select("doc_id", "id", "th", "n_bytes", "text", "pure").join(parts, ["id", "th"], "left")
    ended = open_.mapInArrow(_end, "doc_id long, n_bytes long, removed array<struct<first:long,end:long>>, kept_sha256 string, kept string")
    return state.where("text IS NULL").select("doc_id", "n_bytes", "removed", "kept_sha256", "kept").unionByName(ended)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s.end - s.first)
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", F.col("kept").alias("text"), "removed")
