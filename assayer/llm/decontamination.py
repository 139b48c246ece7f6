"""Benchmark decontamination with an FM-index for each training shard (operator 7).

A shard is an Arrow batch of documents. Its words become symbols (the vocabulary is the words of the
test phrases; other words part the text and hold no occurrence), the shard's suffixes are sorted,
and the Burrows-Wheeler transform is kept as a wavelet tree with rank counts. All test phrases are
searched backward together; the rows of a match are led by LF steps to the nearest sampled suffix,
which gives the place. Occurrences are merged to removal spans, which never cross documents.

A test phrase is a window of 13 consecutive words of an item, or the whole of a shorter item. The
benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, so what a task holds of it is
bounded; documents are indexed once for each block and the blocks' hits are united.

Defined results: a null or empty text has no words and is not contaminated; an item without words
has no window; items that share an id are one item; an item without id marks words and is counted
as the item "null"; repeated documents are judged one by one; with an empty benchmark nothing is
hit; with no documents the result is empty. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import add_columns, encode, table

WINDOW_WORDS = 13
SAMPLE_EVERY = 16
BLOCK_BYTES = 16_000_000
#: Words indexed together at most (a longer document is indexed alone).
SHARD_WORDS = 1_000_000
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return encode(text).translate(_FOLD).split()


@dataclass
class Phrases:
    """Test phrases by length: word ids, and the items that each phrase belongs to."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]
    names: list[str]

    @classmethod
    def build(cls, rows: Iterable[tuple[object, str | None]], window: int = WINDOW_WORDS) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in rows:
            w = words_of(text)
            if not w:
                continue
            at = names.setdefault("null" if item is None else str(item), len(names))
            ids = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(at)
        return cls(vocabulary, {n: np.array(list(d), dtype=np.int64) for n, d in found.items()}, {n: [sorted(s) for s in d.values()] for n, d in found.items()}, list(names))


class WaveletTree:
    """Rank over symbols 0 .. 2^levels - 1, one row of bits for each level, most significant first;
    each level keeps zeros before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n = len(symbols)
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        rest = symbols
        for level in reversed(range(self.levels)):
            bit = (rest >> level) & 1
            count = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        end, start = at, np.zeros(len(at), dtype=np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            e, s = self.ones[k][end], self.ones[k][start]
            end = np.where(one, self.zeros[k] + e, end - e)
            start = np.where(one, self.zeros[k] + s, start - s)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its rank there)."""
        symbol = np.zeros(len(at), dtype=np.int64)
        end, start = at, np.zeros(len(at), dtype=np.int64)
        for k in range(self.levels):
            e, s = self.ones[k][end], self.ones[k][start]
            one = (self.ones[k][end + 1] - e).astype(bool)
            symbol = symbol * 2 + one
            end = np.where(one, self.zeros[k] + e, end - e)
            start = np.where(one, self.zeros[k] + s, start - s)
        return symbol, end - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes, by doubling; the last symbol must be the only least one."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int, every: int = SAMPLE_EVERY):
        """``symbols`` ends with the only 0; all are below ``size``."""
        order = suffix_order(symbols)
        self.bwt = WaveletTree(symbols[order - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        sampled = order % every == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of each phrase (rows of symbols), by backward search."""
        n, width = phrases.shape
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.bwt.n, dtype=np.int64)
        live = np.arange(n)
        for j in reversed(range(width)):
            c = phrases[live, j]
            a, b = self.before[c] + self.bwt.rank(c, low[live]), self.before[c] + self.bwt.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        empty = np.ones(n, dtype=bool)
        empty[live] = False
        high[empty] = low[empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol, rank = self.bwt.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return out


def hits(docs: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each document its merged spans of hit words (first, last + 1) and the items that occur."""
    found: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in docs]
    if not phrases.by_length:
        return found
    shortest = min(phrases.by_length)
    # symbols: 0 ends the shard, 1 parts the runs of known words, then the vocabulary
    get = phrases.vocabulary.get
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(lengths.sum())
    ids = np.fromiter((get(w, -1) for d in docs for w in d), dtype=np.int64, count=total)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return found
    cut = np.ones(len(known), dtype=bool)
    cut[1:] = np.diff(known) > 1
    cut |= np.isin(known, starts)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(known)))
    first, size = first[size >= shortest], size[size >= shortest]
    if not len(first):
        return found
    # each run, then one parting symbol
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    within = np.arange(offset[-1]) - np.repeat(offset[:-1], size + 1)
    is_word = within < np.repeat(size, size + 1)
    origin = np.where(is_word, known[np.minimum(np.repeat(first, size + 1) + within, len(known) - 1)], -1)
    symbols = np.where(is_word, ids[np.maximum(origin, 0)] + 2, 1)
    symbols = np.append(symbols, 0)
    index = FMIndex(symbols, len(phrases.vocabulary) + 2)
    mark = np.zeros(total + 1, dtype=np.int64)
    for width, table_ in phrases.by_length.items():
        low, high = index.search(table_ + 2)
        count = high - low
        which = np.repeat(np.arange(len(table_)), count)
        if not len(which):
            continue
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        place = origin[index.locate(rows)]
        np.add.at(mark, place, 1)
        np.add.at(mark, place + width, -1)
        doc = np.searchsorted(ends, place, side="right")
        for d, p in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
            found[d][1].update(phrases.items[width][p])
    hit = np.cumsum(mark)[:-1] > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a run of hits may go on into the next document
            d = int(np.searchsorted(ends, a, side="right"))
            stop = min(b, int(ends[d]))
            found[d][0].append((a - int(starts[d]), stop - int(starts[d])))
            a = stop
    return found


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def phrase_blocks(benchmark: DataFrame) -> list[Phrases]:
    """The test phrases, in blocks of bounded size; the whole benchmark is covered."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [Phrases.build((r.item_id, r.text) for r in rows.where(part == i).toLocalIterator()) for i in range(n)]


def mark_documents(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Append n_words, spans (of hit words) and items (ids, sorted as strings)."""
    out = docs
    for k, phrases in enumerate(phrase_blocks(benchmark)):
        side = docs.sparkSession.sparkContext.broadcast(phrases)  # bounded by BLOCK_BYTES of text

        def compute(_: object, texts: list, *before: list, side=side) -> list:
            found: list = []
            group: list[list[bytes]] = []
            size, sizes = 0, []
            for t in texts:
                group.append(words_of(t))
                sizes.append(len(group[-1]))
                size += sizes[-1]
                if size >= SHARD_WORDS:
                    found += hits(group, side.value)
                    group, size = [], 0
            found += hits(group, side.value)
            names = side.value.names
            spans = [[{"first": a, "end": b} for a, b in s] for s, _ in found]
            items = [sorted({names[i] for i in n}) for _, n in found]
            if before:
                spans = [_united(a, b) for a, b in zip(spans, before[0], strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, before[1], strict=True)]
            return [sizes, spans, items]

        inputs = [text] if k == 0 else [text, "spans", "items"]
        kept = None if keep is None else list(dict.fromkeys([*keep, text]))
        out = add_columns(out, inputs, compute, FIELDS, keep=kept)
    return out if keep is None else out.select(*[f"`{c}`" for c in keep], *(f.name for f in FIELDS))


def _united(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda x: x["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1] = {"first": out[-1]["first"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def with_verdict(marked: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.first)
    out = marked.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    return with_verdict(mark_documents(own, benchmark)).where(~F.col("contaminated")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = with_verdict(mark_documents(docs.select("doc_id", "text"), benchmark, keep=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
