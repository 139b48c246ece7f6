"""Spelling variants: words one error apart, by forward and backward automata (operator 13).

A word of L code points and a near word (one code point inserted, deleted or replaced) share the first
L // 2 code points or the last L - L // 2 of the word: the error cannot be in both. Words are therefore
dealt out twice, as they are by their first ``KEY`` code points and reversed by their last ones. The
words of one key form a minimal acyclic automaton; a path's skips add up to the word's number in
order (a minimal perfect hash), which names its count. Each word is walked exactly through its half and
completed with one error, forward in the one and backward in the other automaton; what both find is
one. Every word is at least twice ``KEY`` long, so half a word holds its key and nothing is missed.

A key of more than ``BLOCK_WORDS`` words is split into blocks by a hash, each with its own automaton, and
the key's words are looked up in every block; no pair is made that is not an answer. A word has at most
2 L + 1 places for an error and an alphabet of 89 letters, which bounds its near words.

Defined results: a null text has no runs; in the number that decides on an error a null doc_id is written
``null``; repeated rows count each; an empty table gives an empty table. Other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import discard, encode, give_back, materialise, pieces, table, take_worker

MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is at least this much more frequent.
RATIO = 10
#: One run in so many loses a code point.
ERROR_EVERY = 31
KEY = MIN_LENGTH // 2
BLOCK_WORDS = 100_000
#: Words that a task looks up, about, and distinct words that a worker counts before it passes them on.
TASK_WORDS, HELD_WORDS = 50_000, 400_000

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")


def spelt(prefix: int, run: str) -> str:
    """The run as it counts: one in ``ERROR_EVERY`` loses a code point. ``prefix``: CRC of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % ERROR_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(doc_id: object, text: str | None) -> Counter[str]:
    """Words of ``MIN_LENGTH`` or more in one text; shorter runs cannot give one."""
    prefix = zlib.crc32(b"%s:" % (b"null" if doc_id is None else str(doc_id).encode()))
    out: Counter[str] = Counter()
    # bytes.lower() touches A-Z only
    for run, n in Counter(_RUN.findall(encode(text).lower().decode("utf-8", "surrogatepass"))).items():
        word = spelt(prefix, run)
        if len(word) >= MIN_LENGTH:
            out[word] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_worker(__name__)
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in pieces(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for word, n in word_counts(doc_id, text).items():
                held[word] += n
        if len(held) >= HELD_WORDS:
            yield batch()
            held = Counter()
    yield batch()
    held = Counter()
    give_back()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words met at least ``MIN_COUNT`` times."""
    met = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(_counted, "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with a perfect hash: an edge knows how many
    words come before those behind it, so a word's number is the sum along its path."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]  # open nodes along the last word
        last = ""

        def close(depth: int) -> int:
            """Nodes deeper than ``depth`` get no more edges; equal ones become one."""
            node = -1
            while len(path) > depth:
                final, out = path.pop()
                key = (final, tuple(out))
                node = known.get(key, -1)
                if node < 0:
                    node = known[key] = len(self.edges)
                    before, skips = int(final), {}
                    for c, child in out:
                        skips[c] = (child, before)
                        before += count[child]
                    self.edges.append(skips)
                    self.final.append(final)
                    count.append(before)
                if path:
                    path[-1][1].append((last[len(path) - 1], node))
            return node

        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared + 1)
            last = word
            path.extend((i == len(word), []) for i in range(shared + 1, len(word) + 1))
        self.root = close(0)

    def number(self, node: int, word: str, at: int) -> int:
        """Number, counted from ``node``, of the word that ends with ``word[at:]``; -1 if there is none."""
        edges, out = self.edges, 0
        for i in range(at, len(word)):
            edge = edges[node].get(word[i])
            if edge is None:
                return -1
            node = edge[0]
            out += edge[1]
        return out if self.final[node] else -1

    def near(self, word: str, exact: int) -> dict[int, str]:
        """Words (by number) that agree with the first ``exact`` code points and differ by one error."""
        node, number, found = self.root, 0, {}
        for c in word[:exact]:
            edge = self.edges[node].get(c)
            if edge is None:
                return found
            node, number = edge[0], number + edge[1]
        for i in range(exact, len(word) + 1):
            own = word[i] if i < len(word) else ""
            before = word[i - 1] if i > exact else ""  # the same letter again: as good one place before
            for c, (child, skip) in self.edges[node].items():
                if c != before and (k := self.number(child, word, i)) >= 0:
                    found[number + skip + k] = word[:i] + c + word[i:]
                if own and c != own and (k := self.number(child, word, i + 1)) >= 0:
                    found[number + skip + k] = word[:i] + c + word[i + 1 :]
            if not own:
                break
            if own != before and (k := self.number(node, word, i + 1)) >= 0:
                found[number + k] = word[:i] + word[i + 1 :]
            edge = self.edges[node].get(own)
            if edge is None:
                break
            node, number = edge[0], number + edge[1]
        return found


#: What a posted word is for.
_BOTH, _ENTRY, _ASKED = 0, 1, 2


def _postings(words: DataFrame) -> DataFrame:
    """(backward, key, block, role, w, n): words of a split key are entries of one block, asked in all."""
    forward = words.select(F.lit(False).alias("backward"), F.col("word").alias("w"), "n")
    both = forward.unionByName(words.select(F.lit(True).alias("backward"), F.reverse("word").alias("w"), "n"))
    both = both.withColumn("key", F.substring("w", 1, KEY))
    # at most 2 x words / BLOCK_WORDS keys
    split = both.groupBy("backward", "key").agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("blocks")).where("blocks > 1")
    both = both.join(split, ["backward", "key"], "left")
    whole = both.where("blocks IS NULL").select("backward", "key", F.lit(0).alias("block"), F.lit(_BOTH).alias("role"), "w", "n")
    parts = both.where("blocks IS NOT NULL")
    entries = parts.select("backward", "key", F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int").alias("block"), F.lit(_ENTRY).alias("role"), "w", "n")
    asked = parts.select("backward", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(_ASKED).alias("role"), "w", "n")
    return whole.unionByName(entries).unionByName(asked)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, entries first and in order."""
    take_worker(__name__)
    group, words, counts = None, [], []
    automaton, numbers = None, None
    out: tuple[list, list, list] = ([], [], [])

    def build() -> None:
        nonlocal automaton, numbers
        automaton, numbers = Automaton(words), np.array(counts, dtype=np.int64)

    def ask(word: str, backward: bool) -> None:
        half = len(word) // 2
        for number, near in automaton.near(word, len(word) - half if backward else half).items():
            out[0].append(word[::-1] if backward else word)
            out[1].append(near[::-1] if backward else near)
            out[2].append(int(numbers[number]))

    def end(role: int) -> None:
        """The entries of a group are all there; unless they are asked by others, they ask themselves."""
        if automaton is None and words:
            build()
            if role == _BOTH:
                for w in words:
                    ask(w, group[0])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "n"])
        for x in out:
            x.clear()
        return made

    role = _BOTH
    for b in batches:
        for backward, key, block, kind, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (backward, key, block) != group:
                end(role)
                if len(out[0]) >= 50_000:
                    yield batch()
                group, words, counts, automaton, role = (backward, key, block), [], [], None, kind
            if kind == _ASKED:
                if automaton is None:
                    build()
                ask(w, backward)
            else:
                words.append(w)
                counts.append(n)
        if len(out[0]) >= 50_000:
            yield batch()
    end(role)
    yield batch()
    give_back()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): near is the set of (n, word) of all words one error apart, for words that have any."""
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-2 * words.count() // TASK_WORDS))
    posted = _postings(words).repartition(tasks, "backward", "key", "block").sortWithinPartitions("backward", "key", "block", "role", "w")
    met = posted.select("backward", "key", "block", "role", "w", "n").mapInArrow(_looked_up, "word string, near string, n long")
    # found by both automata: once in the set
    return met.groupBy("word").agg(F.collect_set(F.struct((-F.col("n")).alias("less"), "near")).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last. A form is ``RATIO`` times as frequent, so
    a chain has at most 18 links, and following doubles what is followed in each round."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after.select("word", "root")
        now._scratch_path = after._scratch_path
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    words = materialise(vocabulary(docs, doc_id, text), "vocabulary")
    best = F.array_min("near")
    near = near_words(words).select(F.col("word"), F.size("near").cast("long").alias("n_near"), best.near.alias("top"), (-best.less).alias("top_n"))
    told = words.join(near, "word", "left").withColumn("has", F.col("top_n") >= RATIO * F.col("n"))
    told = materialise(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("IF(has, top, NULL)").alias("form"), F.expr("IF(has, top_n, NULL)").alias("form_n")), "spelling-forms")
    last = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
