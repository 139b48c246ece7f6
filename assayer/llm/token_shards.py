"""Token-id shards with a minimal perfect hash index (operator 3).

Documents are encoded in ascending key order. Every task writes one shard, three raw files beside each
other in the shared folder:

* ``.ids``: little-endian unsigned ids, one end id after each document, nothing else; an id has 16 bits
  where the vocabulary fits them, else 32;
* ``.idx``: a minimal perfect hash over the shard's distinct keys; a key's slot stores a 32-bit
  fingerprint of the key, the ordinal of its first document and how many documents carry the key; then
  the place of each document's ids. Keys are not stored: the fingerprint alone tells a stranger, and it
  errs for one stranger in 2^32;
* ``.keys``: the documents' keys in order, for those who list a shard. A keyed access never opens it.

A keyed access costs a few hashes, one fingerprint comparison and one read of the document's own
bytes, whatever the size of the shard (``Shard.get``).

The files are streamed, so a shard may be of any length. Their names are new for each attempt of a
task, and the directory of shards is a Parquet table that Spark's committer writes: only files that it
names count, so a lost executor leaves at most files that nobody reads. The folder must be on a store
that ``pyarrow.fs`` knows (file, hdfs, s3, gs).

Texts are cut where a space stands next to a character that is not white space. The byte-level
pre-tokenizer always cuts there, so each distinct piece is segmented once in a worker and its ids are
joined back; what the pre-tokenizer makes of a new piece is looked up in a second table, and only what
that lacks goes through the library's merges. The tables are emptied at a size; only speed depends on
it. Pieces with uncommon characters or with special tokens are encoded by the whole library.

Defined results: a null text is empty and gives the end id alone; null keys come first; rows that
share a key follow each other, ordered by a hash of the text and, where that is equal as well, by their
place in the input; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import remove_at_exit, scratch_path, table

END_ID = 2
TABLE_CHUNKS = 600_000
LONGEST_REMEMBERED = 200
#: Bytes of a shard that a reader holds at once.
READ_BYTES = 4_000_000
MAGIC = b"TKB2"
#: Bits for each key and level of the hash; more bits, fewer levels.
GAMMA = 2
MAX_LEVELS = 48
_ODD = re.compile(r"\s \s")
_CUT = re.compile(r"(?<=\S) | (?=\S)")
#: Letters and numbers among the characters of which every version of Unicode says the same.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_UNCOMMON = re.compile("[^ \n!-~\xa1-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
#: Fixed value: the pattern of the byte-level pre-tokenizer, for common characters.
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^ \n{_LETTERS}{_NUMBERS}]+|[ \n]+(?![^ \n])|[ \n]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(printable))
    return out


class _Remembered(dict):
    """A dictionary that makes what it lacks; emptied at ``TABLE_CHUNKS`` entries."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        return self.remember(key, self.make(key))

    def remember(self, key: str, made: bytes) -> bytes:
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= TABLE_CHUNKS:
                self.clear()
            self[key] = made
        return made


class ChunkTokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.form = {2: "H", 4: "I"}[self.width]
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokens = _Remembered(self._merged)
        self.spaced = _Remembered(lambda rest: self._common(" " + rest))

    def _merged(self, pre_token: str) -> bytes:
        ids = [t.id for t in self.merge(pre_token.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def _common(self, piece: str) -> bytes:
        """Ids of a piece of common characters that holds no special token."""
        if piece[1:].isalpha() and piece[0] == " ":
            return self.pre_tokens[piece]
        return b"".join(map(self.pre_tokens.__getitem__, _PRE_TOKENS.findall(piece)))

    def _any(self, piece: str) -> bytes:
        if _UNCOMMON.search(piece) or any(s in piece for s in self.special):
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()
        return self._common(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _UNCOMMON.search(text) and not any(s in text for s in self.special):
            odd = ("  " in text or "\n \n" in text) and _ODD.search(text)
            first, *rest = _CUT.split(text) if odd else text.split(" ")
            return (self._common(first) if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        first, *rest = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        known = [self.spaced.get(p) for p in rest]
        return (self._any(first) if first else b"") + b"".join(self.spaced.remember(p, self._any(" " + p)) if k is None else k for p, k in zip(rest, known, strict=True))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return map(self.encode, texts)


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def release() -> None:
    """Empties the worker's tables."""
    chunk_tokenizer.cache_clear()


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (multiply, shift, xor) of key and seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FINGERPRINT_SEED = 1_000_003


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key that lands alone on a bit
    keeps it; the others go to the next level. A key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, levels = np.asarray(keys, dtype=np.uint64), []
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            m = -(-max(8, GAMMA * len(rest)) // 8) * 8
            at = (mix(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit (the key is surely absent)."""
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: memoryview) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            (m,) = struct.unpack_from("<I", raw, at)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, m // 8, at + 4)).astype(bool))
            at += 4 + m // 8
        return cls(levels), at


SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("docs", "<u4")])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


class Index:
    """What ``.idx`` holds: bytes of an id, perfect hash, slots, and the place of each document's ids."""

    def __init__(self, width: int, n_null: int, mph: PerfectHash, slots: np.ndarray, bounds: np.ndarray):
        self.width, self.n_null, self.hash, self.slots, self.bounds = width, n_null, mph, slots, bounds

    @classmethod
    def build(cls, keys: np.ndarray, n_null: int, sizes: np.ndarray, width: int = 4) -> Index:
        """Of documents in key order; the first ``n_null`` have no key."""
        uniq, first, count = np.unique(keys[n_null:].astype(np.int64).view(np.uint64), return_index=True, return_counts=True)
        mph = PerfectHash.build(uniq)
        slots = np.zeros(mph.size, dtype=SLOT)
        at = mph.slots(uniq)
        slots["fingerprint"][at], slots["first"][at], slots["docs"][at] = _fingerprints(uniq), first + n_null, count
        return cls(width, n_null, mph, slots, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))

    def dump(self) -> bytes:
        return MAGIC + struct.pack("<IQQ", self.width, len(self.bounds) - 1, self.n_null) + self.hash.dump() + self.slots.tobytes() + self.bounds.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        if raw[:4] != MAGIC:
            raise ValueError("not a token index")
        width, n, n_null = struct.unpack_from("<IQQ", raw, 4)
        mph, used = PerfectHash.load(memoryview(raw)[24:])
        slots = np.frombuffer(raw, SLOT, mph.size, 24 + used)
        return cls(width, n_null, mph, slots, np.frombuffer(raw, "<u8", n + 1, 24 + used + slots.nbytes).astype(np.int64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, number of documents) of each key; number 0 where absent."""
        keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
        at = self.hash.slots(keys)
        ok = at >= 0
        ok[ok] = self.slots["fingerprint"][at[ok]] == _fingerprints(keys[ok])
        first, docs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[ok], docs[ok] = self.slots["first"][at[ok]], self.slots["docs"][at[ok]]
        return first, docs


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Shard:
    """One written shard, opened: the index in memory, the ids left where they are."""

    def __init__(self, stem: str):
        store, at = _store(stem)
        with store.open_input_file(at + ".idx") as f:
            self.index = Index.load(f.read())
        self.ids = store.open_input_file(at + ".ids")
        self._store, self._at = store, at

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with ``key``: one read of their own bytes."""
        first, docs = (int(x[0]) for x in self.index.find(np.array([key])))
        if not docs:
            return []
        w, bounds = self.index.width, self.index.bounds[first : first + docs + 1].tolist()
        raw = self.ids.read_at(w * (bounds[-1] - bounds[0]), w * bounds[0])
        return [np.frombuffer(raw, f"<u{w}", y - x, w * (x - bounds[0])).astype("<u4") for x, y in zip(bounds, bounds[1:])]

    def keys(self) -> np.ndarray:
        with self._store.open_input_file(self._at + ".keys") as f:
            return np.frombuffer(f.read(), "<i8")

    def documents(self, ordinals: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents, read ``READ_BYTES`` at a time where they follow each other."""
        w, held, low = self.index.width, b"", 0
        last = w * int(self.index.bounds[-1])
        for a, b in zip((w * self.index.bounds[ordinals]).tolist(), (w * self.index.bounds[ordinals + 1]).tolist(), strict=True):
            if a < low or b > low + len(held):
                low, held = a, self.ids.read_at(max(b - a, min(READ_BYTES, last - a)), a)
            yield np.frombuffer(held, f"<u{w}", (b - a) // w, a - low).astype("<u4")

    def close(self) -> None:
        self.ids.close()


DIRECTORY = "shard int, stem string, n_docs long, n_tokens long, first_key long, last_key long"


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode ``docs`` and write shards ascending in ``key`` below ``path``, with their directory."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    # the last two only part rows of one key, however many there are
    order = ["key", "tie", "place"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select("key", "text", F.spark_partition_id().alias("shard"))
    names = [x.split()[0] for x in DIRECTORY.split(", ")]
    folder = f"{path}/shards"
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_tokenizer(tokenizer)
        end = struct.pack("<" + encoder.form, END_ID)
        keys: list[np.ndarray] = []
        sizes: list[int] = []
        n_null = 0
        shard = out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                shard = b.column(2)[0].as_py()
                stem = f"{folder}/{shard:06}-{uuid.uuid4().hex}"
                store, at = _store(stem)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(at + ".ids", compression=None, buffer_size=1 << 20)
            n_null += b.column(0).null_count
            keys.append(b.column(0).fill_null(0).to_numpy())
            texts = b.column(1)
            for raw in encoder.encode_all(t.as_py() for t in texts):
                out.write(raw + end)
                sizes.append(len(raw) // encoder.width + 1)
        if out is None:
            return
        out.close()
        own = np.concatenate(keys)
        index = Index.build(own, n_null, np.array(sizes, dtype=np.int64), encoder.width)
        for kind, raw in ((".idx", index.dump()), (".keys", own.astype("<i8").tobytes())):
            with store.open_output_stream(at + kind, compression=None) as f:
                f.write(raw)
        known = own[n_null:].tolist() or [None]
        row = [shard, stem, len(own), int(index.bounds[-1]), known[0], known[-1]]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    rows.mapInArrow(run, DIRECTORY).write.mode("overwrite").parquet(f"{path}/directory")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard."""
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, read from the files by keyed access through the perfect hash:
    doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(stem)
                index, keys = shard.index, shard.keys()
                known = keys[index.n_null :]
                distinct = known[np.r_[True, known[1:] != known[:-1]]] if len(known) else known
                first, docs = index.find(distinct)
                # each document of a key, then the next key's
                order = np.repeat(first - np.r_[0, np.cumsum(docs)[:-1]], docs) + np.arange(docs.sum()) if len(docs) else first
                order = np.concatenate([np.arange(index.n_null), order]).astype(np.int64)
                ids = np.concatenate([np.zeros(index.n_null, np.int64), np.repeat(distinct, docs)])
                for at in range(0, len(order), 20_000):
                    some = order[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[at : at + 20_000], pa.int64(), mask=np.arange(at, at + len(some)) < index.n_null),
                            pa.array(index.bounds[some] + before),
                            pa.array(index.bounds[some + 1] - index.bounds[some]),
                            pa.array([zlib.crc32(x) for x in shard.documents(some)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                shard.close()

    # a row for each task that wrote: bounded by the number of partitions
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = directory(spark, path).select("stem", "shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").select("stem", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, key: int) -> list[np.ndarray]:
    """The ids of every document with ``key``. The directory prunes to the shards that can hold it: one,
    or those over which the documents of one key are spread."""
    out = []
    for r in directory(spark, path).where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").select("stem").toLocalIterator():
        shard = Shard(r["stem"])
        out += shard.get(key)
        shard.close()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    remove_at_exit(spark, path)
    return read_back(spark, path)
