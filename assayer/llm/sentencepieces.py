"""SentencePiece encoding and decoding through a distinct-chunk table (operator 9).

No piece of the model holds a whitespace marker after another character, so merges never cross the
place where a marker follows a non-marker. A text is therefore cut into marked words (a run of
markers and what follows up to the next marker), each distinct marked word is segmented once by the
library, and the ids are joined back by position. ``check_markers`` proves the condition for the
model at hand and refuses other models.

The table of distinct chunks lives in each task (a chunk met in two tasks is segmented twice) so
that no text is moved; it is emptied when it reaches ``TABLE_CHUNKS`` entries, which bounds memory
and changes no result. Decoding uses the library's ``decode(ids)``.

Defined results: a null text is the empty text, with no ids and an empty decoded text; repeated rows
are encoded one by one; input columns named like output columns are replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assayer.llm.common import add_columns, table

MARK = "▁"
TABLE_CHUNKS = 300_000
#: Texts whose chunks are looked up together, and chunks segmented in one call.
GROUP_CHARS = 1_000_000
JOINED_CHARS = 4_000
#: Very long chunks are segmented but not remembered.
LONGEST_REMEMBERED = 200
_CHUNK = re.compile(" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_markers(sp: sentencepiece.SentencePieceProcessor) -> None:
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} has a whitespace marker inside: chunks would not be independent")


class ChunkEncoder:
    """Keeps the table: marked word -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_markers(self.sp)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.only_marks = np.array([not p.strip(MARK) for p in pieces])
        self.table: dict[str, bytes] = {}

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks. Many are segmented in one call, as a text of marked words: a new
        chunk starts where a piece has a marker in front and the piece before does not end in one."""
        out: dict[str, bytes] = {}
        plain = []
        for c in chunks:
            if c.isspace() and not c.strip(" "):  # markers alone would join the next chunk's
                ids = self.sp.encode(c[1:]) if len(c) > 1 else [self.sp.piece_to_id(MARK)]
                out[c] = np.array(ids, dtype="<u4").tobytes()
            else:
                plain.append(c)
        start = 0
        while start < len(plain):
            end, size = start, 0
            while end < len(plain) and (size < JOINED_CHARS or end == start):
                size += len(plain[end])
                end += 1
            ids = np.array(self.sp.encode("".join(plain[start:end])[1:]), dtype="<u4")
            first = self.starts[ids]
            first[1:] &= ~self.only_marks[ids[:-1]]
            at = [*np.flatnonzero(first).tolist(), len(ids)]
            if len(at) != end - start + 1:
                raise AssertionError("chunk boundaries were not found again")
            raw = ids.tobytes()
            for c, i, j in zip(plain[start:end], at[:-1], at[1:], strict=True):
                out[c] = raw[4 * i : 4 * j]
            start = end
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text the ids of ``sp.encode(text)``."""
        group: list[list[str]] = []
        size = 0
        for t in texts:
            # the library puts one marker in front; spaces and literal markers are the same to it
            group.append(_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [])
            size += len(t or "")
            if size > GROUP_CHARS:
                yield from self._join(group)
                group, size = [], 0
        yield from self._join(group)

    def _join(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        fresh = set().union(*group).difference(self.table)
        if len(self.table) + len(fresh) > TABLE_CHUNKS:
            self.table.clear()
            fresh = set().union(*group)
        made = self.segment(sorted(fresh))
        long = {c: made.pop(c) for c in [c for c in made if len(c) > LONGEST_REMEMBERED]}
        self.table.update(made)
        for chunks in group:
            if long:
                yield np.frombuffer(b"".join([long[c] if len(c) > LONGEST_REMEMBERED else self.table[c] for c in chunks]), dtype="<u4")
            else:
                yield np.frombuffer(b"".join(map(self.table.__getitem__, chunks)), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return ChunkEncoder(path)


def release() -> None:
    """Empties the worker's tables."""
    encoder.cache_clear()


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ids (array of int) and decoded (string)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def compute(enc: ChunkEncoder, texts: list) -> list:
        ids = list(enc.encode_all(texts))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), [enc.sp.decode(x.tolist()) if len(x) else "" for x in ids]]

    return add_columns(docs, [text], compute, fields, setup=lambda: encoder(path), keep=keep)


def digest_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256, computed where the ids are made."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def compute(enc: ChunkEncoder, texts: list) -> list:
        n, a, b = [], [], []
        for x in enc.encode_all(texts):
            ids = x.tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256((enc.sp.decode(ids) if ids else "").encode("utf-8", "surrogatepass")).hexdigest())
        return [n, a, b]

    return add_columns(docs, [text], compute, fields, setup=lambda: encoder(path), keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_documents(docs, model_path(), keep=["doc_id"])
