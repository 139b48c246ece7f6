"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


PIECE_BYTES = 4_000_000


#: Tables of whole texts, whose rows are worth dealing out.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts are dealt to all cores where the files have fewer splits than there are cores, as
    one small file would else keep one core busy. Tables of many files are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one process (tests, notebooks) one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="assayer-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/assayer/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does, survives lost executors and can be read
    several times with column pruning. The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables at once; nothing that is still to run may read them."""
    for df in tables:
        _remove_quietly(df.sparkSession, df._scratch_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of what no plan holds any more: Spark removes exchanged files when the driver collects its
    garbage, which may else be long after the step that needed them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_owner = ""


def take_worker(owner: str) -> None:
    """A reused Python worker goes to another operator: the tables of those before are emptied, and
    memory that is free goes back to the system."""
    global _owner
    if owner != _owner:
        _owner = owner
        for name, module in list(sys.modules.items()):
            if name.startswith("assayer.llm.") and name != owner and hasattr(module, "release"):
                module.release()
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove_quietly, spark, path)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone when the driver ends
            pass


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of ``df`` other than ``names``, compared as Spark does, without case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def scratch_name(df: DataFrame, tag: str) -> str:
    """A column name for a helper column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{tag}"
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df: DataFrame, helpers: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns that are named like an operator's helper columns under other names, and what
    gives them their own names again."""
    taken = {h.lower() for h in helpers}
    other = {}
    for c in df.columns:
        if c.lower() in taken:
            name = f"_kept_{len(other)}"
            while name.lower() in {x.lower() for x in (*df.columns, *helpers)}:
                name += "_"
            other[c] = name
    if not other:
        return df, lambda out: out
    return df.withColumnsRenamed(other), lambda out: out.withColumnsRenamed({v: k for k, v in other.items()})


def pieces(batches: Iterator[pa.RecordBatch], octets: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``octets`` each, so that what is made of one in Python stays small."""
    for b in batches:
        n = max(1, min(b.num_rows, -(-b.nbytes // octets)))
        step = max(1, -(-b.num_rows // n))
        for at in range(0, b.num_rows, step) or (0,):
            yield b.slice(at, step)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    compute: Callable[..., list],
    fields: Sequence[T.StructField],
    setup: Callable[[], object] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append computed columns by Arrow batches; columns of the same name are replaced.

    Spark closes a batch at 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``), so long texts do
    not pile up.

    ``compute(state, *columns as Python lists)`` returns one sequence for each field. ``setup`` runs
    once for each task.
    """
    kept = without(df, [f.name for f in fields]) if keep is None else list(keep)
    carried = list(dict.fromkeys([*kept, *inputs]))
    src = df.select(*[f"`{c}`" for c in carried])
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(compute.__module__)
        state = setup() if setup else None
        for b in pieces(batches):
            made = compute(state, *(b.column(carried.index(c)).to_pylist() for c in inputs))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(carried.index(c)) for c in kept), *arrays], names=names)
        give_back()

    return src.mapInArrow(run, schema)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
