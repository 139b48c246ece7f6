"""Components of an undirected edge table."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the folder that driver and executors share, named by
    ``spark.checkpoint.dir``, and read it back: this cuts the lineage, survives lost executors and
    keeps column pruning. The table goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(_own_folder(sc.master))
        folder = sc._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/assayer/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def settle_lines(lines: DataFrame, tag: str = "lines") -> str:
    """The path of text files in the shared folder with one line for each row of ``lines`` (one string)."""
    path = shared_path(lines.sparkSession, tag)
    lines.write.text(path)
    return path


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order: a range exchange, numbers within each range,
    and the count of the ranges before it (one row a range)."""
    taken = {c.lower() for c in df.columns}
    part, at = (next(c for c in (f"_{x}{i or ''}" for i in range(len(taken) + 1)) if c not in taken) for x in ("range", "at"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a second evaluation could sample other boundaries
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id() % (1 << 33)}))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n")).select(F.col(part).alias("ranged"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = ranged.join(F.broadcast(sizes), ranged[part] == sizes["ranged"])
    return met.select(*[ranged[f"`{c}`"] for c in df.columns if c.lower() != name.lower()], (sizes["before"] + ranged[at] + 1).alias(name))


def forget(*tables: DataFrame) -> None:
    """Remove settled tables at once; nothing that is still to run may read them."""
    for df in tables:
        _remove(df.sparkSession, df._settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone when the driver ends
            pass


def _own_folder(master: str) -> str:
    """A folder of this machine, where driver and executors are one process; elsewhere it must be named."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="assayer-")


def min_labels(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the least node reachable over (a, b). Each round takes the least label among the
    neighbours and then the label of that label, so rounds grow with the logarithm of a chain."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        before, labels = labels, settle(stepped.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old"))
        forget(before)
        if labels.where("label <> old").isEmpty():
            forget(both)
            return labels.select("node", "label")
    # the least label moves at least one edge in a round and then twice as far as before, so a chain of
    # any length that a table can hold ends in fewer rounds
    raise RuntimeError("labels did not settle")
