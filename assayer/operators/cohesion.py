"""Cohesion of owners: related pairs of functions over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import cohesion_owner, reference_leaf, reference_segments, simple_name, ubiquitous_reference


def resolved_targets(functions: DataFrame) -> DataFrame:
    """(owner keys, function_id, target): a reference whose path is the end of one sibling's path only.

    ``functions``: file, owner, function_id, symbol, references. Siblings meet by the last segment.
    """
    refs = functions.select("file", "owner", "function_id", F.explode("references").alias("ref")).where(~F.startswith("ref", F.lit("field::")))
    refs = refs.withColumn("path", reference_segments(F.regexp_replace("ref", "^method::", ""))).where(F.size("path") > 0).withColumn("leaf", F.element_at("path", -1))
    own = functions.select("file", "owner", F.col("function_id").alias("target"), reference_segments("symbol").alias("own")).where(F.size("own") > 0).withColumn("leaf", F.element_at("own", -1))
    met = refs.join(own, ["file", "owner", "leaf"]).where((F.size("own") >= F.size("path")) & (F.slice("own", -F.size("path"), F.size("path")) == F.col("path")))
    # least and greatest are summed before the exchange; distinct targets would all be exchanged
    one = met.groupBy("file", "owner", "function_id", "ref").agg(F.min("target").alias("target"), F.max("target").alias("last")).where("target = last")
    return one.select("file", "owner", "function_id", "target").distinct()


def module_cohesion(functions: DataFrame) -> DataFrame:
    """(file, owner, functions, related, cohesion) of each owner; an owner of one function has 1.

    Two functions are related by a direct reference, a shared target, a shared reference from outside
    (or a shared field), or because their owner implements one contract. Pairs come from what they
    share, not from all pairs of an owner.
    """
    symbol = F.when(F.col("stable_symbol") == "", F.col("name")).otherwise(F.col("stable_symbol"))
    f = functions.where("structural_metrics_reliable").withColumn("symbol", symbol).withColumn("owner", cohesion_owner("symbol", "file"))
    f = f.select("file", "owner", "function_id", "symbol", "references")
    sizes = f.groupBy("file", "owner").agg(F.count("*").alias("functions"))
    targets = resolved_targets(f)
    direct = targets.where("function_id <> target").select("file", "owner", F.least("function_id", "target").alias("l"), F.greatest("function_id", "target").alias("r"))
    leaves = f.select("file", "owner", simple_name("symbol").alias("leaf")).distinct()
    refs = f.select("file", "owner", "function_id", F.explode(F.array_distinct("references")).alias("ref")).withColumn("leaf", reference_leaf("ref"))
    fields = refs.where(F.startswith("ref", F.lit("field::")))
    outside = refs.where(~F.startswith("ref", F.lit("field::")) & ~ubiquitous_reference("ref")).join(leaves, ["file", "owner", "leaf"], "left_anti")
    shared = lambda d, by: d.alias("a").join(d.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("file", "owner", by)] + [F.col("a.function_id") < F.col("b.function_id")]).select("a.file", "a.owner", F.col("a.function_id").alias("l"), F.col("b.function_id").alias("r"))
    pairs = direct.unionByName(shared(targets, "target")).unionByName(shared(fields.select("file", "owner", "function_id", "ref").unionByName(outside.select("file", "owner", "function_id", "ref")), "ref")).distinct()
    related = pairs.groupBy("file", "owner").agg(F.count("*").alias("related"))
    all_pairs = F.col("functions") * (F.col("functions") - 1) / 2
    out = sizes.join(related, ["file", "owner"], "left").withColumn("related", F.when(F.contains("owner", F.lit(" as ")), all_pairs.cast("long")).otherwise(F.coalesce("related", F.lit(0))))
    return out.withColumn("cohesion", F.when(F.col("functions") < 2, 1.0).otherwise(F.col("related") / all_pairs))
