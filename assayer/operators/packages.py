"""The package graph: coupling, layers, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import instability, manifest_file, matches_pattern
from assayer.operators.graph import forget, settle


def production_edges(dependencies: DataFrame) -> DataFrame:
    return dependencies.where((F.col("scope") == "production") & ~F.col("target_gated"))


def internal_edges(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct (package, dependency) between known packages."""
    known = packages.select("name").distinct()
    edges = production_edges(dependencies).where("internal").select("package", "dependency").distinct()
    return edges.join(known, edges.package == known.name, "left_semi").join(known, edges.dependency == known.name, "left_semi")


def afferent(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, afferent): packages with a direct internal production edge to it."""
    n = internal_edges(packages, dependencies).groupBy(F.col("dependency").alias("name")).agg(F.count_distinct("package").alias("n"))
    return packages.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("afferent"))


def efferent(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, efferent): distinct production dependencies, internal or not."""
    n = production_edges(dependencies).groupBy(F.col("package").alias("name")).agg(F.count_distinct("dependency").alias("n"))
    return packages.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("efferent"))


def coupling(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    both = afferent(packages, dependencies).join(efferent(packages, dependencies), "name")
    return packages.join(both, "name").withColumn("instability", instability("afferent", "efferent"))


def manifests(packages: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``names`` with the manifest of its package; the root manifest for unknown ones."""
    m = packages.select(F.col("name").alias(column), manifest_file("root").alias("file")).dropDuplicates([column])
    return names.join(m, column, "left").withColumn("file", F.coalesce("file", F.lit("Cargo.toml")))


def layer_of(names: DataFrame, layers: DataFrame, column: str = "name") -> DataFrame:
    """(column, layer): the layer of the only pattern that matches; two matches are an error."""
    hit = names.select(column).distinct().join(F.broadcast(layers), matches_pattern("pattern", column))  # configuration: a few rows
    n = hit.groupBy(column).agg(F.count("*").alias("n"), F.max("layer").alias("layer"))
    return n.withColumn("layer", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several layer patterns match "), F.col(column)))).otherwise(F.col("layer"))).drop("n")


def edge_directions(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges whose ends both have a layer: passed where the source's is not the lower one."""
    a = layer_of(edges, layers, "package").withColumnRenamed("layer", "source_layer")
    b = layer_of(edges, layers, "dependency").withColumnRenamed("layer", "target_layer")
    return edges.join(a, "package").join(b, "dependency").withColumn("passed", F.col("source_layer") >= F.col("target_layer"))


def forbidden_edges(edges: DataFrame, patterns: list[str]) -> DataFrame:
    """Edges with passed: no ``source->target`` predicate matches."""
    hit = F.lit(False)
    for p in patterns:
        source, _, target = p.partition("->")
        if not source or not target or source.count("*") > 1 or target.count("*") > 1:
            raise ValueError(f"invalid dependency edge pattern {p!r}")
        hit = hit | (matches_pattern(F.lit(source), "package") & matches_pattern(F.lit(target), "dependency"))
    return edges.withColumn("passed", ~hit)


def separated(edges: DataFrame, sources: list[str], targets: list[str]) -> DataFrame:
    """Edges with passed: none leads from a source pattern to a target pattern."""
    hit = F.lit(False)
    for s in sources:
        for t in targets:
            hit = hit | (matches_pattern(F.lit(s), "package") & matches_pattern(F.lit(t), "dependency"))
    return edges.withColumn("passed", ~hit)


def _cyclic(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an edge in or out have gone, again and again: what no cycle needs."""
    left = settle(edges)
    n = left.count()
    while n:
        ends = left.select(F.col("a").alias("n")).distinct().join(left.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
        left = settle(left.join(ends.select(F.col("n").alias("a")), "a", "left_semi").join(ends.select(F.col("n").alias("b")), "b", "left_semi"))
        m = left.count()
        if m == n:
            break
        n = m
    return left


def _rings(edges: DataFrame) -> DataFrame:
    """(root, node) of the cycles, where each node has one edge out at most: root is the least of the cycle.

    Nodes leap 1, 2, 4 ... steps on, with the least node on the way. Only nodes at which a leap ends can be on a
    cycle, and if a leap of twice the length ends at all of them, all of them are. So a tail or a cycle of n
    nodes takes about log2 n steps, not n.
    """
    leaps = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("far"), F.least("a", "b").alias("least")))
    ends = leaps.select(F.col("far").alias("node")).distinct().count()
    while True:
        on = leaps.select(F.col("node").alias("far"), F.col("far").alias("further"), F.col("least").alias("other"))
        # a way that ends is no part of a cycle
        longer = settle(leaps.join(on, "far").select("node", F.col("further").alias("far"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("fell")))
        forget(leaps)
        leaps = longer.select("node", "far", "least")
        leaps._settled_at = longer._settled_at
        reached = leaps.select(F.col("far").alias("node")).distinct()
        n = reached.count()
        if n == ends and longer.join(reached, "node", "left_semi").where("fell").isEmpty():
            return leaps.join(reached, "node", "left_semi").select(F.col("least").alias("root"), "node")
        ends = n


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches it, itself included. Labels only fall, so it ends."""
    labels = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = edges.join(labels, edges.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("sent"))
        stepped = settle(labels.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), F.col("colour").alias("old")))
        if stepped.where("colour <> old").isEmpty():
            return stepped.select("node", "colour")
        labels = stepped.select("node", "colour")


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle: sorted members) of each strongly connected component with a cycle; a self-edge is one.

    Colours instead of a closure: each node takes the least node that reaches it; the nodes of one
    colour from which that node can be reached are its component. They go, and the rest, cut at the
    colours, is done again. Tables stay as large as the edges.
    """
    all_edges = settle(edges.select("a", "b").distinct())
    alone = all_edges.where("a = b").select(F.col("a").alias("root"), F.col("a").alias("node"))
    proper = all_edges.where("a <> b")
    several = proper.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():  # one way from each node
        left, parts = proper.limit(0), [alone, _rings(proper)]
    else:
        left, parts = _cyclic(proper), [alone]
    while not left.isEmpty():
        colours = _colours(left)
        own = left.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").where("colour = other").select("a", "b", "colour")
        own = settle(own)
        found = settle(colours.where("node = colour").select("node", "colour"))
        front = found
        while not front.isEmpty():
            back = own.join(front.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            front = settle(back.join(found, "node", "left_anti"))
            found = settle(found.unionByName(front))
        parts.append(found.select(F.col("colour").alias("root"), "node"))
        rest = own.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti")
        left = _cyclic(rest.select("a", "b"))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    n = members.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("cycle"))
    looped = n.where(F.size("cycle") > 1)
    in_larger = looped.select(F.explode("cycle").alias("root")).distinct()
    return looped.select("cycle").unionByName(n.where(F.size("cycle") == 1).join(alone.select("root").distinct(), "root", "left_semi").join(in_larger, "root", "left_anti").select("cycle"))
