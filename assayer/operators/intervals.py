"""Interval joins by dyadic cells.

A span of whole numbers is the union of at most 2 log n aligned power-of-two cells, and a point lies in
one cell of each size. Span and point meet by equality of (key, level, cell), so a file of very many
points and spans makes as many rows as points and spans have cells, and no product. Questions that only
ask for the least or greatest value around a point are answered by one value a cell: those never make a
row for a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = "array<struct<level:int,cell:long>>"


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def span_level(start: Column, end: Column) -> Column:
    """The largest level that a cell of the span can have; null where the span is empty."""
    return F.when(end >= start, F.length(F.bin(end.cast("long") - start.cast("long") + 1)) - 1)


def span_cells(start: Column, end: Column) -> Column:
    """The cells of [start, end], both inside: at each level at most the first and the last one, where
    they are no part of a larger cell. Empty where the span is."""
    low, high = start.cast("long"), end.cast("long") + 1

    def at(level: Column) -> Column:
        first = _right(low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        last = _right(high, level)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        one = lambda ok, cell: F.when((first < last) & ok, F.struct(level.alias("level"), cell.alias("cell")))
        return F.filter(F.array(one(odd(first), first), one(odd(last), last - 1)), lambda x: x.isNotNull())

    cells = F.flatten(F.transform(F.sequence(F.lit(0), span_level(start, end)), at))
    return F.coalesce(cells, F.array().cast(_CELL))


def point_cells(point: Column, top: Column) -> Column:
    """The cell of the point at each level up to ``top``."""
    made = F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(level.alias("level"), _right(point.cast("long"), level).alias("cell")))
    return F.coalesce(F.when(point.isNotNull(), made), F.array().cast(_CELL))


def with_span_cells(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Each span once for each of its cells, with level and cell."""
    return spans.select("*", F.inline(span_cells(F.col(start), F.col(end))))


def top_level(spans: DataFrame, start: str, end: str) -> DataFrame:
    """(top): the largest level that a cell of the spans can have."""
    return spans.agg(F.max(span_level(F.col(start), F.col(end))).alias("top"))


def with_point_cells(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, top: Column | None = None) -> DataFrame:
    """Each point once for each level that ``spans`` can have, with level and cell."""
    top = top_level(spans, start, end).scalar() if top is None else top
    return points.withColumn("top", top).select("*", F.inline(point_cells(F.col(point), F.col("top")))).drop("top")


def stab(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, on: Sequence[str]) -> DataFrame:
    """Each point with each span of equal ``on`` columns that contains it; other names must differ."""
    keys = [*on, "level", "cell"]
    return with_point_cells(points, point, spans, start, end).join(with_span_cells(spans, start, end), keys).drop("level", "cell")


def intersecting(left: DataFrame, right: DataFrame, start: tuple[str, str], end: tuple[str, str], on: Sequence[str]) -> DataFrame:
    """Pairs of spans with a number in common: the start of one lies in the other, and equal starts are
    found once. Names other than ``on`` must differ."""
    inside = stab(left, start[0], right, start[1], end[1], on)
    around = stab(right, start[1], left, start[0], end[0], on).where(F.col(start[1]) > F.col(start[0]))
    return inside.where(F.col(end[0]) >= F.col(start[0])).unionByName(around.where(F.col(end[1]) >= F.col(start[1])).select(inside.columns))


def intersecting_itself(spans: DataFrame, start: str, end: str, on: Sequence[str]) -> DataFrame:
    """(on, a, b): as ``intersecting`` of a table with itself, each row with itself included, other columns as
    structs. A pair with two starts is found once, by the later of them, and turned: half of the joins."""
    row = F.struct(*(c for c in spans.columns if c not in on))
    spans = spans.where(F.col(end) >= F.col(start))
    met = stab(spans.select(*on, row.alias("a"), F.col(start).alias("_at")), "_at", spans.select(*on, row.alias("b"), F.col(start).alias("_low"), F.col(end).alias("_high")), "_low", "_high", on)
    pair = F.struct("a", "b")
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return met.select(*on, F.inline(F.when(F.col("_at") > F.col("_low"), F.array(pair, turned)).otherwise(F.array(pair))))


def greatest_around(spans: DataFrame, start: str, end: str, on: Sequence[str], value: str, points: DataFrame, point: str) -> DataFrame:
    """The points that lie in a span, once, with the greatest ``value`` of the spans around: one value a
    cell. ``points`` has ``on`` and ``point`` and nothing else."""
    keys = [*on, "level", "cell"]
    cells = with_span_cells(spans, start, end).groupBy(*keys).agg(F.max(value).alias(value))
    met = with_point_cells(points.distinct(), point, spans, start, end).join(cells, keys)
    return met.groupBy(*on, point).agg(F.max(value).alias(value))


def greatest_stretches(spans: DataFrame, on: Sequence[str], start: str = "start_line", end: str = "end_line", value: str = "hits") -> DataFrame:
    """(on, start, end, value): the stretches between starts and ends of spans, with the greatest value of
    the spans that are open there. At most two rows a span, however long spans are; stretches are disjoint."""
    from pyspark.sql import Window

    whole = spans.where(F.col(end) >= F.col(start))
    turns = whole.select(*on, F.explode(F.array(F.col(start).cast("long"), F.col(end).cast("long") + 1)).alias(start)).distinct()
    following = F.lead(start).over(Window.partitionBy(*on).orderBy(start)) - 1
    stretches = turns.withColumn(end, following)
    open_ = greatest_around(whole.select(*on, F.col(start).alias("_low"), F.col(end).alias("_high"), value), "_low", "_high", on, value, turns, start)
    return stretches.join(open_, [*on, start]).where(F.col(end).isNotNull())
