"""Joins of intervals within a key, in work linear in both sides and the pairs found.

The right side's intervals are numbered by their start, ``PER_CELL`` to a cell, so cells are narrow where intervals are
dense. Every interval of both sides is sent to the cells that it touches (found by one sort of starts and ends within
the key, no join), pairs are made within cells, and a pair that meets in several cells counts in the first of them. An
interval over many cells is copied to each: pairs of it lie in all of them anyway if the other side is dense there.

A key's intervals are sorted in one task: a key is a document or a day of a station.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_CELL = 64


def _with_cells(rows: DataFrame, key: str, start: str, end: str, bounds: DataFrame, name: str) -> DataFrame:
    """key, row (the struct of all columns), and first, last: the cells that hold start and end. A place before the first
    cell is in it."""
    own = rows.select(key, F.struct(*rows.columns).alias(name), F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"))
    numbered = own.withColumn("n", F.monotonically_increasing_id())
    marks = bounds.select(key, "at", "cell", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(own.schema[name].dataType).alias(name), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    asked = numbered.select(key, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("b").alias("at"), F.lit(2).alias("kind")))).alias("q"), "n", name, "a", "b")
    # the row itself travels with its start only
    both = marks.unionByName(asked.select(key, "q.at", F.lit(None).cast("long").alias("cell"), "q.kind", "n", F.when(F.col("q.kind") == 1, F.col(name)).alias(name), "a", "b"))
    in_order = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("cell", F.coalesce(F.last("cell", ignorenulls=True).over(in_order), F.lit(0))).filter("kind > 0")
    return seen.groupBy(key, "n").agg(F.first(name, ignorenulls=True).alias(name), F.max("a").alias("a"), F.max("b").alias("b"), F.min(F.when(F.col("kind") == 1, F.col("cell"))).alias("first"), F.max(F.when(F.col("kind") == 2, F.col("cell"))).alias("last"))


def overlapping(left: DataFrame, right: DataFrame, key: str, starts: tuple[str, str], ends: tuple[str, str], closed: bool = False) -> DataFrame:
    """key, l, r: every two rows (as structs) of one key whose intervals overlap; ends count as inside if ``closed``. Rows
    with a null key or bound, or that end before they start, overlap nothing."""
    sides = []
    for rows, start, end in zip((left, right), starts, ends, strict=True):
        sides.append(rows.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end))))
    place = F.row_number().over(Window.partitionBy(key).orderBy(starts[1])) - 1
    cells = sides[1].select(key, F.col(starts[1]).cast("double").alias("at"), place.alias("place"))
    bounds = cells.filter(F.col("place") % PER_CELL == 0).select(key, "at", (F.col("place") / PER_CELL).cast("long").alias("cell"))
    x = _with_cells(sides[0], key, starts[0], ends[0], bounds, "l")
    y = _with_cells(sides[1], key, starts[1], ends[1], bounds, "r")
    x = x.select(key, "l", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("first").alias("l_first"), F.explode(F.sequence("first", "last")).alias("cell"))
    y = y.select(key, "r", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("first").alias("r_first"), F.explode(F.sequence("first", "last")).alias("cell"))
    meet = (F.col("la") <= F.col("rb")) & (F.col("ra") <= F.col("lb")) if closed else (F.col("la") < F.col("rb")) & (F.col("ra") < F.col("lb"))
    return x.join(y, [key, "cell"]).filter(meet & (F.col("cell") == F.greatest("l_first", "r_first"))).select(key, "l", "r")


def holding(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """points with ``value`` of the interval that holds each (its end is outside), null if none does. A key's intervals
    don't overlap, so the last one to start is the only one to ask: one sort of both, no join."""
    (held, upto, asked, order) = ("_held", "_upto", "_asked", "_order")
    p = points.select(*points.columns, F.lit(True).alias(asked), F.col(at).cast("double").alias(order), F.lit(None).cast(intervals.schema[value].dataType).alias(held), F.lit(None).cast("double").alias(upto))
    i = intervals.filter(F.col(start) < F.col(end)).select(key, F.lit(False).alias(asked), F.col(start).cast("double").alias(order), F.col(value).alias(held), F.col(end).cast("double").alias(upto))
    both = p.unionByName(i, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(order, asked).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col(asked), F.struct(held, upto)), ignorenulls=True).over(before)
    found = both.withColumn("_last", last).filter(asked)
    return found.select(*points.columns, F.when(F.col(order) < F.col(f"_last.{upto}"), F.col(f"_last.{held}")).alias(value))
