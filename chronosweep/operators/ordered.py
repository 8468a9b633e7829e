"""Rows in order of time without a task for each pair: places within a pair, cells of bounded size, carried values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Seconds of rows that are counted together.
STRETCH = 30 * 86_400
#: Places to a cell.
CELL = 20_000


def numbered(rows: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """rows with their place in their pair, from 1, unless they have it.  Places are counted by stretch of time; only the stretches' sums meet in one task."""
    if name in rows.columns:
        return rows
    held = rows.withColumn("_stretch", F.floor(F.col("s") / STRETCH))
    counts = held.groupBy("pair", "_stretch").agg(F.count("*").alias("_n"))
    before = counts.select("pair", "_stretch", (F.sum("_n").over(Window.partitionBy("pair").orderBy("_stretch")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("pair", "_stretch").orderBy("s", *order))
    return held.withColumn(name, place).join(before, ["pair", "_stretch"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_stretch", "_before")


def in_order(rows: DataFrame, context: int, make: Callable[[DataFrame, WindowSpec], DataFrame], *order: str) -> DataFrame:
    """make(rows, window) over each pair's rows in order, for windows that look back `context` rows at most.

    Cells of CELL places get the `context` rows before them too, so one pair is as many tasks as it has cells.  Rows that have
    their place `rn` already keep it and aren't counted again.
    """
    extra = [] if "rn" in rows.columns else ["rn"]
    size = max(CELL, 2 * context)
    at = F.col("rn") - 1
    own = F.floor(at / size)
    cells = F.when(at % size >= size - context, F.array(own, own + 1)).otherwise(F.array(own)) if context else F.array(own)
    dealt = numbered(rows, *order).withColumn("_own", own).withColumn("_cell", F.explode(cells))
    made = make(dealt, Window.partitionBy("pair", "_cell").orderBy("rn"))
    return made.where(F.col("_own") == F.col("_cell")).drop("_own", "_cell", *extra)


def carried(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """rows with the last known value at or before each row: within stretches of time, which start from the last value of those before them."""
    held = rows.withColumn("_v", value).withColumn("_stretch", F.floor(F.col("s") / STRETCH))
    known = F.col("_v").isNotNull()
    ends = held.groupBy("pair", "_stretch").agg(F.max_by(F.when(known, F.col("_v")), F.when(known, F.struct("s", *order, "_v"))).alias("_end"))
    earlier = Window.partitionBy("pair").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("pair", "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    within = Window.partitionBy("pair", "_stretch").orderBy("s", *order, "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumn(name, F.last("_v", ignorenulls=True).over(within)).join(starts, ["pair", "_stretch"])
    return out.withColumn(name, F.coalesce(name, "_start")).drop("_v", "_stretch", "_start")


def around(left: DataFrame, right: DataFrame, keys: list[str], span: int) -> DataFrame:
    """keys, s, before, after: for each key and time of left (keys, s) the times of right (keys, s, id) next to it, as (s, least id).

    Rows of one key and time are one, so the work grows with the distinct times and not with the pairs in reach.  Times meet in
    cells of `span` seconds; nothing further away is told.
    """
    both = left.select(*keys, "s", F.lit(True).alias("_left"), F.lit(False).alias("_right"), F.lit(None).cast(right.schema["id"].dataType).alias("id"))
    both = both.unionByName(right.select(*keys, "s", F.lit(False).alias("_left"), F.lit(True).alias("_right"), "id")).dropna(subset=[*keys, "s"])
    times = both.groupBy(*keys, "s").agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"), F.min("id").alias("id"))
    own = F.floor(F.col("s") / span)
    dealt = times.withColumn("_own", own).withColumn("_cell", F.explode(F.when(F.col("_right"), F.array(own - 1, own, own + 1)).otherwise(F.array(own))))
    known, cell = F.when(F.col("_right"), F.struct("s", "id")), Window.partitionBy(*keys, "_cell")
    upto = lambda order: F.last(known, ignorenulls=True).over(cell.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    near = lambda c: F.when(F.abs(F.col(c)["s"] - F.col("s")) <= span, F.col(c)).alias(c)
    told = dealt.withColumns({"before": upto(F.col("s")), "after": upto(F.col("s").desc())}).where(F.col("_left") & (F.col("_own") == F.col("_cell")))
    return told.select(*keys, "s", near("before"), near("after"))
