"""Interpolation joins: the value of a curve at given places, by one sort of both sides together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import lerp


def interpolate(asks: DataFrame, knots: DataFrame, keys: list[str], ends: str = "null", parts: int | None = None) -> DataFrame:
    """asks (keys, ask_id, x) with value: the line through the knots (keys, x, y) on either side.

    ends: "null" outside the knots, "clamp" to the first or last one, "zero". Knots without x or y
    are left out. Asks and knots are put in one order of each key: a shuffle and a sort, no pairs.
    parts: into how many tasks the keys are dealt (None: what adaptive execution makes of the compressed bytes).
    """
    k = knots.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x").agg(F.min("y").alias("y"))
    null = F.lit(None)
    both = k.select(*keys, "x", "y", null.cast(asks.schema["ask_id"].dataType).alias("ask_id"), F.lit(0).alias("ask")).unionByName(asks.select(*keys, "x", null.cast("double").alias("y"), "ask_id", F.lit(1).alias("ask")))
    if parts:
        both = both.repartition(parts, *keys)
    knot = F.when(F.col("ask") == 0, F.struct("x", "y"))
    part = Window.partitionBy(*keys)
    before = F.last(knot, ignorenulls=True).over(part.orderBy("x", "ask").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(knot, ignorenulls=True).over(part.orderBy(F.desc("x"), "ask").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__a", before).withColumn("__b", after).where("ask = 1")
    outside = {"null": null.cast("double"), "zero": F.lit(0.0), "clamp": F.coalesce("__a.y", "__b.y")}[ends]
    inside = F.col("x").isNotNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    value = F.when(inside, lerp(F.col("x"), F.col("__a.x"), F.col("__a.y"), F.col("__b.x"), F.col("__b.y"))).when(F.col("x").isNotNull(), outside)
    return both.select(*keys, "ask_id", "x", value.alias("value"))


def stretch(times: DataFrame, points: DataFrame) -> DataFrame:
    """times (well_id, ask_id, x = depth, twt) moved by the shift interpolated, and clamped, between tie points (well_id, x, y); no points, no move."""
    shift = interpolate(times.select("well_id", "ask_id", "x"), points, ["well_id"], "clamp").select("well_id", "ask_id", "value")
    return times.join(shift, ["well_id", "ask_id"], "left").withColumn("twt", F.col("twt") + F.coalesce("value", F.lit(0.0))).drop("value")


def checkshot_shift(shots: DataFrame, logs: DataFrame) -> DataFrame:
    """(well_id, shift_ms): the first station at or below a log's top less the log's own time there.

    shots: well_id, depth, twt; logs: well_id, row_idx, DEPT, DPTM.
    """
    top = logs.where("DEPT IS NOT NULL").groupBy("well_id").agg(F.min("DEPT").alias("top"))
    first = shots.join(top, "well_id").where("depth >= top").groupBy("well_id").agg(F.min(F.struct("depth", "twt")).alias("s"))
    asks = first.select("well_id", F.lit(0).cast("long").alias("ask_id"), F.col("s.depth").alias("x"))
    at = interpolate(asks, logs.select("well_id", F.col("DEPT").alias("x"), F.col("DPTM").alias("y")), ["well_id"])
    return first.join(at.select("well_id", "value"), "well_id").select("well_id", (F.col("s.twt") - F.col("value")).alias("shift_ms"))
