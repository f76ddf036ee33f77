"""Summaries and reports over interpreted wells (the columns of petrophysics.interpretation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators.petrophysics import ZONES


def well_summary(df: DataFrame) -> DataFrame:
    """footage, means and net pay of each well."""
    first, last = F.min_by("DEPT", "row_idx"), F.max_by("DEPT", "row_idx")
    return df.groupBy("well_id").agg(
        (last - first).alias("footage"),
        F.avg("VSH").alias("mean_vsh"), F.avg("PHIE").alias("mean_phie"), F.avg("SWE").alias("mean_swe"),
        (F.sum(F.when(F.col("ZONES") == 1, 1).otherwise(0)) * F.max("__step")).alias("net_pay"),
    )


def zone_summary(df: DataFrame) -> DataFrame:
    """Three rows for each well: samples, thickness and means of every zone, empty ones too."""
    by = df.groupBy("well_id", "ZONES").agg(F.count("*").alias("n"), F.avg("VSH").alias("mean_vsh"), F.avg("PHIE").alias("mean_phie"), F.avg("SWE").alias("mean_swe"))
    steps = df.groupBy("well_id").agg(F.max("__step").alias("step"))
    every = steps.select("well_id", "step", F.explode(F.array(*[F.struct(F.lit(k).alias("zone"), F.lit(v).alias("label")) for k, v in ZONES.items()])).alias("z")).select("well_id", "step", "z.*")
    out = every.join(by.withColumnRenamed("ZONES", "zone"), ["well_id", "zone"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("well_id", "zone", "label", n.alias("n_samples"), (n * F.col("step")).alias("thickness"), "mean_vsh", "mean_phie", "mean_swe")


def field_summary(df: DataFrame) -> DataFrame:
    """Wells, total footage and pay, and the means of the wells' means."""
    s = well_summary(df)
    return s.agg(F.count("*").alias("n_wells"), F.sum("footage").alias("total_footage"), F.sum("net_pay").alias("total_net_pay"), F.avg("mean_vsh").alias("mean_vsh"), F.avg("mean_phie").alias("mean_phie"), F.avg("mean_swe").alias("mean_swe"))


def crossplot(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Two curves (and one for colour) by depth; unknown curves are an error that lists those there are."""
    for c in (x, y, color):
        if c is not None and c not in df.columns:
            raise ValueError(f"no curve {c}; there are {', '.join(df.columns)}")
    return df.select("well_id", "row_idx", "DEPT", F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(color).alias("color")] if color else []))


def depth_range(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with low <= DEPT <= high; either end may be open."""
    if low is not None:
        df = df.where(F.col("DEPT") >= low)
    return df if high is None else df.where(F.col("DEPT") <= high)


def curve_statistics(df: DataFrame, curve: str, low: float | None = None, high: float | None = None) -> DataFrame:
    there = depth_range(df, low, high).where(F.col(curve).isNotNull())
    return there.groupBy("well_id").agg(F.count("*").alias("n"), F.avg(curve).alias("mean"), F.min(curve).alias("low"), F.max(curve).alias("high"))


def curve_head(df: DataFrame, curve: str, n: int = 50) -> DataFrame:
    """The first n values of a curve in each well: a report of that length."""
    from pyspark.sql import Window

    there = df.where(F.col(curve).isNotNull())
    k = F.row_number().over(Window.partitionBy("well_id").orderBy("row_idx"))
    return there.withColumn("k", k).where(F.col("k") <= n).select("well_id", "k", "DEPT", F.col(curve).alias("value"))


def compare(df: DataFrame, wells: DataFrame | list[str], metric: str) -> DataFrame:
    """One metric of the summary for the wells asked for (a list, or a table with well_id); NULL for a well that isn't there."""
    asked = wells.select("well_id") if isinstance(wells, DataFrame) else df.sparkSession.createDataFrame([(w,) for w in wells], "well_id string")
    return asked.join(well_summary(df).select("well_id", F.col(metric).alias("value")), "well_id", "left")


def net_pay_ranking(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    s = well_summary(df).select("well_id", F.coalesce("net_pay", F.lit(0.0)).alias("net_pay"))
    # one row a well: the window over all of them is as long as the list of wells
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("net_pay"), "well_id")))


def intervals(df: DataFrame, flag: str) -> DataFrame:
    """Runs of rows where the flag is true: first and last depth and the number of rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("well_id").orderBy("row_idx")
    on = df.withColumn("__k", F.row_number().over(w)).where(F.col(flag))
    run = on.withColumn("__run", F.col("__k") - F.row_number().over(w))
    return run.groupBy("well_id", "__run").agg(F.min("DEPT").alias("top"), F.max("DEPT").alias("bottom"), F.count("*").alias("n")).drop("__run")
