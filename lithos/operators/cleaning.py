"""Cleaning and quality control of raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import is_true, no_sentinel, per_well

CURVES = ("GR", "RESISTIVITY", "RHOB", "NPHI", "DT")
# Units and the range of a curve's median that tells them; the first that fits counts.
UNIT_RANGES = {
    "DT": [("us_per_ft", 20.0, 160.0), ("us_per_m", 100.0, 550.0)],
    "RHOB": [("g_cc", 1.0, 3.2)],
    "GR": [("api", 0.0, 300.0)],
    "NPHI": [("v_v", 0.0, 1.0)],
}
FOOT = 0.3048


def clean(df: DataFrame, null_value: float = -9999.25, curves=CURVES) -> DataFrame:
    """Sentinels become NULL, rows without depth go, row_idx is numbered anew."""
    df = df.select(*[no_sentinel(c, null_value).alias(c) if c in (*curves, "DEPT") else F.col(c) for c in df.columns])
    w = Window.partitionBy("well_id").orderBy("row_idx")
    return df.where(F.col("DEPT").isNotNull()).withColumn("row_idx", (F.row_number().over(w) - 1).cast("long"))


def null_counts(df: DataFrame, null_value: float = -9999.25, curves=CURVES) -> DataFrame:
    """Missing values of each curve in each well."""
    return df.groupBy("well_id").agg(*[F.sum(no_sentinel(c, null_value).isNull().cast("long")).alias(f"n_{c}") for c in curves])


def depth_profile(df: DataFrame) -> DataFrame:
    """First and last depth in file order, and the median step."""
    gap = F.col("DEPT") - F.lag("DEPT").over(per_well().orderBy("row_idx"))
    g = df.withColumn("__gap", gap)
    return g.groupBy("well_id").agg(F.min_by("DEPT", "row_idx").alias("start_depth"), F.max_by("DEPT", "row_idx").alias("stop_depth"), F.percentile("__gap", F.lit(0.5)).alias("step"))


def infer_unit(df: DataFrame, curve: str = "DT", ranges=None) -> DataFrame:
    """The unit of a curve in each well, told by its median; NULL if no range fits."""
    ranges = ranges or UNIT_RANGES[curve]
    m = df.groupBy("well_id").agg(F.percentile(curve, F.lit(0.5)).alias("median"))
    unit = F.coalesce(*[F.when((F.col("median") >= lo) & (F.col("median") <= hi), F.lit(u)) for u, lo, hi in ranges])
    return m.withColumn("unit", unit)


def resolve_units(logs: DataFrame, declared: DataFrame, aliases: dict[str, str], ranges=None) -> DataFrame:
    """A row for each well and curve of UNIT_RANGES: where its unit comes from.

    declared: (well_id, curve, declared). A declared unit that is known (whatever its case and blanks)
    counts; else the curve's median tells it, and low and high say by which range. converted: whether
    normalise_dt() has to change the curve.
    """
    ranges = ranges or UNIT_RANGES
    medians = logs.groupBy("well_id").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ranges])
    long = medians.select("well_id", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).alias("median")) for c in ranges])).alias("m")).select("well_id", "m.*")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    told = F.coalesce(*[F.when((F.col("curve") == c) & (F.col("median") >= lo) & (F.col("median") <= hi), F.struct(F.lit(u).alias("unit"), F.lit(lo).alias("low"), F.lit(hi).alias("high"))) for c, of in ranges.items() for u, lo, hi in of])
    d = long.join(declared.select("well_id", "curve", "declared"), ["well_id", "curve"], "left")
    d = d.withColumn("__own", known[F.lower(F.trim(F.coalesce("declared", F.lit(""))))]).withColumn("__told", F.when(F.col("__own").isNull(), told))
    unit = F.coalesce("__own", "__told.unit")
    return d.select("well_id", "curve", "declared", unit.alias("unit"), F.col("__own").isNull().alias("inferred"), F.col("__told.low").alias("low"), F.col("__told.high").alias("high"), is_true((F.col("curve") == "DT") & (unit == "us_per_m")).alias("converted"))


def normalise_dt(df: DataFrame, units: DataFrame) -> DataFrame:
    """DT in us_per_ft, by the unit of each well (well_id, unit)."""
    u = units.select("well_id", F.col("unit").alias("__unit"))
    return df.join(u, "well_id", "left").withColumn("DT", F.when(F.col("__unit") == "us_per_m", F.col("DT") * FOOT).otherwise(F.col("DT"))).drop("__unit")


def standardise_header(wells: DataFrame) -> DataFrame:
    """x, y, kb, td in metres: feet are told by td / stop between 2.8 and 4.2."""
    r = F.when(F.col("stop") != 0, F.col("td") / F.when(F.col("stop") != 0, F.col("stop")))
    feet = is_true((r >= 2.8) & (r <= 4.2))
    out = wells.withColumn("in_feet", feet)
    for c in ("x", "y", "kb", "td"):
        out = out.withColumn(c, F.when(F.col("in_feet"), F.col(c) * FOOT).otherwise(F.col(c)))
    return out


def washout(df: DataFrame, window: int = 21, most: float = 0.15, z: float = 3.0) -> DataFrame:
    """df with washout: density and neutron porosity far apart, or the sonic far from its rolling median.

    The rolling median and deviation need a full window, so the ends of a log aren't flagged by the
    sonic; the deviation is a tenth of the well's own at least.
    """
    half = window // 2
    w = per_well().orderBy("row_idx")
    frame = w.rowsBetween(-half, half)
    df = df.withColumn("__n", F.count("*").over(per_well())).withColumn("__k", F.row_number().over(w)).withColumn("__all", F.stddev_pop("DT").over(per_well()))
    df = df.withColumn("__med", F.percentile("DT", F.lit(0.5)).over(frame)).withColumn("__dev", F.stddev_pop("DT").over(frame))
    dev = F.greatest(F.col("__dev"), 0.1 * F.col("__all"))
    score = F.when(dev > 0, F.abs(F.col("DT") - F.col("__med")) / F.when(dev > 0, dev)).otherwise(0.0)
    inner = (F.col("__k") > half) & (F.col("__k") <= F.col("__n") - half)
    full = F.col("DT").isNotNull() & F.col("NPHI").isNotNull() & F.col("RHOB").isNotNull()
    phid = (2.65 - F.col("RHOB")) / 1.65
    bad = is_true(F.abs(phid - F.col("NPHI")) > most) | (inner & is_true(score > z))
    return df.withColumn("washout", full & bad).drop("__n", "__k", "__all", "__med", "__dev")


def despike(df: DataFrame, value: str, keys: list[str], k: float = 5.0, floor: float = 0.15) -> DataFrame:
    """Values farther than k times the (floored) median deviation from the median become 0."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__m", F.percentile(value, F.lit(0.5)).over(w)).withColumn("__rms", F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)))
    df = df.withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__mad", F.percentile("__d", F.lit(0.5)).over(w))
    far = F.col("__d") > k * F.greatest(F.col("__mad"), floor * F.col("__rms"))
    return df.withColumn("despiked", F.when(far, 0.0).otherwise(F.col(value))).drop("__m", "__rms", "__d", "__mad")
