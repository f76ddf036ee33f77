"""Quality of a survey's headers and footprint: which coordinate fields are filled, where live traces lie, what kind of mute the zeros are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Percentage points of zeros within which a profile is constant, and that it has to fall by to be a mute that clears.
CONSTANT, CLEARS = 5.0, 20.0

FIELDS = ("cdp_x", "cdp_y", "source_x", "source_y")


def coordinate_fields(traces: DataFrame) -> DataFrame:
    """(dataset_id, n, n_<field> of those that aren't zero, has_coordinates); a missing value counts as zero."""
    filled = [F.sum(F.coalesce((F.col(c) != 0).cast("long"), F.lit(0))).cast("long").alias(f"n_{c}") for c in FIELDS]
    d = traces.groupBy("dataset_id").agg(F.count("*").alias("n"), *filled)
    return d.withColumn("has_coordinates", F.greatest(*[F.col(f"n_{c}") for c in FIELDS]) > 0)


def footprint_report(traces: DataFrame) -> DataFrame:
    """Of each dataset: traces, dead ones (all zero or without samples), and the ranges of lines of all traces and of live ones (NULL if none lives)."""
    live = ~F.coalesce(F.forall("samples", lambda x: x == 0), F.lit(True))
    ends = [f(F.when(live, F.col(c)) if alive else F.col(c)).alias(f"{'live_' if alive else ''}{c}_{k}") for alive in (False, True) for c in ("inline", "crossline") for k, f in (("min", F.min), ("max", F.max))]
    return traces.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum((~live).cast("long")).alias("n_dead"), *ends)


def mute_verdict(profile: DataFrame) -> DataFrame:
    """Of each zero profile (seismic.zero_profile): percentages of zeros first, last, least and most, the sample of the least, and what they tell.

    constant: a fixed outline of the survey; clears: a mute that ends with depth; mixed: neither.
    """
    percent = (F.col("zero_fraction") * 100.0).alias("p")
    d = profile.select("dataset_id", "sample_idx", percent).groupBy("dataset_id").agg(
        F.min_by("p", "sample_idx").alias("first"), F.max_by("p", "sample_idx").alias("last"), F.min("p").alias("least"), F.max("p").alias("most"), F.min(F.struct("p", "sample_idx"))["sample_idx"].alias("clearest"),
    )
    verdict = F.when(F.col("most") - F.col("least") < CONSTANT, "constant").when(F.col("last") < F.col("first") - CLEARS, "clears").otherwise("mixed")
    return d.withColumn("verdict", verdict)
