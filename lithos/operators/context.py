"""What a tie makes possible: logs on the time axis of a trace, sections with logs, correlation of spectra and properties, samples for models.

Ties: well_id, trace_idx, shift_ms, correlation, boundary_pinned. A well's own time is the trace's
less the tie's shift. Everything is an interpolation join by well, so no well's logs are in a task of
more than its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.columns import is_true, pearson
from lithos.operators.interpolation import interpolate
from lithos.operators.spatial import neighbours

LOW_CORRELATION = 0.3
LEAST_KNOTS = 10
RELIABLE = 20
#: How far around a well's trace samples are taken, and from how many traces.
AROUND, TRACES = 150.0, 12


def confident(ties: DataFrame) -> DataFrame:
    return ties.where(is_true((F.col("correlation") >= LOW_CORRELATION) & ~F.col("boundary_pinned")))


def overlap(ties: DataFrame, traces: DataFrame, logs: DataFrame, more_ms: float = 0.0, parts: int | None = None) -> DataFrame:
    """(well_id, trace_idx, time_idx, time_ms, depth) of the samples of each well's trace within its logged interval.

    logs: well_id, DEPT, DPTM. Wells with fewer than LEAST_KNOTS samples of both have no map and no rows.
    parts: as in interpolate().
    """
    knots = logs.where("DEPT IS NOT NULL AND DPTM IS NOT NULL").select("well_id", F.col("DPTM").alias("x"), F.col("DEPT").alias("y"))
    enough = knots.groupBy("well_id").agg(F.countDistinct("x").alias("n")).where(F.col("n") >= LEAST_KNOTS)
    t = ties.join(enough, "well_id", "left_semi").join(traces.select("trace_idx", "delay_ms", "dt_ms", F.size("samples").alias("n")), "trace_idx")
    times = t.select("well_id", "trace_idx", "shift_ms", "delay_ms", "dt_ms", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("time_idx"))
    times = times.withColumn("time_ms", F.col("delay_ms") + F.col("time_idx") * F.col("dt_ms"))
    asks = times.select("well_id", F.col("time_idx").cast("long").alias("ask_id"), (F.col("time_ms") - F.col("shift_ms") - more_ms).alias("x"))
    depth = interpolate(asks, knots, ["well_id"], parts=parts).where("value IS NOT NULL").select("well_id", F.col("ask_id").cast("int").alias("time_idx"), F.col("value").alias("depth"))
    return times.select("well_id", "trace_idx", "time_idx", "time_ms").join(depth, ["well_id", "time_idx"])


def properties(context: DataFrame, logs: DataFrame, curves: list[str], parts: int | None = None) -> DataFrame:
    """context with each curve at its depth, between the samples that have the curve; NULL beyond them."""
    out = context
    for c in curves:
        asks = context.select("well_id", F.col("time_idx").cast("long").alias("ask_id"), F.col("depth").alias("x"))
        at = interpolate(asks, logs.select("well_id", F.col("DEPT").alias("x"), F.col(c).alias("y")), ["well_id"], parts=parts)
        out = out.join(at.select("well_id", F.col("ask_id").cast("int").alias("time_idx"), F.col("value").alias(c)), ["well_id", "time_idx"], "left")
    return out


def section_logs(ties: DataFrame, traces: DataFrame, logs: DataFrame, curves: list[str], along: str = "crossline") -> DataFrame:
    """(well_id, position, row_idx, twt_ms, curves): the logs of wells with a confident tie, clipped to the time range of the trace."""
    end = F.col("delay_ms") + (F.size("samples") - 1) * F.col("dt_ms")
    t = confident(ties).join(traces.select("trace_idx", F.col(along).alias("position"), "delay_ms", end.alias("end_ms")), "trace_idx")
    d = logs.where("DEPT IS NOT NULL AND DPTM IS NOT NULL").join(t.select("well_id", "position", "shift_ms", "delay_ms", "end_ms"), "well_id")
    d = d.withColumn("twt_ms", F.col("DPTM") + F.col("shift_ms")).where(F.col("twt_ms").between(F.col("delay_ms"), F.col("end_ms")))
    return d.select("well_id", "position", "row_idx", "twt_ms", *curves)


def section_skipped(ties: DataFrame, drawn: DataFrame) -> DataFrame:
    """(well_id, reason) of the wells that aren't in a section."""
    reason = F.when(F.col("shift_ms").isNull(), "no tie").when(~is_true((F.col("correlation") >= LOW_CORRELATION) & ~F.col("boundary_pinned")), "low confidence").otherwise("outside the time range")
    return ties.join(drawn.select("well_id").distinct(), "well_id", "left_anti").select("well_id", reason.alias("reason"))


def correlate(context: DataFrame, energies: DataFrame, curves: list[str]) -> DataFrame:
    """(well_id, method, curve, r, n) of energies (method, trace_idx, time_idx, e) and the properties of a context."""
    long = context.select("well_id", "trace_idx", "time_idx", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).cast("double").alias("v")) for c in curves])).alias("p")).select("well_id", "trace_idx", "time_idx", "p.*")
    both = long.join(energies, ["trace_idx", "time_idx"])
    n = F.sum((F.col("e").isNotNull() & F.col("v").isNotNull()).cast("long"))
    return both.groupBy("well_id", "method", "curve").agg(pearson("e", "v").alias("r"), n.alias("n")).withColumn("low_sample_warning", F.col("n") < RELIABLE)


def across_wells(correlations: DataFrame) -> DataFrame:
    """The mean of the wells' r that aren't missing, by method and curve."""
    return correlations.groupBy("method", "curve").agg(F.avg("r").alias("r"), F.count("r").alias("n_wells"))


def compare_methods(means: DataFrame, other: str, first: str = "cwt") -> DataFrame:
    """(curve, wording): which of two methods correlates more strongly, the second one in case of a tie."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("r")))
    d = means.groupBy("curve").agg(pick(first).alias("a"), pick(other).alias("b"))
    a, b = F.col("a"), F.col("b")
    wording = F.when(a.isNull() & b.isNull(), "insufficient data").when(a.isNull(), f"only {other}").when(b.isNull(), f"only {first}")
    return d.select("curve", wording.when(F.abs(b) >= F.abs(a), f"{other} more strongly than {first}").otherwise(f"{first} more strongly than {other}").alias("wording"))


def amplitudes(matched: DataFrame) -> DataFrame:
    """(trace_idx, time_idx, cwt, other) of spectral.MATCHED rows."""
    return matched.select("trace_idx", F.posexplode(F.arrays_zip("cwt", "other")).alias("time_idx", "z")).select("trace_idx", "time_idx", "z.cwt", "z.other")


def scatter(context: DataFrame, matched: DataFrame, curves: list[str]) -> DataFrame:
    """(well_id, time_idx, depth, curves, cwt, other): the pairs of samples that a correlation is made of."""
    return context.join(amplitudes(matched), ["trace_idx", "time_idx"]).select("well_id", "time_idx", "depth", *curves, "cwt", "other")


def method_correlation(context: DataFrame, matched: DataFrame, curves: list[str]) -> DataFrame:
    """(well_id, curve, cwt_r, cwt_n, other_r, other_n, low_sample_warning) of two methods at a matched frequency; the warning is a well's."""
    wide = scatter(context, matched, curves)
    made = []
    for c in curves:
        for m in ("cwt", "other"):
            made += [pearson(m, c).alias(f"{c}_{m}_r"), F.sum((F.col(m).isNotNull() & F.col(c).isNotNull()).cast("long")).alias(f"{c}_{m}_n")]
    wells = wide.groupBy("well_id").agg(*made)
    few = F.least(*[F.col(f"{c}_{m}_n") for c in curves for m in ("cwt", "other")]) < RELIABLE
    each = F.array(*[F.struct(F.lit(c).alias("curve"), *[F.col(f"{c}_{m}_{k}").alias(f"{m}_{k}") for m in ("cwt", "other") for k in "rn"]) for c in curves])
    return wells.select("well_id", F.explode(each).alias("e"), few.alias("low_sample_warning")).select("well_id", "e.*", "low_sample_warning")


def method_averages(correlations: DataFrame) -> DataFrame:
    """(curve, cwt_r, other_r, n_wells): the means of the wells' r that there are."""
    return correlations.groupBy("curve").agg(F.avg("cwt_r").alias("cwt_r"), F.avg("other_r").alias("other_r"), F.greatest(F.count("cwt_r"), F.count("other_r")).alias("n_wells"))


def band_match(dt_ms: float, level: int, bins: list[float]) -> tuple[float, float, float]:
    """The band of a wavelet level, and the frequency of `bins` nearest to its centre (the lower of equals)."""
    top = 500.0 / dt_ms
    low, high = top / 2**level, top / 2 ** (level - 1)
    return low, high, min(sorted(bins), key=lambda f: abs(f - (low + high) / 2))


def frequency_match(frequency: float, dt_ms: float, *axes: list[float]) -> list[float]:
    """The nearest frequency of each axis; ValueError beyond the Nyquist frequency."""
    if not 0 <= frequency <= 500.0 / dt_ms:
        raise ValueError(f"{frequency} Hz is outside 0 to {500.0 / dt_ms:g}")
    return [min(sorted(a), key=lambda f: abs(f - frequency)) for a in axes]


def around(ties: DataFrame, traces: DataFrame, radius: float = AROUND, most: int = TRACES) -> DataFrame:
    """(well_id, trace_idx, distance): the traces nearest to each well's own trace, itself first."""
    t = traces.select(F.col("trace_idx").alias("target_id"), "tx", "ty")
    own = ties.select("well_id", F.col("trace_idx").alias("target_id")).join(t, "target_id").select(F.col("well_id").alias("point_id"), F.col("tx").alias("px"), F.col("ty").alias("py"))
    return neighbours(own, t, radius, most).select(F.col("point_id").alias("well_id"), F.col("target_id").alias("trace_idx"), "distance")


def samples(context: DataFrame, near: DataFrame, features: DataFrame) -> DataFrame:
    """Rows for models: each neighbour's features (trace_idx, time_idx, ..) with the well's own properties at that time and a weight of 1 / (1 + distance)."""
    labels = context.drop("trace_idx", "time_ms")
    return labels.join(near, "well_id").join(features, ["trace_idx", "time_idx"]).withColumn("weight", 1.0 / (1.0 + F.col("distance")))


def centre_samples(context: DataFrame, features: DataFrame) -> DataFrame:
    """The same for a blind well: its own trace alone."""
    return context.drop("time_ms").join(features, ["trace_idx", "time_idx"]).withColumn("weight", F.lit(1.0))
