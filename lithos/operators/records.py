"""Records of wells: what a tie, a synthetic and the spectrum of the tied line come to, in one row, and answers from kept records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators import seismic


def line_reports(traces: DataFrame) -> DataFrame:
    """(inline, dominant_freq_hz, bandwidth_hz, snr_proxy) of each line's mean spectrum."""
    by_line = traces.withColumn("dataset_id", F.col("inline").cast("string"))
    report = seismic.amplitude_report(seismic.average_spectrum(seismic.spectrum(by_line)))
    return report.select(F.col("dataset_id").cast("int").alias("inline"), "dominant_freq_hz", "bandwidth_hz", "snr_proxy")


def trace_lines(ties: DataFrame, traces: DataFrame) -> DataFrame:
    """ties with the line numbers of their traces; NULL for a trace that isn't there."""
    return ties.join(traces.select("trace_idx", "inline", "crossline"), "trace_idx", "left")


def low_confidence(correlation, pinned, plausible=None, least: float = 0.3):
    """Too little correlation, a shift at the border of its search, or (for synthetics) a datum that can't be."""
    doubt = (F.col(correlation) < least) | F.col(pinned)
    return doubt if plausible is None else doubt | ~F.coalesce(F.col(plausible), F.lit(False))


def well_records(ties: DataFrame, made: DataFrame, traces: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """A record for each well of ties.tie_wells(): its tie, its synthetic (synthetics.seismograms()) and the spectrum of the tied line.

    distances: (well_id, distance) of wells and traces. What failed is not available and says why.
    """
    t = trace_lines(ties, traces).withColumn("ok", F.col("error").isNull())
    t = t.withColumn("distance", F.lit(None).cast("double")) if distances is None else t.join(distances.select("well_id", "distance"), "well_id", "left")
    s = made.select(
        "well_id", F.col("error").isNull().alias("synthetic_available"), F.col("error").alias("synthetic_error"), F.col("correlation").alias("synthetic_correlation"),
        F.col("boundary_pinned").alias("synthetic_boundary_pinned"), low_confidence("correlation", "boundary_pinned", "plausible").alias("synthetic_low_confidence"),
        F.col("plausible").alias("synthetic_datum_plausible"), F.size(F.filter("washout", lambda x: x)).cast("long").alias("synthetic_washout_count"),
        F.col("polarity").alias("synthetic_polarity"), F.col("shift_ms").alias("synthetic_shift_ms"),
    )
    s = s.withColumn("synthetic_low_confidence", F.when(F.col("synthetic_available"), F.col("synthetic_low_confidence")))
    s = s.withColumn("synthetic_washout_count", F.when(F.col("synthetic_available"), F.col("synthetic_washout_count")))
    out = t.join(s, "well_id", "left").join(line_reports(traces).withColumnRenamed("inline", "spectral_inline"), F.col("ok") & (F.col("inline") == F.col("spectral_inline")), "left")
    names = {"correlation": "correlation", "boundary_pinned": "boundary_pinned", "low_confidence": "low_confidence", "frequency": "frequency", "polarity": "polarity", "shift_ms": "shift_ms", "distance": "distance", "trace_idx": "trace_idx", "inline": "inline", "crossline": "crossline"}
    tied = [F.when(F.col("ok"), F.col(c)).alias(f"tie_{n}") for c, n in names.items()]
    spectral = [F.col(c).alias(f"spectral_{c}") for c in ("dominant_freq_hz", "bandwidth_hz", "snr_proxy")]
    made_of = [c for c in s.columns if c != "well_id"]
    return out.select("well_id", F.col("ok").alias("tie_available"), F.col("error").alias("tie_error"), *tied, *made_of, F.col("spectral_inline").isNotNull().alias("spectral_available"), "spectral_inline", *spectral)


def answered(records: DataFrame, wells: DataFrame, live: DataFrame, part: str) -> DataFrame:
    """The part (tie, synthetic, spectral) of each well: from its record if it has it, else as computed live (a record), with source."""
    columns = [c for c in live.columns if c.startswith(f"{part}_")]
    kept, new = (d.select("well_id", F.struct(*columns).alias(n)) for d, n in ((records, "kept"), (live, "new")))
    d = wells.select("well_id").join(kept, "well_id", "left").join(new, "well_id", "left")
    hit = F.coalesce(F.col(f"kept.{part}_available"), F.lit(False))
    source = F.when(hit, "record").when(F.coalesce(F.col(f"new.{part}_available"), F.lit(False)), "live").otherwise("none")
    return d.select("well_id", source.alias("source"), *[F.when(hit, F.col(f"kept.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in columns])


def new_records(wells: DataFrame, token: str) -> DataFrame:
    """Records, ready, for wells that have none: somewhere to keep what was computed live."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return wells.select("well_id", F.lit("ready").alias("status"), F.lit(token).alias("run_token"), now.alias("created_at"), now.alias("updated_at"))
