"""Reports that put logs, places and ties together; a well that can't be used keeps its row and the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.columns import is_true
from lithos.operators import spatial


def crs_check(wells: DataFrame, traces: DataFrame, share: float = 0.2, least: float = 500.0) -> DataFrame:
    """wells (well_id, wx, wy) with aligned: within the survey's extent and a fifth of it (500 m at least) around."""
    box = traces.agg(*[f(c).alias(f"{k}{c}") for c in ("tx", "ty") for k, f in (("lo", F.min), ("hi", F.max))])
    d = wells.join(F.broadcast(box), F.lit(True))
    inside = F.lit(True)
    for w, t in (("wx", "tx"), ("wy", "ty")):
        room = F.greatest(share * (F.col(f"hi{t}") - F.col(f"lo{t}")), F.lit(least))
        inside = inside & (F.col(w) >= F.col(f"lo{t}") - room) & (F.col(w) <= F.col(f"hi{t}") + room)
    return d.select("well_id", is_true(inside).alias("aligned"))


def calibration_report(wells: DataFrame, traces: DataFrame, spacing: float, multiple: float = 2.0, fitted: DataFrame | None = None) -> DataFrame:
    """Each well with a place: where the axis fit puts it, the nearest trace there, and the two flags that make it trustworthy.

    wells: well_id, point_id, wx, wy; fitted: those that the fit is made on (all). Extrapolated: outside the wells that were fitted and outside the survey.
    """
    every = wells.where("wx IS NOT NULL AND wy IS NOT NULL")
    w = every if fitted is None else fitted
    fit = spatial.axis_fit(w, traces)
    c = spatial.calibrated(every, fit)
    near = spatial.nearest(c.select("point_id", F.col("cx").alias("px"), F.col("cy").alias("py")), traces)
    ranges = [w.agg(*[f(x).alias(f"{k}{x}") for x in ("wx", "wy") for k, f in (("lo", F.min), ("hi", F.max))]), traces.agg(*[f(x).alias(f"{k}{x}") for x in ("tx", "ty") for k, f in (("lo", F.min), ("hi", F.max))])]
    d = c.join(near, "point_id")
    for r in ranges:
        d = d.join(F.broadcast(r), F.lit(True))
    among = F.col("wx").between(F.col("lowx"), F.col("hiwx")) & F.col("wy").between(F.col("lowy"), F.col("hiwy"))
    inside = F.col("cx").between(F.col("lotx"), F.col("hitx")) & F.col("cy").between(F.col("loty"), F.col("hity"))
    out = d.withColumn("within_tolerance", is_true(F.col("distance") <= multiple * spacing)).withColumn("extrapolated", ~is_true(among) & ~is_true(inside))
    return out.select("well_id", "cx", "cy", F.col("target_id").alias("trace_idx"), "distance", "within_tolerance", "extrapolated", (F.col("within_tolerance") & ~F.col("extrapolated")).alias("trustworthy"))


def calibration_details(wells: DataFrame, traces: DataFrame, overrides: DataFrame, spacing: float, chosen: DataFrame | None = None, multiple: float = 2.0) -> DataFrame:
    """calibration_report() with the lines of the trace that the fit finds, the nearest trace to the well as it is, the override, and whether the fit was made on the well.

    overrides: well_id, inline, crossline; chosen: (well_id) of the wells that are fitted, all with a place without it.
    """
    placed = wells.where("wx IS NOT NULL AND wy IS NOT NULL")
    fitted = placed if chosen is None else placed.join(chosen.select("well_id"), "well_id", "left_semi")
    lines = lambda t, name: traces.select(F.col("target_id").alias(t), F.col("inline").alias(f"{name}_inline"), F.col("crossline").alias(f"{name}_crossline"))
    raw = spatial.nearest(placed.select("point_id", F.col("wx").alias("px"), F.col("wy").alias("py")), traces).select("point_id", F.col("target_id").alias("raw_trace_idx"), F.col("distance").alias("raw_distance"))
    raw = placed.select("well_id", "point_id").join(raw, "point_id").drop("point_id").join(lines("raw_trace_idx", "raw"), "raw_trace_idx", "left")
    d = calibration_report(wells, traces, spacing, multiple, fitted).join(lines("trace_idx", "fit"), "trace_idx", "left").join(raw, "well_id")
    o = overrides.select("well_id", F.col("inline").alias("override_inline"), F.col("crossline").alias("override_crossline"), F.lit(True).alias("__o"))
    used = fitted.select("well_id", F.lit(True).alias("__u"))
    d = d.join(o, "well_id", "left").join(used, "well_id", "left")
    return d.withColumn("has_override", is_true(F.col("__o"))).withColumn("used_in_fit", is_true(F.col("__u"))).drop("__o", "__u")


def resolve_calibrated(wells: DataFrame, overrides: DataFrame, traces: DataFrame, spacing: float, multiple: float = 2.0) -> DataFrame:
    """(well_id, trace_idx, distance, method, error): the trace of each well, or why there is none.

    An override counts alone: where its lines have no trace, nothing else is looked for. Then the axis
    fit, if it makes the well trustworthy. With too few wells for a fit the nearest trace to the well as
    it is counts, unvalidated, if the well is near the survey at all.
    """
    grid = traces.groupBy("inline", "crossline").agg(F.min("target_id").alias("o"))
    known = [traces.select(c).distinct().withColumn(f"__{c}", F.lit(True)) for c in ("inline", "crossline")]
    asked = overrides.select("well_id", "inline", "crossline").join(grid, ["inline", "crossline"], "left").join(known[0], "inline", "left").join(known[1], "crossline", "left")
    asked = asked.select("well_id", F.lit(True).alias("asked"), "o", (is_true(F.col("__inline")) & is_true(F.col("__crossline"))).alias("lines"))
    fit = calibration_report(wells, traces, spacing, multiple).select("well_id", F.col("trace_idx").alias("f"), F.col("distance").alias("fd"), "within_tolerance", "extrapolated", "trustworthy", F.col("cx").isNotNull().alias("fitted"))
    place = wells.select("well_id", "point_id", (F.col("wx").isNotNull() & F.col("wy").isNotNull()).alias("placed"))
    raw = spatial.nearest(wells.select("point_id", F.col("wx").alias("px"), F.col("wy").alias("py")), traces).select("point_id", F.col("target_id").alias("n"), F.col("distance").alias("nd"))
    d = place.join(raw, "point_id").join(asked, "well_id", "left").join(fit, "well_id", "left").join(crs_check(wells, traces), "well_id")
    own, fitted, direct = is_true(F.col("asked")), is_true(F.col("fitted")), F.col("placed") & ~is_true(F.col("fitted"))
    reason = (
        F.when(own, F.when(F.col("o").isNotNull(), None).when(F.col("lines"), "no trace at the override").otherwise("override outside the survey"))
        .when(~F.col("placed"), "no coordinates")
        .when(fitted & is_true(F.col("trustworthy")), None)
        .when(fitted, F.concat_ws(" and ", F.when(F.col("extrapolated"), "extrapolated"), F.when(~F.col("within_tolerance"), "too far from a trace")))
        .when(~F.col("aligned"), "outside the survey")
    )
    method = F.when(own, "manual_override").when(fitted, "calibrated_fit").when(direct, "direct_unvalidated")
    trace = F.when(own, F.col("o")).when(fitted, F.col("f")).otherwise(F.col("n"))
    distance = F.when(own, None).when(fitted, F.col("fd")).otherwise(F.col("nd"))
    d = d.withColumn("error", reason)
    ok = F.col("error").isNull()
    return d.select("well_id", F.when(ok, trace).alias("trace_idx"), F.when(ok, distance).alias("distance"), F.when(ok, method).alias("method"), "error")


def pay_points(wells: DataFrame, interpreted: DataFrame, traces: DataFrame, radius: float) -> DataFrame:
    """A row for each well: its trace and mean shale volume in pay, or the reason it has no point."""
    near = spatial.nearest(wells.select("point_id", F.col("wx").alias("px"), F.col("wy").alias("py")), traces, radius)
    pay = interpreted.where("ZONES = 1 AND VSH IS NOT NULL").groupBy("well_id").agg(F.avg("VSH").alias("mean_vsh_pay"), F.count("*").alias("n_pay"))
    d = wells.join(near, "point_id", "left").join(pay, "well_id", "left")
    reason = F.when(F.col("wx").isNull() | F.col("wy").isNull(), "no coordinates").when(F.col("target_id").isNull(), "no trace near").when(F.col("n_pay").isNull(), "no pay")
    return d.select("well_id", "wx", "wy", F.col("target_id").alias("trace_idx"), "distance", "mean_vsh_pay", "n_pay", reason.alias("reason"))


def zone_tie_map(points: DataFrame, traces: DataFrame, power: float = 2.0) -> DataFrame:
    """The pay points' shale volume over all traces; ValueError for fewer than two points."""
    good = points.where("reason IS NULL").select("wx", "wy", F.col("mean_vsh_pay").alias("value"))
    if good.limit(2).count() < 2:
        raise ValueError("fewer than two wells with pay near the survey")
    return spatial.idw(traces.select(F.col("target_id").alias("cell_id"), F.col("tx").alias("x"), F.col("ty").alias("y")), good, power)


def eligible(ties: DataFrame) -> DataFrame:
    """Ties (of ties.tie_wells) with the reason why a model may not use them; NULL for those it may."""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("boundary_pinned"), "boundary pinned").when(F.col("low_confidence"), "low confidence")
    return ties.withColumn("reason", reason)


def field_overview(summary: DataFrame, zones: DataFrame, ties: DataFrame) -> DataFrame:
    """Every well with its summary, pay zone and tie; what failed or is missing is NULL, and no well is lost."""
    pay = zones.where("zone = 1").select("well_id", F.col("thickness").alias("pay_thickness"), F.col("n_samples").alias("n_pay"))
    t = ties.select("well_id", "correlation", "shift_ms", "low_confidence", F.col("error").alias("tie_error"))
    return summary.join(pay, "well_id", "left").join(t, "well_id", "left")


def tie_report(tie: DataFrame, samples: DataFrame) -> DataFrame:
    """(well_id, k, line): lines "# key,value" for the fields of each tie, then one line for each of its samples (well_id, i, time_ms, synthetic, seismic)."""
    names = [c for c in tie.columns if c != "well_id"]
    n = len(names)
    head = tie.select("well_id", F.posexplode(F.array(*[F.concat(F.lit(f"# {c},"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])).alias("k", "line"))
    body = samples.select("well_id", (F.col("i") + n + 1).alias("k"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("time_ms", "synthetic", "seismic")]).alias("line"))
    title = tie.select("well_id", F.lit(n).alias("k"), F.lit("time_ms,synthetic,seismic").alias("line"))
    return head.unionByName(title).unionByName(body)
