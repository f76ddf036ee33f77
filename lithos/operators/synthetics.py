"""Synthetic seismograms: one nested row for each well with all that a tie is judged by, and views that unnest it.

Density by any method, washout flags and stretch points come in as columns and joins. The rest of a
well meets its own trace in one group: the time axis (the well's own, or integrated from the sonic), a
wavelet (Ricker, or of the trace's own spectrum), reflectivity, the synthetic on the trace's axis and
the shift that fits best. A group is a well's logs and one trace, so no task grows with the survey.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators import cleaning, ties
from lithos.operators.spectral import statistical_wavelet, wavelet_spectrum

WAVELETS = ("statistical", "ricker")
LEAST_ROWS = 10

#: Views: the arrays of one length that belong together, and the names they get as columns.
VIEWS = {
    "logs": {"log_depth": "depth", "log_twt": "twt_ms", "log_ai": "ai"},
    "reflectivity": {"rc_depth": "depth", "rc_twt": "twt_ms", "rc": "rc"},
    "washout": {"washout_depth": "depth", "washout": "washout"},
    "wavelet": {"wavelet_t": "t_ms", "wavelet": "amplitude"},
    "wavelet_spectrum": {"wavelet_f": "frequency", "wavelet_amplitude": "amplitude", "wavelet_phase": "phase_deg"},
    "traces": {"time_ms": "time_ms", "synthetic": "synthetic", "shifted": "shifted", "real": "real"},
    "spectra": {"spectrum_f": "frequency", "real_spectrum": "real", "synthetic_spectrum": "synthetic"},
    "tie_points": {"point_depth": "depth", "point_shift": "shift_ms"},
}
SCALARS = {
    "trace_idx": pa.int64(), "error": pa.string(), "density_note": pa.string(), "gardner_a": pa.float64(), "gardner_b": pa.float64(), "time_source": pa.string(),
    "frequency": pa.float64(), "polarity": pa.int32(), "shift_ms": pa.float64(), "correlation": pa.float64(), "boundary_pinned": pa.bool_(),
    "low_confidence": pa.bool_(), "implied_depth": pa.float64(), "top_depth": pa.float64(), "relative_error": pa.float64(), "plausible": pa.bool_(),
}
ARRAYS = [c for view in VIEWS.values() for c in view]
SCHEMA = pa.schema([("well_id", pa.string()), *SCALARS.items(), *[(c, pa.list_(pa.bool_() if c == "washout" else pa.float64())) for c in ARRAYS]])
DDL = ", ".join(f"{f.name} " + {"list": "array<boolean>" if f.name == "washout" else "array<double>", "int64": "long", "int32": "int", "bool": "boolean"}.get(str(f.type).split("<")[0], str(f.type)) for f in SCHEMA)


def seismograms(
    logs: DataFrame, resolved: DataFrame, traces: DataFrame, wavelet: str = "statistical", frequency: float = 25.0, density: str = "rhob",
    points: DataFrame | None = None, max_shift: float = 300.0, search: bool = False,
) -> DataFrame:
    """A nested row for each well of resolved (well_id, trace_idx).

    logs: well_id, row_idx, DEPT, DT, RHOB, NPHI, DPTM (VSH, PHIE for rock physics). points: stretch
    points (well_id, x = depth, y = ms). Without search the wavelet is taken as it is and only a shift
    is looked for; with it, a Ricker wavelet's frequency, polarity and shift over the whole trace, or
    the polarity of the statistical one. A well that can't be tied keeps its row and says why.
    """
    if wavelet not in WAVELETS:
        raise ValueError(f"{wavelet}: one of {', '.join(WAVELETS)}")
    for c in ("NPHI", "DPTM"):
        logs = logs if c in logs.columns else logs.withColumn(c, F.lit(None).cast("double"))
    d = ties.densities(logs, density)
    for c in ("gardner_a", "gardner_b"):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("double"))
    measured = F.max(F.col("RHOB").isNotNull()).over(ties.per_well()) if "RHOB" in logs.columns else F.lit(False)
    flagged = cleaning.washout(d.withColumn("RHOB", F.when(measured, F.col("RHOB")).otherwise(F.col("density"))) if "RHOB" in logs.columns else d.withColumn("RHOB", F.col("density")))
    lean = flagged.select("well_id", "row_idx", "DEPT", "DT", "DPTM", F.col("density").cast("double").alias("density"), "density_note", "gardner_a", "gardner_b", "washout")
    trace = resolved.select("well_id", "trace_idx").join(traces.select("trace_idx", "delay_ms", "dt_ms", "samples"), "trace_idx", "left")
    moves = "array<struct<x:double,y:double>>"
    if points is None:
        trace = trace.withColumn("moves", F.lit(None).cast(moves))
    else:
        by_well = points.groupBy("well_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).cast(moves).alias("moves"))
        trace = trace.join(by_well, "well_id", "left")

    def run(key, logs, trace):
        if not len(trace):
            return SCHEMA.empty_table()
        t = trace.to_pylist()[0]
        row = {"well_id": key[0].as_py(), "trace_idx": t["trace_idx"]}
        try:
            row |= tie(logs.sort_by("row_idx"), t, wavelet, frequency, max_shift, search)
        except ValueError as e:
            row["error"] = str(e)
        return pa.Table.from_pylist([row], SCHEMA)

    return lean.groupBy("well_id").cogroup(trace.groupBy("well_id")).applyInArrow(run, DDL)


def numbers(table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False).astype(float)


def tie(logs, trace: dict, wavelet: str, frequency: float, max_shift: float, search: bool) -> dict:
    """The fields of one well; ValueError if it can't be tied."""
    if not len(logs):
        raise ValueError("no logs")
    out = {c: logs[c][0].as_py() for c in ("density_note", "gardner_a", "gardner_b")}
    if not trace["samples"]:
        raise ValueError("no trace")
    depth, dt, rho, own = (numbers(logs, c) for c in ("DEPT", "DT", "density", "DPTM"))
    if not np.isfinite(dt).any():
        raise ValueError("missing DT")
    if not np.isfinite(rho).any():
        raise ValueError(out["density_note"])
    step = trace["dt_ms"]
    real = np.nan_to_num(np.array(trace["samples"], float))
    axis = trace["delay_ms"] + step * np.arange(len(real))
    ok = np.isfinite(depth) & np.isfinite(dt) & np.isfinite(rho) & (dt > 0) & (rho > 0)
    if ok.sum() < LEAST_ROWS:
        raise ValueError("too few samples")
    top = float(depth[ok][0])
    implied = trace["delay_ms"] / 2000.0 * ties.OVERBURDEN
    error = abs(implied - top) / top if top > 0 else None
    out |= {"implied_depth": implied, "top_depth": top, "relative_error": error, "plausible": error is not None and error <= ties.DATUM_ERROR}

    timed = ok & np.isfinite(own)
    if timed.sum() >= LEAST_ROWS:
        order = np.argsort(own[timed], kind="stable")
        depth, dt, rho, twt = (x[timed][order] for x in (depth, dt, rho, own))
        apart = np.concatenate([[True], np.diff(twt) > ties.APART])
        depth, dt, rho, twt = (x[apart] for x in (depth, dt, rho, twt))
        out["time_source"] = "dptm"
    else:
        depth, dt, rho = depth[ok], dt[ok], rho[ok]
        twt = trace["delay_ms"] + np.concatenate([[0.0], np.cumsum(np.diff(depth) / ties.FOOT * (dt[1:] + dt[:-1]))]) / 1000.0
        out["time_source"] = "sonic"
    ai = ties.FOOT * 1e6 / dt * rho
    both = ai[1:] + ai[:-1]
    rc = ties.despiked(np.divide(np.diff(ai), both, out=np.zeros(len(both)), where=both != 0))
    at, where = (twt[1:] + twt[:-1]) / 2, (depth[1:] + depth[:-1]) / 2
    if trace["moves"]:
        x, y = ([m[c] for m in trace["moves"]] for c in "xy")
        at = at + np.interp(where, x, y)
        out |= {"point_depth": x, "point_shift": y}
    times = at[0] + step * np.arange(int(np.ceil((at[-1] - at[0]) / step - 1e-9)))
    if len(times) < 1:
        raise ValueError("too few samples")
    regular = np.interp(times, at, rc)

    if wavelet == "statistical":
        w_t, w = statistical_wavelet(real, step)
        frequency = None
    else:
        w = ties.ricker_array(frequency, step / 1000.0)
        w_t = -500.0 * ties.WAVELET_S + step * np.arange(len(w))
    polarity = 1
    if search and wavelet == "ricker":
        found = ties.best_tie(times, regular, axis, real, step, max_shift=max_shift)
        if not found:
            raise ValueError("no overlap")
        r, frequency, polarity, shift, _ = found
        w = polarity * ties.ricker_array(frequency, step / 1000.0)
        synth = ties.on_axis(regular, times, axis, w)
        moved = np.interp(axis, times + shift, ties.cropped(regular, w), left=0.0, right=0.0)
    else:
        plain = ties.on_axis(regular, times, axis, w)
        fits = [(p, *ties.lag_fit(p * plain, real, step, max_shift)) for p in ((1, -1) if search else (1,))]
        polarity, r, shift, moved = max(fits, key=lambda f: f[1])  # the first of equals
        w, synth = polarity * w, polarity * plain
    pinned = abs(shift) >= ties.PINNED * max_shift
    f, amplitude, phase = wavelet_spectrum(w, step)
    both_f, real_spectrum, _ = wavelet_spectrum(real, step)
    out |= {"frequency": frequency, "polarity": polarity, "shift_ms": shift, "correlation": r, "boundary_pinned": pinned, "low_confidence": pinned or r < ties.LEAST_CORRELATION or not out["plausible"]}
    out |= {"log_depth": depth, "log_twt": twt, "log_ai": ai, "rc_depth": where, "rc_twt": at, "rc": rc, "wavelet_t": w_t, "wavelet": w}
    out |= {"washout_depth": numbers(logs, "DEPT"), "washout": logs["washout"].to_pylist(), "wavelet_f": f, "wavelet_amplitude": amplitude, "wavelet_phase": phase}
    return out | {"time_ms": axis, "synthetic": synth, "shifted": moved, "real": real, "spectrum_f": both_f, "real_spectrum": real_spectrum, "synthetic_spectrum": wavelet_spectrum(moved, step)[1]}


def summary(made: DataFrame) -> DataFrame:
    """The numbers of each well without its arrays."""
    return made.select("well_id", *SCALARS)


def view(made: DataFrame, name: str) -> DataFrame:
    """(well_id, i, ..) of one of VIEWS; wells without it have no rows."""
    names = VIEWS[name]
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in names.items()])
    flat = made.select("well_id", F.posexplode(zipped).alias("i", "z"))
    return flat.select("well_id", "i", *[F.col("z")[n].alias(n) for n in names.values()])


def washout_intervals(made: DataFrame) -> DataFrame:
    """(well_id, top, bottom, n) of the runs of flagged depths."""
    from lithos.operators.wells import intervals

    flat = view(made, "washout").select("well_id", F.col("i").cast("long").alias("row_idx"), F.col("depth").alias("DEPT"), "washout")
    return intervals(flat, "washout")
