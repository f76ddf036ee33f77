"""Synthetic seismograms, spectra at a matched frequency: planted answers, awkward wells, what plans may not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators import context, spectral, synthetics, ties

STEP, DELAY, N = 2.0, 2000.0, 200
LOGS = "well_id string, row_idx long, DEPT double, DT double, RHOB double, NPHI double, VSH double, PHIE double, DPTM double"


def well(name, r, n=240, own_time=True):
    """Logs at 0.15 m whose own time runs from 2060 ms on."""
    depth = 1500 + 0.6 * np.arange(n)
    dt = 85 + 3 * r.standard_normal(n)
    rho = 2.3 + 0.15 * np.sign(np.sin(np.arange(n) / 7.0)) + 0.05 * r.standard_normal(n)
    time = 2060 + np.concatenate([[0], np.cumsum(np.diff(depth) / 0.3048 * (dt[1:] + dt[:-1]))]) / 1000
    return [(name, i, float(depth[i]), float(dt[i]), float(rho[i]), 0.2, 0.3, 0.15, float(time[i]) if own_time else None) for i in range(n)]


def planted(rows, frequency, polarity, shift, r, wavelet=None):
    """A trace that is a well's synthetic moved by shift, and a little noise."""
    t, dt, rho = (np.array([x[k] for x in rows]) for k in (8, 3, 4))
    ai = ties.FOOT * 1e6 / dt * rho
    rc = ties.despiked(np.diff(ai) / (ai[1:] + ai[:-1]))
    mid = (t[1:] + t[:-1]) / 2
    times = np.arange(mid[0], mid[-1], STEP)
    synth = ties.cropped(np.interp(times, mid, rc), ties.ricker_array(frequency, STEP / 1000) if wavelet is None else wavelet)
    axis = DELAY + STEP * np.arange(N)
    clean = polarity * np.interp(axis, times + shift, synth, left=0.0, right=0.0)
    return [float(x) for x in clean + 0.03 * np.abs(clean).max() * r.standard_normal(N)]


@pytest.fixture(scope="module")
def field(spark):
    r = np.random.default_rng(5)
    wells = {k: well(k, r, own_time=k != "C") for k in "ABCD"}
    wells["E"] = well("E", r, n=6)
    wells["F"] = [(*x[:3], None, *x[4:]) for x in well("F", r)]
    wells["H"] = [(*x[:4], None, *x[5:]) for x in well("H", r)]
    samples = {"A": planted(wells["A"], 30.0, 1, 24.0, r), "B": planted(wells["B"], 44.0, -1, -16.0, r), "D": planted(wells["D"], 25.0, -1, 10.0, r)}
    names = [*wells, "G"]
    logs = spark.createDataFrame([x for k in wells for x in wells[k]], LOGS)
    resolved = spark.createDataFrame([(k, i) for i, k in enumerate(names)], "well_id string, trace_idx long")
    flat = [0.1 * np.sin(np.arange(N) / 5)]
    traces = spark.createDataFrame([(i, DELAY, STEP, samples.get(k, [float(x) for x in flat[0]])) for i, k in enumerate(names) if k != "G"], "trace_idx long, delay_ms double, dt_ms double, samples array<double>")
    return logs, resolved, traces, wells, samples


def by_well(df):
    return {r.well_id: r for r in df.collect()}


def test_search_finds_frequency_polarity_and_shift(field):
    logs, resolved, traces, _, _ = field
    got = by_well(synthetics.summary(synthetics.seismograms(logs, resolved, traces, "ricker", search=True, max_shift=60.0)))
    for k, f, p, s in (("A", 30.0, 1, 24.0), ("B", 44.0, -1, -16.0)):
        assert got[k].correlation > 0.9 and got[k].polarity == p and abs(got[k].shift_ms - s) <= STEP and abs(got[k].frequency - f) <= 4 and not got[k].boundary_pinned
    assert got["A"].time_source == "dptm" and got["C"].time_source == "sonic"
    assert {k: got[k].error for k in "EFGH"} == {"E": "too few samples", "F": "missing DT", "G": "no logs", "H": "missing RHOB"}


def test_wavelet_as_it_is(field):
    logs, resolved, traces, _, samples = field
    out = synthetics.seismograms(logs, resolved, traces, "ricker", frequency=30.0, max_shift=60.0).cache()
    got = by_well(synthetics.summary(out))
    assert got["A"].correlation > 0.9 and abs(got["A"].shift_ms - 24.0) <= STEP and got["A"].polarity == 1
    assert got["D"].polarity == 1 and got["D"].frequency == 30.0  # without a search the polarity stays
    shown = [r for r in synthetics.view(out, "traces").where("well_id = 'A'").orderBy("i").collect()]
    assert len(shown) == N and [r.real for r in shown] == pytest.approx(samples["A"])
    k = round(got["A"].shift_ms / STEP)
    assert [r.shifted for r in shown][k:] == [r.synthetic for r in shown][: N - k]
    assert {r.well_id for r in synthetics.view(out, "reflectivity").select("well_id").distinct().collect()} == set("ABCD")
    assert synthetics.view(out, "wavelet").where("well_id = 'A'").count() == 64


def test_statistical_wavelet_takes_the_trace_s_polarity(field):
    logs, resolved, traces, _, _ = field
    fixed = by_well(synthetics.summary(synthetics.seismograms(logs, resolved, traces, max_shift=60.0)))
    free = by_well(synthetics.summary(synthetics.seismograms(logs, resolved, traces, max_shift=60.0, search=True)))
    assert free["D"].polarity == -1 and free["D"].correlation > 0.6 and abs(free["D"].shift_ms - 10.0) <= 2 * STEP
    assert free["D"].correlation >= fixed["D"].correlation and fixed["D"].polarity == 1 and free["D"].frequency is None
    assert free["A"].polarity == 1 and free["A"].correlation > 0.6


def test_densities_stretch_and_washout(spark, field):
    logs, resolved, traces, wells, _ = field
    for method, note in (("gardner", "calibrated"), ("rock_physics", "rock physics")):
        got = by_well(synthetics.summary(synthetics.seismograms(logs, resolved, traces, "ricker", density=method, search=True, max_shift=60.0)))
        assert got["A"].density_note == note and got["A"].error is None
        assert (got["A"].gardner_a is not None) == (method == "gardner")
        assert got["H"].density_note == ("textbook" if method == "gardner" else note) and got["H"].error is None
    points = spark.createDataFrame([("A", 1500.0, 8.0), ("A", 1700.0, 8.0)], "well_id string, x double, y double")
    moved = synthetics.seismograms(logs, resolved, traces, "ricker", 30.0, points=points, max_shift=60.0).cache()
    got = by_well(synthetics.summary(moved))
    assert abs(got["A"].shift_ms - 16.0) <= STEP
    assert [(r.depth, r.shift_ms) for r in synthetics.view(moved, "tie_points").collect()] == [(1500.0, 8.0), (1700.0, 8.0)]
    bad = logs.withColumn("NPHI", F.when((F.col("well_id") == "A") & F.col("row_idx").between(40, 49), 0.6).otherwise(F.lit(0.2)))
    runs = synthetics.washout_intervals(synthetics.seismograms(bad.withColumn("RHOB", F.lit(2.32)), resolved, traces, "ricker")).where("well_id = 'A'").collect()
    assert any(abs(r.top - 1524.0) < 1e-6 and abs(r.bottom - 1529.4) < 1e-6 and r.n == 10 for r in runs)
    with pytest.raises(ValueError):
        synthetics.seismograms(logs, resolved, traces, "boxcar")


def test_all_shifts_at_once_are_those_of_a_loop():
    r = np.random.default_rng(8)
    for _ in range(6):
        n = int(r.integers(12, 60))
        rc, trace = 0.1 * r.standard_normal(n), r.standard_normal(90)
        t, axis = 2030 + float(r.uniform(-30, 60)) + 2.0 * np.arange(n), 2030 + 2.0 * np.arange(90)
        best = None
        length, least = min(0.1, max(0.03, 0.6 * n * 0.002)), min(30, max(10, n // 2))
        for f in (10.0, 26.0, 60.0):
            synth = ties.cropped(rc, ties.ricker_array(f, 0.002, length))
            for p in (1, -1):
                for s in np.arange(-40.0, 41.0, 2.0):
                    on = (t + s >= axis[0] - 1e-6) & (t + s <= axis[-1] + 1e-6)
                    if on.sum() >= least:
                        c = float(np.corrcoef(p * synth[on], np.interp(t[on] + s, axis, trace))[0, 1])
                        if best is None or c > best[0]:
                            best = (c, f, p, float(s), int(on.sum()))
        got = ties.best_tie(t, rc, axis, trace, 2.0, (10.0, 26.0, 60.0), 40.0)
        assert (got is None) == (best is None)
        if best:
            assert got[0] == pytest.approx(best[0], abs=1e-9) and got[1:] == best[1:]


def test_transforms_in_batches_and_one_bin_alone(spark):
    r = np.random.default_rng(2)
    rows = [(i, 1.0, [float(x) for x in r.standard_normal(n)] if n else None, dt) for i, (n, dt) in enumerate([(64, 2.0), (100, 2.0), (64, 4.0), (0, 2.0), (5, 2.0), (64, 2.0)] * 5)]
    rows.append((99, 1.0, [1.0, None, 2.0] * 20, 2.0))
    t = spark.createDataFrame(rows, "trace_idx long, delay_ms double, samples array<double>, dt_ms double").withColumn("dataset_id", F.lit("D"))
    plain = {i: (np.nan_to_num(np.array(s, float))[None], dt) for i, _, s, dt in rows if s}
    for row in spectral.matched_squeezed(t, 40.0).collect():
        x, dt = plain[row.trace_idx]
        f, e = spectral.sswt(x, dt)
        k = int(np.argmin(abs(f - 40.0)))
        assert row.other_low == pytest.approx(f[k]) and row.other == pytest.approx(e[0, k].tolist(), abs=1e-9)
    for row in spectral.matched_bands(t, 2, "coif3").collect():
        x, dt = plain[row.trace_idx]
        low, high = spectral.swt_band(2, dt)
        assert (row.other_low, row.other_high) == (low, high) and row.other == pytest.approx(spectral.envelope(spectral.swt_details(x, "coif3")[:, 1])[0].tolist(), abs=1e-9)
        f = spectral.cwt_frequencies(dt)
        assert row.frequency == f[np.argmin(abs(f - (low + high) / 2))]
    assert spectral.matched_squeezed(t, 40.0).count() == 21 and spectral.matched_bands(t, 3).count() == 26
    whole = spectral.trace_features(t)
    few = spectral.trace_features(t, ["sswt_entropy", "inst_freq_hz"])
    assert few.columns == ["trace_idx", "time_idx", "sswt_entropy", "inst_freq_hz"]
    a = {(r.trace_idx, r.time_idx): (r.sswt_entropy, r.inst_freq_hz) for r in whole.collect()}
    assert {(r.trace_idx, r.time_idx): (r.sswt_entropy, r.inst_freq_hz) for r in few.collect()} == a and len(a) == 5 * (64 + 100 + 64 + 64) + 60
    for method in ("stft", "cwt", "swt", "sswt"):
        assert spectral.decompose(t, method).select("trace_idx").distinct().count() == (21 if method == "sswt" else 26)
    assert spectral.envelopes(t).where("avg_envelope IS NULL").count() == 5
    with pytest.raises(Exception, match="outside"):
        spectral.matched_squeezed(t, 400.0).collect()
    with pytest.raises(ValueError):
        spectral.matched_bands(t, 7)


def test_methods_against_a_property_that_follows_one_of_them(spark):
    r = np.random.default_rng(1)
    n = 160
    t = np.arange(n) * 0.002
    loud = 1 + np.sin(2 * np.pi * 2.5 * t)
    x = loud * np.sin(2 * np.pi * 45 * t) + 0.02 * r.standard_normal(n)
    traces = spark.createDataFrame([(1, 2.0, [float(v) for v in x])], "trace_idx long, dt_ms double, samples array<double>")
    rows = [("W", 1, i, 2000.0 + i, float(loud[i]), float(-loud[i]) if i > 150 else None) for i in range(20, n - 20)]
    ctx = spark.createDataFrame(rows, "well_id string, trace_idx long, time_idx int, depth double, VSH double, PHIE double")
    both = context.method_correlation(ctx, spectral.matched_bands(traces, 3), ["VSH", "PHIE"])
    got = {r.curve: r for r in both.collect()}
    assert got["VSH"].cwt_r > 0.9 and got["VSH"].other_r > 0.8 and got["VSH"].cwt_n == n - 40
    assert got["PHIE"].cwt_r is None and got["PHIE"].other_n == 0 and got["VSH"].low_sample_warning
    mean = {r.curve: r for r in context.method_averages(both).collect()}
    assert mean["VSH"].n_wells == 1 and mean["PHIE"].n_wells == 0 and mean["PHIE"].cwt_r is None
