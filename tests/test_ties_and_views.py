"""Ties found again in planted data, ingest to kept tables, exports, and the errors of each."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators import context, models, spatial, spectral, ties, views
from lithos.plans import ingest, standins
from lithos.sources import las, segy
from lithos.sources.store import TableStore
from lithos.streaming import qc
from test_engine import LAS, segy_bytes


def planted(shift=12.0, frequency=24.0, seed=3):
    """A log of 1600 samples and two traces that are its synthetic, moved: of its reflectivity, and of its impedance on the time axis."""
    r = np.random.default_rng(seed)
    n, step = 1600, 2.0
    depth = 1000 + 0.15 * np.arange(n)
    layer = r.normal(0, 1, n)
    dt, rho = 90 + 4 * layer, 2.35 - 0.05 * layer
    twt = 2030 + np.concatenate([[0], np.cumsum(np.diff(depth) / 0.3048 * (dt[1:] + dt[:-1]))]) / 1000
    ai = rho / dt
    rc = np.diff(ai) / (ai[1:] + ai[:-1])
    mid = (twt[1:] + twt[:-1]) / 2
    axis = 2030 + step * np.arange(160)
    w = ties.ricker_array(frequency, step / 1000)
    traces = []
    times = np.arange(mid[0], mid[-1], step)
    for t, x in ((times, np.interp(times, mid, rc)), ties.time_reflectivity(twt, dt, rho, step)):
        full = np.convolve(x, w)
        at = (len(full) - len(t)) // 2
        out = np.interp(axis, t + shift, full[at : at + len(t)], left=0, right=0)
        traces.append(out + 0.02 * out.std() * r.standard_normal(160))
    return depth, dt, rho, twt, *traces


@pytest.fixture(scope="module")
def tables(spark):
    depth, dt, rho, twt, trace, other = planted()
    rows = [(w, i, *map(float, x)) for w in ("A", "B") for i, x in enumerate(zip(depth, dt, rho, twt))]
    logs = spark.createDataFrame(rows, "well_id string, row_idx long, DEPT double, DT double, RHOB double, DPTM double")
    traces = spark.createDataFrame([("S", 0, 1, 1, 0.0, 0.0, 2030.0, 2.0, [0.0] * 160), ("S", 5, 1, 2, 25.0, 0.0, 2030.0, 2.0, trace.tolist()), ("S", 6, 1, 3, 50.0, 0.0, 2030.0, 2.0, other.tolist())], "dataset_id string, trace_idx long, inline int, crossline int, tx double, ty double, delay_ms double, dt_ms double, samples array<double>")
    resolved = spark.createDataFrame([("A", 5), ("B", 0)], "well_id string, trace_idx long")
    return logs, traces, resolved


@pytest.mark.parametrize("search", ["local", "full"])
def test_synthetics_find_the_planted_shift(spark, tables, search):
    logs, traces, resolved = tables
    got = {r["well_id"]: r for r in ties.build_synthetics(logs, resolved, traces, search=search, max_shift=60.0).collect()}
    assert got["A"]["correlation"] > 0.9 and abs(got["A"]["shift_ms"] - 12) <= 2 and got["A"]["polarity"] == 1
    # a dead trace fits nothing
    assert got["B"]["error"] == "no overlap" if search == "full" else abs(got["B"]["correlation"]) < 0.3


def test_a_fixed_wavelet_and_tie_points(spark, tables):
    logs, traces, resolved = tables
    points = spark.createDataFrame([("A", 1000.0, 12.0), ("A", 1200.0, 12.0)], "well_id string, x double, y double")
    r = ties.build_synthetics(logs, resolved.where("well_id = 'A'"), traces, frequency=24.0, points=points).first()
    assert r["correlation"] > 0.9 and abs(r["shift_ms"]) <= 2
    with pytest.raises(ValueError):
        ties.build_synthetics(logs, resolved, traces, search="else")
    few = ties.build_synthetics(logs.where("row_idx < 5"), resolved, traces).collect()
    assert {x["error"] for x in few} == {"too few samples"}
    depth, dt, rho, twt, trace, _ = planted()
    rc = np.diff(rho / dt) / (rho[1:] / dt[1:] + rho[:-1] / dt[:-1])
    mid = (twt[1:] + twt[:-1]) / 2
    times = np.arange(mid[0], mid[-1], 2.0)
    found = ties.local_search(np.interp(times, mid, rc), times, 2030 + 2.0 * np.arange(160), trace, 2.0, fixed=-ties.ricker_array(24.0, 0.002))
    assert found[0] > 0.9 and found[1] is None and found[2] == -1 and abs(found[3] - 12) <= 2
    with pytest.raises(ValueError):
        ties.local_search(rc[:50], mid[:50], 2030 + 2.0 * np.arange(160), trace, 2.0, max_shift=-1.0)


def test_despiking_keeps_reflections_and_notices_when_nothing_is_left():
    x = np.random.default_rng(1).normal(0, 0.02, 200)
    x[50] = 3.0
    out = ties.despiked(x)
    assert out[50] == 0 and (np.delete(out, 50) == np.delete(x, 50)).mean() > 0.9
    alone = np.zeros(100)
    alone[7] = 1.0
    with pytest.raises(ValueError):
        ties.despiked(alone)


def test_direct_ties_are_anchored_by_checkshots(spark, tables):
    logs, traces, resolved = tables
    resolved = resolved.withColumn("trace_idx", F.when(F.col("well_id") == "A", 6).otherwise(0).cast("long"))
    plain = ties.direct_ties(logs, resolved, traces).where("well_id = 'A'").first()
    assert plain["tie_source"] == "statistical" and plain["correlation"] > 0.9 and abs(plain["shift_ms"] - 12) <= 2
    t0 = logs.where("well_id = 'A' AND row_idx = 0").first()
    shots = spark.createDataFrame([("A", float(t0["DEPT"]), float(t0["DPTM"]) + 10.0), ("A", 500.0, 1.0)], "well_id string, depth double, twt double")
    got = {r["well_id"]: r for r in ties.direct_ties(logs, resolved, traces, shots).collect()}
    assert got["A"]["tie_source"] == "checkshot" and abs(got["A"]["anchor_ms"] - 10) < 1e-6 and abs(got["A"]["shift_ms"] - 12) <= 2
    assert got["B"]["tie_source"] == "statistical_fallback" and got["B"]["error"] == "no overlap"


def test_densities(spark, tables):
    logs = tables[0].withColumn("VSH", F.lit(0.5)).withColumn("PHIE", F.lit(0.2))
    assert ties.densities(logs, "rhob").first()["density_note"] == "measured"
    assert ties.densities(logs, "rock_physics").first()["density"] == pytest.approx(0.8 * 2.6 + 0.2)
    assert ties.densities(logs, "gardner").first()["density_note"] == "calibrated"
    assert ties.densities(logs.where("row_idx < 9"), "gardner").first()["density_note"] == "textbook"
    none = logs.withColumn("RHOB", F.lit(None).cast("double"))
    assert ties.densities(none, "rhob").first()["density_note"] == "missing RHOB" and ties.densities(none, "gardner").first()["density_note"] == "textbook"
    with pytest.raises(ValueError):
        ties.densities(logs, "else")
    # the fit minimises the squares of the density itself
    _, dt, rho, *_ = planted()
    v = ties.FOOT * 1e6 / dt
    a, b = ties.fit_gardner(v, rho)
    cost = lambda a, b: float(((a * v**b - rho) ** 2).sum())
    assert all(cost(a, b) <= cost(a * (1 + x), b * (1 + y)) + 1e-12 for x in (-1e-3, 0, 1e-3) for y in (-1e-3, 0, 1e-3))


def test_matches_of_frequencies():
    low, high, f = context.band_match(2.0, 3, [5.0 * k for k in range(1, 21)])
    assert (low, high) == (31.25, 62.5) and f == 45.0
    assert context.frequency_match(22.5, 2.0, [20.0, 25.0], [1.0, 22.0]) == [20.0, 22.0]
    with pytest.raises(ValueError):
        context.frequency_match(251.0, 2.0, [1.0])


def test_wavelets_of_a_trace():
    w = ties.ricker_array(30.0, 0.002)
    t, x = spectral.statistical_wavelet(np.convolve(np.random.default_rng(2).standard_normal(400), w, "same"), 2.0)
    f, amplitude, phase = spectral.wavelet_spectrum(x, 2.0)
    assert x.max() == pytest.approx(1.0) and t[int(x.argmax())] == 0 and abs(f[amplitude.argmax()] - 30) < 12
    with pytest.raises(ValueError):
        spectral.statistical_wavelet(np.zeros(3), 2.0)


def test_tie_report_has_a_line_for_each_field_and_sample(spark):
    from lithos.operators import reports

    tie = spark.createDataFrame([("A", 0.5, 7)], "well_id string, correlation double, n long")
    samples = spark.createDataFrame([("A", 0, 1.0, 2.0, 3.0), ("A", 1, 2.0, None, 4.0)], "well_id string, i int, time_ms double, synthetic double, seismic double")
    got = [r["line"] for r in reports.tie_report(tie, samples).orderBy("k").collect()]
    assert got == ["# correlation,0.5", "# n,7", "time_ms,synthetic,seismic", "1.0,2.0,3.0", "2.0,,4.0"]


def test_segy_counts_without_sign_and_broken_files(spark, tmp_path):
    raw = bytearray(segy_bytes())
    n = 40_000
    struct.pack_into(">H", raw, 3220, n)
    struct.pack_into(">H", raw, 3216, 40_000)
    (tmp_path / "big.sgy").write_bytes(bytes(raw[:3600]) + b"".join(bytes(raw[3600 : 3600 + 240]) + struct.pack(f">{n}f", *([float(k)] * n)) for k in range(2)))
    spark.dataSource.register(segy.SegyDataSource)
    rows = spark.read.format("segy").load(str(tmp_path / "big.sgy")).selectExpr("trace_idx", "size(samples) AS n", "samples[39999] AS last", "dt_ms").orderBy("trace_idx").collect()
    assert [tuple(r) for r in rows] == [(0, n, 0.0, 40.0), (1, n, 1.0, 40.0)]
    (tmp_path / "cut.sgy").write_bytes(segy_bytes()[:-5])
    with pytest.raises(ValueError, match="whole traces"):
        segy.layout(str(tmp_path / "cut.sgy"))
    (tmp_path / "ok.segy").write_bytes(segy_bytes())
    plan = segy.layout(str(tmp_path / "ok.segy"))
    segy.check_first(str(tmp_path / "ok.segy"), plan, {"inline": 382, "crossline": 46, "source_x": 3630000, "source_y": 29498000})
    with pytest.raises(ValueError, match="disagrees"):
        segy.check_first(str(tmp_path / "ok.segy"), plan, {"inline": 1, "crossline": 46, "source_x": 3630000, "source_y": 29498000})
    assert segy.newest(spark, str(tmp_path)).endswith("ok.segy")


def test_wells_are_ingested_in_their_units(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = "\n".join(f"{1000 + 0.5 * k} {40 + k % 60} 10 {2.2 + 0.01 * (k % 20)} 0.2 {80 + k % 9}" for k in range(80))
    (tmp_path / "in" / "a.las").write_text(LAS.split("1000.0 50")[0] + body + "\n")
    metric = "\n".join(" ".join([*line.split()[:-1], str(float(line.split()[-1]) / 0.3048)]) for line in body.split("\n"))
    (tmp_path / "in" / "b.las").write_text(LAS.split("1000.0 50")[0].replace("DT.us/ft", "DT.us/m") + metric + "\n")
    (tmp_path / "in" / "bad.las").write_text("nothing")
    store = TableStore(spark, str(tmp_path / "store"))
    got = {r["well_id"]: r for r in ingest.ingest_wells(spark, str(tmp_path / "in"), store).collect()}
    assert set(got) == {"A", "B"} and got["A"]["mean_vsh"] == pytest.approx(got["B"]["mean_vsh"])
    dt = {r["well_id"]: r["m"] for r in store.get("wells").groupBy("well_id").agg(F.avg("DT").alias("m")).collect()}
    assert dt["B"] == pytest.approx(dt["A"], rel=1e-6) and store.one("heads", "well_id", "A").first()["td"] == pytest.approx(914.4)  # feet, as td is some 2.9 times the last depth
    units = {(r["well_id"], r["curve"]): r for r in store.get("units").collect()}
    assert len(units) == 8 and (units["B", "DT"]["unit"], units["B", "DT"]["converted"], units["B", "DT"]["inferred"]) == ("us_per_m", True, False)
    assert (units["A", "RHOB"]["unit"], units["A", "GR"]["unit"], units["A", "NPHI"]["unit"]) == ("g_cc", "api", "v_v") and not units["A", "DT"]["converted"]
    assert [(r["well_id"], r["error"]) for r in store.get("failures").collect()] == [("BAD", "missing curves: DEPT, GR, RESISTIVITY, RHOB, NPHI, DT")]
    q = qc.arriving_wells(spark, str(tmp_path / "in"), str(tmp_path / "streamed"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert TableStore(spark, str(tmp_path / "streamed")).get("wells").count() == 160


def test_a_survey_is_ingested_and_found_stale(spark, tmp_path):
    (tmp_path / "line.sgy").write_bytes(segy_bytes())
    store = TableStore(spark, str(tmp_path / "store"))
    assert ingest.is_stale(store, "LINE")
    s = ingest.ingest_seismic(spark, str(tmp_path / "line.sgy"), store).first()
    assert s["dataset_id"] == "LINE" and s["n_traces"] == 20 and 0 <= s["avg_vsh_proxy"] <= 1
    assert not ingest.is_stale(store, "LINE") and ingest.is_stale(store, "OTHER")


def test_calibrations_are_kept_and_fitted_anew(spark, sf, tmp_path):
    wells = standins.wells(spark, sf)
    survey = standins.traces(spark, sf)
    store = TableStore(spark, str(tmp_path / "store"))
    a = spatial.stored_fit(store, wells, survey, "v1").first()["a"]
    assert spatial.stored_fit(store, wells.limit(0), survey, "v1").first()["a"] == a
    assert spatial.stored_fit(store, wells.where("point_id < 6"), survey, "v2").first()["a"] != a
    with pytest.raises(KeyError, match="NOBODY"):
        spatial.fit_on(wells, spark.createDataFrame([("NOBODY",)], "well_id string"), survey)


def test_models_are_kept(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [("W", i, float(p), float(v), float(10 ** (3 * p)), float(10 ** (2 * p))) for i, (p, v) in enumerate(r.uniform(0.05, 0.3, (80, 2)))]
    d = spark.createDataFrame(rows, "well_id string, row_idx long, PHIE double, VSH double, PERM_TIXIER double, core double")
    assert "CORE_PERM_PRED" not in models.with_core_perm(d, str(tmp_path / "none")).columns
    models.save_model(models.train_core_perm(d, "core", trees=10), str(tmp_path / "model"))
    out = models.with_core_perm(d, str(tmp_path / "model"))
    assert out.select(F.corr("core", "CORE_PERM_PRED")).first()[0] > 0.9


def test_exports_and_records(spark, tmp_path):
    d = spark.createDataFrame([("A", 0, 1.5, None), ("A", 1, None, "x")], "well_id string, row_idx long, v double, t string")
    assert [r["line"] for r in views.csv_lines(d, "well_id", "row_idx", ["row_idx", "v", "t"], 2).orderBy("row_idx").collect()] == ["0,1.50,", "1,,x"]
    views.write_csv(d, str(tmp_path / "csv"), "well_id")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert views.csv_header(["a", "b"]) == "a,b" and {r["v"] for r in back.collect()} == {"1.5", None}
    cache = spark.createDataFrame([("A", "ready", "t1", None), ("B", "ready", "t1", None)], "key string, status string, run_token string, updated_at string")
    got = {r["key"]: r for r in views.started(cache, "A", "t2").collect()}
    assert got["A"]["status"] == "processing" and got["A"]["run_token"] == "t2" and got["B"]["status"] == "ready"
    assert abs((datetime.fromisoformat(got["A"]["updated_at"]) - datetime.now(datetime.fromisoformat(got["A"]["updated_at"]).tzinfo)).total_seconds()) < 120
    with pytest.raises(IndexError):
        from lithos.operators import seismic

        seismic.one_trace(standins.traces(spark, "/root/testdata/sf0.001"), "SURVEY", -1)
