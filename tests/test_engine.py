"""The engine on closed forms, planted data and files made here."""

import io
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lithos.functions.columns import clip, no_sentinel, pearson, ratio
from lithos.operators import cleaning, interpolation, models, petrophysics, seismic, spatial, spectral, ties, wells
from lithos.plans import catalog, config
from lithos.sources import checkshots, las, segy
from lithos.sources.store import TableStore, upsert_if_current
from lithos.streaming import qc

LOG = "well_id string, row_idx long, DEPT double, GR double, RESISTIVITY double, RHOB double, NPHI double, DT double"


def three_zones(n=200):
    r = np.random.default_rng(42)
    part = np.repeat([0, 1, 2], [60, 60, 80])
    at = lambda a, s: (np.array(a)[part] + np.array(s)[part] * r.standard_normal(n)).tolist()
    cols = at([30, 120, 25], [3, 5, 3]), at([5, 2, 80], [0.5, 0.3, 8]), at([2.25, 2.45, 2.15], [0.02] * 3), at([0.22, 0.30, 0.20], [0.01] * 3), at([85, 100, 80], [2] * 3)
    return [("W1", i, 1000 + 0.1524 * i, *(c[i] for c in cols)) for i in range(n)]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(three_zones(), LOG)


def test_every_query_runs_with_the_columns_of_its_sql(spark, sf):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_interpretation_separates_the_zones(logs):
    out = petrophysics.interpretation(logs)
    part = F.when(F.col("row_idx") < 60, 0).when(F.col("row_idx") < 120, 1).otherwise(2)
    m = {r[0]: r for r in out.groupBy(part).agg(F.avg("VSH"), F.avg("SWE")).collect()}
    assert m[0][1] < 0.15 and m[1][1] > 0.7 and m[2][2] < m[0][2]
    assert wells.zone_summary(out).count() == 3
    assert wells.well_summary(out).first()["footage"] == pytest.approx(199 * 0.1524)


def test_closed_forms(spark):
    row = lambda **x: {"well_id": "A", "row_idx": 0, "DEPT": 1.0, "GR": 50.0, "RESISTIVITY": 50.0, "RHOB": 2.2, "NPHI": 0.2, "DT": 100.0} | x
    c = config.merged(config.WELL, {"vsh": {"use_percentiles": False, "gr_clean_override": 20.0, "gr_shale_override": 100.0}})
    d = spark.createDataFrame([row(row_idx=i, GR=g) for i, g in enumerate((20.0, 40.0, 60.0, 80.0, 100.0))])
    for r in petrophysics.vsh(d, c).collect():
        assert r["VSH"] == pytest.approx(0.33 * (2 ** (2 * (r["GR"] - 20) / 80) - 1))
    d = spark.createDataFrame([row(PHIE=0.2), row(PHIE=0.0), row(PHIE=None, row_idx=2)], LOG + ", PHIE double")
    got = {r["PHIE"]: r["SWE"] for r in petrophysics.swe(d).collect()}
    assert got == {0.2: pytest.approx(math.sqrt(0.05 / (0.04 * 50))), 0.0: 1.0, None: 1.0}
    d = spark.createDataFrame([row(PHIE=0.2, SWE=0.25)])
    assert petrophysics.perm_tixier(d).first()["PERM_TIXIER"] == pytest.approx(250 * (0.008 / 0.25) ** 2)
    d = spark.createDataFrame([row(row_idx=i, DPTM=x) for i, x in enumerate((2100.0, None, None, None))], LOG + ", DPTM double")
    assert petrophysics.dptm(d, step=0.1524).where("row_idx = 0").first()["DPTM"] == pytest.approx(100 * 0.1524 / (2 * 3.28084e6))
    kept = config.merged(config.WELL, {"dptm": {"vendor_min_valid_fraction": 0.2}})
    assert petrophysics.dptm(d, kept, 0.1524).where("row_idx = 0").first()["DPTM"] == 2100.0
    d = spark.createDataFrame([row(RHOB=2.8, NPHI=0.05, GR=10.0), row(row_idx=1, RHOB=2.2, NPHI=0.25, GR=100.0)])
    assert [r["VVOLC"] for r in petrophysics.vvolc(d).orderBy("row_idx").collect()] == [pytest.approx(0.5), 0.0]


def test_missing_values_keep_their_rules(spark):
    d = spark.createDataFrame([("A", i, 1000.0 + i, None, None, None, None, None) for i in range(3)], LOG)
    r = petrophysics.interpretation(d).first()
    # a flat gamma ray has index 0, even where it is missing; saturation is 1, the rest missing or 0
    assert (r["VSH"], r["PHIT"], r["PHIE"], r["SWE"], r["PERM_TIXIER"], r["VVOLC"], r["ZONES"]) == (0.0, None, None, 1.0, 0.0, 0.0, 3)
    e = spark.createDataFrame([(None, 1.0), (5.0, 0.0), (-5.0, 2.0), (-9999.2, 1.0)], "x double, y double")
    got = e.select(clip("x", 0.0, 1.0), ratio("x", "y"), no_sentinel("x")).collect()
    assert [tuple(x) for x in got[:3]] == [(None, None, None), (1.0, None, 5.0), (0.0, -2.5, -5.0)] and got[3][2] is None
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(pearson("a", "b")).first()[0] is None


def test_cleaning(logs):
    assert cleaning.infer_unit(logs).first()["unit"] == "us_per_ft"
    metric = logs.withColumn("DT", F.col("DT") / 0.3048)
    u = cleaning.infer_unit(metric)
    assert u.first()["unit"] == "us_per_m"
    assert cleaning.normalise_dt(metric, u).agg(F.avg("DT")).first()[0] == pytest.approx(logs.agg(F.avg("DT")).first()[0])
    spiked = logs.withColumn("DT", F.when(F.col("row_idx") == 90, 300.0).otherwise(F.col("DT")))
    assert cleaning.washout(spiked).where("row_idx = 90").first()["washout"]
    # a dense region reaches the neutron limit nowhere near the ends by the sonic alone
    assert not cleaning.washout(logs.withColumn("DT", F.when(F.col("row_idx") == 0, 300.0).otherwise(F.col("DT")))).where("row_idx = 0").first()["washout"]


def test_calibration_and_prefixes(spark):
    w = spark.createDataFrame([("LOW", 0.0, 0.0), ("MID", 20.0, 15.0), ("HIGH", 40.0, 30.0), ("NONE", None, None)], "well_id string, wx double, wy double")
    t = spark.createDataFrame([(i, 366820.0 + 10 * (i % 5), 2950260.0 + 10 * (i // 5)) for i in range(20)], "target_id long, tx double, ty double")
    f = spatial.axis_fit(w, t).first()
    assert (f["n"], f["a"], f["c"]) == (3, 1.0, 1.0)
    assert spatial.axis_fit(w.limit(1), t).first()["a"] is None
    p = spark.createDataFrame([(1, 366821.0, 2950261.0), (2, 0.0, 0.0), (3, None, None)], "point_id long, px double, py double")
    got = {r["point_id"]: r["target_id"] for r in spatial.nearest(p, t, 150.0).collect()}
    assert got == {1: 0, 2: None, 3: None}
    assert {r["point_id"]: r["target_id"] for r in spatial.nearest(p, t).collect()} == {1: 0, 2: 0, 3: None}
    assert spatial.bin_spacing(t).first()[0] == 10.0
    s = spark.createDataFrame([("Z-02",), ("z-0",), ("Z-03_raw",)], "sheet string")
    n = spark.createDataFrame([("Z-02_RAW",), ("Z-03_RAW",), ("Z-04",)], "well_id string")
    assert {r[0]: r[1] for r in spatial.prefix_match(s, n).collect()} == {"Z-02_RAW": "Z-02", "Z-03_RAW": "Z-03_raw", "Z-04": None}


def test_interpolation_equals_numpy(spark):
    r = np.random.default_rng(0)
    x, y, ask = np.sort(r.uniform(0, 100, 50)), r.standard_normal(50), r.uniform(-20, 120, 300)
    k = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(x, y)] + [("A", 50.0, None), ("B", None, 1.0)], "k string, x double, y double")
    a = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(ask)] + [("C", 999, 1.0)], "k string, ask_id long, x double")
    for ends, out in (("clamp", {}), ("zero", {"left": 0.0, "right": 0.0}), ("null", {"left": np.nan, "right": np.nan})):
        got = {v["ask_id"]: v["value"] for v in interpolation.interpolate(a, k, ["k"], ends).collect()}
        for i, v in enumerate(np.interp(ask, x, y, **out)):
            assert (got[i] is None) if np.isnan(v) else got[i] == pytest.approx(v, abs=1e-9)


def test_transforms_find_a_tone():
    x = np.sin(2 * np.pi * 30 * np.arange(300) * 0.002)[None]
    f, w = spectral.cwt(x, 2.0)
    assert f[np.abs(w)[0, :, 150].argmax()] == 30
    f, _, e = spectral.stft(x, 2.0)
    assert abs(f[e[0, :, 5].argmax()] - 30) < 8 and e.max() == pytest.approx(0.5, abs=0.02)
    f, e = spectral.sswt(x, 2.0)
    assert abs(f[e[0, :, 150].argmax()] - 30) < 3
    _, env, inst = spectral.instantaneous(x, 2.0)
    assert env[0, 150] == pytest.approx(1, abs=0.02) and inst[0, 150] == pytest.approx(30, abs=0.5)
    for taps in spectral.FILTERS.values():
        t = np.array(taps)
        assert t.sum() == pytest.approx(2**0.5) and (t @ t) == pytest.approx(1) and abs(t[2:] @ t[:-2]) < 1e-9
    assert spectral.swt_details(x).shape == (1, 6, 300)


def test_planted_tie(spark):
    axis = np.arange(1900.0, 2300.0, 2.0)
    rc = np.zeros(60)
    rc[[10, 25, 40, 50]] = 0.1, -0.15, 0.08, -0.05
    trace = np.interp(axis - 12.0, 2000 + 2.0 * np.arange(60), np.convolve(rc, ties.ricker_array(24.0, 0.002, 0.072))[17:77], left=0, right=0)
    r, f, polarity, shift, n = ties.best_tie(2000 + 2.0 * np.arange(60), rc, axis, trace, 2.0)
    assert r > 0.9 and abs(shift - 12) <= 2 and polarity == 1
    ai = np.cumprod(np.concatenate([[5000.0], (1 + rc) / (1 - rc)]))
    logs = spark.createDataFrame([("A", i, 2000.0 + 2 * i, 100.0, float(a) / 50) for i, a in enumerate(ai)], "well_id string, row_idx long, DPTM double, DT double, RHOB double")
    traces = spark.createDataFrame([(7, 1900.0, 2.0, trace.tolist())], "trace_idx long, delay_ms double, dt_ms double, samples array<double>")
    resolved = spark.createDataFrame([("A", 7), ("B", 7), ("C", None)], "well_id string, trace_idx long")
    got = {x["well_id"]: x for x in ties.tie_wells(logs, resolved, traces).collect()}
    assert got["A"]["correlation"] > 0.9 and abs(got["A"]["shift_ms"] - 12) <= 2 and not got["A"]["boundary_pinned"]
    assert got["B"]["error"] == "too few samples" and got["C"]["error"] == "no trace"


def test_gardner_fit():
    v = np.linspace(2000, 5000, 80)
    a, b = ties.fit_gardner(v, 0.29 * v**0.26)
    assert a == pytest.approx(0.29, rel=1e-3) and b == pytest.approx(0.26, rel=1e-3)
    assert ties.fit_gardner(v[:10], v[:10]) is None


LAS = """~Version
VERS. 2.0 :
WRAP. NO :
~Well
STRT.m 1000 :
NULL. -9999.25 :
X.m 100.5 : easting
TD.m 3000 :
WELL. One :
~Curve
DEPTH.m : depth
GR.api :
RT.ohmm :
RHOB.g/cc :
NPHI.v/v :
DT.us/ft :
~ASCII
1000.0 50 10 2.2 0.2 80
1000.5 -9999.25 10 2.2 0.2 80
-9999.25 1 1 1 1 1
1001.0 60 11 2.3 0.1 90
"""


def test_las_files(spark, tmp_path):
    (tmp_path / "a-1.las").write_text(LAS)
    (tmp_path / "bad.LAS").write_text(LAS.replace("RHOB.g/cc :\n", ""))
    rows = las.read(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["GR"] for r in rows] == [50.0, None, 60.0] and {r["well_id"] for r in rows} == {"A-1"} and rows[0]["RESISTIVITY"] == 10.0
    h = las.heads(spark, str(tmp_path)).where("error IS NULL").first()
    assert (h["x"], h["td"], h["well_name"]) == (100.5, 3000.0, "One")
    own = {r["curve"]: r["declared"] for r in las.declared(las.parsed(spark, str(tmp_path))).where("well_id = '%s'" % h["well_id"]).collect()}
    assert las.UNITS[own["DT"].lower()] == "us_per_ft"
    assert [tuple(r)[0::2] for r in las.errors(spark, str(tmp_path)).collect()] == [("BAD", "missing curves: RHOB")]
    text = las.write(las.read(spark, str(tmp_path)), ["DEPT", "GR", "RESISTIVITY", "RHOB", "NPHI", "DT"]).first()["las"]
    _, again = las.load(text.encode())
    assert [r["GR"] for r in again] == [50.0, None, 60.0]


def segy_bytes(code=5):
    head = "C01 INLINE IS AT BYTE 9, CROSSLINE AT BYTE 13".ljust(3200).encode("cp037")
    binary = bytearray(400)
    struct.pack_into(">hhhhh", binary, 16, 2000, 0, 6, 0, code)
    out = [head, bytes(binary)]
    for i in range(20):
        h = bytearray(240)
        struct.pack_into(">ii", h, 8, 382 + i // 4, 46 + i % 4)
        struct.pack_into(">h", h, 70, -10)
        struct.pack_into(">ii", h, 72, 3630000 + 100 * i, 29498000)
        struct.pack_into(">h", h, 108, 2030)
        v = [math.sin(i + k) for k in range(6)]
        if code == 5:
            body = struct.pack(">6f", *v)
        else:
            body = b""
            for x in v:
                m, e = abs(x), 64
                while m >= 1:
                    m, e = m / 16, e + 1
                while 0 < m < 1 / 16:
                    m, e = m * 16, e - 1
                body += struct.pack(">I", (x < 0) << 31 | e << 24 | int(m * 2**24))
        out += [bytes(h), body]
    return b"".join(out)


@pytest.mark.parametrize("code", [5, 1])
def test_segy_files(spark, tmp_path, code):
    path = tmp_path / "line.sgy"
    path.write_bytes(segy_bytes(code))
    spark.dataSource.register(segy.SegyDataSource)
    d = spark.read.format("segy").option("traces", 6).load(str(path)).orderBy("trace_idx")
    rows = d.collect()
    assert len(rows) == 20 and rows[5]["inline"] == 383 and rows[5]["crossline"] == 47 and rows[0]["dt_ms"] == 2.0 and rows[0]["delay_ms"] == 2030.0
    assert rows[3]["samples"] == pytest.approx([math.sin(3 + k) for k in range(6)], abs=1e-6) and rows[1]["source_x"] == pytest.approx(363010.0)
    assert segy.coordinates(d).first()["ty"] == pytest.approx(2949800.0)
    assert seismic.survey_info(d).first()["n_inlines"] == 5 and seismic.coverage(d).count() == 0


def test_checkshot_workbook():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets><sheet name="Z-02" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        cell = lambda c, r, v: f'<c r="{c}{r}"><v>{v}</v></c>'
        rows = "".join(f'<row r="{r}">{cell("C", r, t)}{cell("E", r, d)}</row>' for r, t, d in ((1, 0, 0), (2, 900, 1000), (3, 500, 400), (4, "x", 1)))
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    assert checkshots.parse(b.getvalue()) == {"Z-02": [(400.0, 500.0), (1000.0, 900.0)]}
    with pytest.raises(ValueError):
        checkshots.parse(b"no")


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"))
    assert s.get("wells") is None
    s.save("wells", spark.createDataFrame([("A", 1), ("B", 2)], "well_id string, v int"), "well_id")
    s.save("wells", spark.createDataFrame([("B", 3)], "well_id string, v int"), "well_id")
    assert {(r["well_id"], r["v"]) for r in s.get("wells").collect()} == {("A", 1), ("B", 3)}
    assert s.delete("wells", "well_id", "A") and not s.delete("wells", "well_id", "A")
    with pytest.raises(KeyError):
        s.one("wells", "well_id", "A")
    records = spark.createDataFrame([("A", "t2", "processing", None)], "key string, run_token string, status string, payload string")
    late = spark.createDataFrame([("A", "t1", "ready", "old")], records.schema)
    now = spark.createDataFrame([("A", "t2", "ready", "new")], records.schema)
    assert upsert_if_current(records, late).first()["status"] == "processing"
    assert upsert_if_current(records, now).first()["payload"] == "new"


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = qc.window_quality(stream).writeStream.outputMode("complete").format("memory").queryName("quality").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(spark.table("quality").select("start", "event_type", "n")) == rows(qc.window_quality(table).select("start", "event_type", "n"))


def test_models(spark):
    r = np.random.default_rng(1)
    rows = []
    for w in range(4):
        x = r.standard_normal((30, 4))
        rows += [(f"W{w}", *map(float, v), float(5 * v[0] + 0.05 * e), float(v[0] + 1e-3 * e), 1.0) for v, e in zip(x, r.standard_normal(30))]
    s = spark.createDataFrame(rows, "well_id string, a double, b double, c double, d double, y double, near double, weight double")
    assert models.select_features(s, ["a", "b", "near"], "y", 2)[0] in ("a", "near") and not {"a", "near"} <= set(models.select_features(s, ["a", "b", "near"], "y"))
    out = models.property_model(s, ["a", "b"], "y", trees=15)
    assert out["status"] == "validated" and out["pooled"]["r2"] > 0.5 and out["importance"]["a"] > 0.8
    assert models.property_model(s.where("well_id = 'W0'"), ["a"], "y", trees=5)["status"] == "insufficient_data"
    got = models.blind_well(s, "W3", ["a", "b", "c"], "y", trees=10)
    assert got["status"] == "validated" and got["r2"] > 0.3
    assert models.blind_well(s, "NONE", ["a"], "y")["status"] == "blind_well_unusable"
    assert models.blind_well(s.where("well_id IN ('W0', 'W1', 'W3')"), "W3", ["a"], "y")["status"] == "insufficient_data"
