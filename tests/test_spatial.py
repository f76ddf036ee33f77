"""Nearest without a radius and interpolation from wells, against all pairs in NumPy; what their plans may not hold."""

import numpy as np
import pytest

from lithos.operators import spatial

POINTS, TARGETS = "point_id long, px double, py double", "target_id long, tx double, ty double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def nearest(points, targets):
    t = [x for x in targets if x[1] is not None and x[2] is not None]
    xy = np.array([x[1:] for x in t], float).reshape(-1, 2)
    out = {}
    for i, x, y in points:
        if x is None or y is None or not t:
            out[i] = (None, None)
        else:
            d = np.sqrt((x - xy[:, 0]) ** 2 + (y - xy[:, 1]) ** 2)
            out[i] = min((float(v), k[0]) for v, k in zip(d, t))[::-1]
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "line", "one", "copies"])
def test_nearest_anywhere(spark, kind):
    r = np.random.default_rng(len(kind))
    if kind == "spread":
        xy = r.uniform(0, 5000, (3000, 2))
    elif kind == "clusters":
        xy = np.concatenate([c + r.standard_normal((700, 2)) * s for c, s in (((0, 0), 1), ((90_000, 10), 30), ((40_000, 70_000), 0.01))])
    elif kind == "line":
        xy = np.stack([np.arange(900.0), np.full(900, 7.0)], 1)
    elif kind == "one":
        xy = np.array([[5.0, 5.0]])
    else:
        xy = np.repeat(np.array([[0.0, 0.0], [10.0, 0.0], [20.0, 5.0]]), 400, 0)
    targets = [(int(i), *map(float, v)) for i, v in zip(r.permutation(len(xy)), xy)] + [(10**6, None, 1.0), (10**6 + 1, 2.0, None)]
    lo, hi = xy.min(0) - 100, xy.max(0) + 100
    points = [(i, *map(float, v)) for i, v in enumerate(r.uniform(lo, hi, (150, 2)))] + [(200, *map(float, xy[0])), (201, 1e7, -1e7), (202, None, 3.0), (203, -5e5, float(xy[:, 1].mean())), (204, 5.0, 0.0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spatial.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS))
        got = {r.point_id: (r.target_id, r.distance) for r in out.collect()}
        assert plan(out).count("NestedLoop") <= 1 and "Cartesian" not in plan(out)  # the top of the pyramid: sixteen boxes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = nearest(points, targets)
    assert set(got) == set(want)
    for k, (target, distance) in want.items():
        assert got[k][0] == target and (distance is None or got[k][1] == pytest.approx(distance, rel=1e-12)), (k, got[k], want[k])


def test_nearest_to_nothing(spark):
    p = spark.createDataFrame([(1, 2.0, 3.0)], POINTS)
    assert [tuple(r) for r in spatial.nearest(p, spark.createDataFrame([], TARGETS)).collect()] == [(1, None, None)]
    assert spatial.nearest(p.limit(0), spark.createDataFrame([(1, 1.0, 1.0)], TARGETS)).count() == 0


def test_a_point_holds_few_cells_at_every_level(spark):
    """Of 160,000 targets a point meets some hundreds at most, near or far."""
    targets = spark.range(160_000).selectExpr("id AS target_id", "CAST(id % 400 AS double) AS tx", "CAST(id DIV 400 AS double) AS ty")
    r = np.random.default_rng(4)
    points = [(i, *map(float, v)) for i, v in enumerate(r.uniform(-200, 600, (500, 2)))]
    near = spatial.nearest_anywhere(spark.createDataFrame(points, POINTS), targets)
    met = {x["point_id"]: x["count"] for x in near.groupBy("point_id").count().collect()}
    assert len(met) == 500 and max(met.values()) < 900 and np.mean(list(met.values())) < 150
    got = {x["point_id"]: x["d"] for x in near.groupBy("point_id").agg({"distance": "min"}).withColumnRenamed("min(distance)", "d").collect()}
    for i, x, y in points:
        a, b = np.clip(np.round([x, y]), 0, 399)
        assert got[i] == pytest.approx(np.hypot(x - a, y - b))


@pytest.mark.parametrize("small", [10**6, 0])
def test_idw(spark, monkeypatch, small):
    monkeypatch.setattr(spatial, "SMALL", small)
    monkeypatch.setattr(spatial, "WELLS", 16)
    monkeypatch.setattr(spatial, "CELLS", 64)
    r = np.random.default_rng(3)
    wells = [tuple(map(float, v)) for v in r.uniform(0, 100, (90, 3))]
    wells += [wells[0], (*wells[0][:2], 7.0), (None, 1.0, 5.0), (1.0, 1.0, None)]
    cells = [(f"c{i}", *map(float, v)) for i, v in enumerate(r.uniform(0, 100, (500, 2)))] + [("null", None, 1.0), ("on", *wells[0][:2])]
    out = spatial.idw(spark.createDataFrame(cells, "cell_id string, x double, y double").repartition(3), spark.createDataFrame(wells, "wx double, wy double, value double"))
    got = {r.cell_id: r.value for r in out.collect()}
    w = np.array([x for x in wells if None not in x])
    for i, x, y in cells:
        if x is None:
            assert got[i] is None
        else:
            k = np.maximum(np.hypot(x - w[:, 0], y - w[:, 1]), 1.0) ** -2
            assert got[i] == pytest.approx((k * w[:, 2]).sum() / k.sum(), rel=1e-9)
    assert len(got) == len(cells) and "NestedLoop" not in plan(out)
    assert spatial.idw(spark.createDataFrame(cells, "cell_id string, x double, y double"), spark.createDataFrame([], "wx double, wy double, value double")).where("value IS NOT NULL").count() == 0


def test_traces_of_wells_and_the_reason_there_is_none(spark):
    from lithos.operators import reports

    grid = [(i * 10 + j, float(100 + 25 * i), float(500 + 25 * j), 300 + i, 40 + j) for i in range(10) for j in range(10) if (i, j) != (3, 3)]
    traces = spark.createDataFrame(grid, "target_id long, tx double, ty double, inline int, crossline int")
    wells = spark.createDataFrame([("lo", 1, 0.0, 0.0), ("hi", 2, 90.0, 90.0), ("mid", 3, 50.0, 40.0), ("none", 4, None, 1.0), ("own", 5, None, None), ("gap", 6, 20.0, 20.0), ("line", 7, 20.0, 20.0)], "well_id string, point_id long, wx double, wy double")
    overrides = spark.createDataFrame([("own", 302, 44), ("gap", 303, 43), ("line", 399, 43)], "well_id string, inline int, crossline int")
    got = {r.well_id: (r.trace_idx, r.method, r.error) for r in reports.resolve_calibrated(wells, overrides, traces, 25.0).collect()}
    assert got["lo"] == (0, "calibrated_fit", None) and got["hi"] == (99, "calibrated_fit", None) and got["mid"][0] == 10 * round(50 / 10) + 4
    assert got["own"] == (24, "manual_override", None) and got["none"] == (None, None, "no coordinates")
    assert got["gap"] == (None, None, "no trace at the override") and got["line"] == (None, None, "override outside the survey")
    # one place alone can't be fitted: the nearest trace counts if the well is near the survey
    few = spark.createDataFrame([("at", 1, 151.0, 549.0), ("none", 2, None, None)], "well_id string, point_id long, wx double, wy double")
    far = spark.createDataFrame([("far", 1, 9e6, 549.0)], "well_id string, point_id long, wx double, wy double")
    assert {r.well_id: (r.trace_idx, r.method, r.error) for r in reports.resolve_calibrated(few, overrides, traces, 25.0).collect()} == {"at": (22, "direct_unvalidated", None), "none": (None, None, "no coordinates")}
    assert reports.resolve_calibrated(far, overrides, traces, 25.0).first().error == "outside the survey"
    # the fit on some wells marks those beyond them
    detail = {r.well_id: r for r in reports.calibration_details(wells, traces, overrides, 25.0, wells.where("well_id IN ('lo', 'mid')")).collect()}
    assert detail["lo"].used_in_fit and not detail["hi"].used_in_fit and detail["hi"].extrapolated and detail["gap"].has_override and detail["gap"].override_inline == 303
