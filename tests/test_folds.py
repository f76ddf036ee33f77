"""Leave one well out by moments: what each fold's own fit gives, many wells in few jobs, no leakage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators import models


def planted(wells, n, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for w in range(wells):
        x = r.standard_normal((n, 3)) * [1.0, 50.0, 0.01] + [0.0, 1000.0, 5.0]
        out += [(f"W{w:04d}", i, *map(float, v), float(3 * v[0] - 0.02 * v[1] + 0.1 * e), float(r.uniform(0.5, 2))) for i, (v, e) in enumerate(zip(x, r.standard_normal(n)))]
    return out


SCHEMA = "well_id string, i long, a double, b double, c double, y double, weight double"


@pytest.mark.parametrize("weight", [None, "weight"])
def test_folds_are_the_fits_without_the_well(spark, weight):
    rows = planted(6, 40) + [("W0000", 99, None, 1.0, 1.0, 1.0, 1.0), ("W0001", 98, 1.0, float("nan"), 1.0, 1.0, 1.0), ("EMPTY", 0, 1.0, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("flat", F.lit(7.0))
    names = ["a", "b", "c", "flat"]
    got = {(r.well_id, r.i): r.prediction for r in models.leave_one_out_ridge(df, names, "y", 0.5, weight).collect()}
    good = [x for x in rows if None not in x and not np.isnan(x[3])]
    assert set(got) == {(x[0], x[1]) for x in good}
    for well in {x[0] for x in good}:
        train = np.array([x[2:] for x in good if x[0] != well])
        w = train[:, 4] if weight else np.ones(len(train))
        x, y = train[:, :3], train[:, 3]
        mean, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
        z = (x - mean) / sd
        slopes = np.linalg.solve((z * w[:, None]).T @ z / w.sum() + 0.5 * np.eye(3), (z * w[:, None]).T @ (y - my) / w.sum()) / sd
        for v in good:
            if v[0] == well:
                assert got[v[0], v[1]] == pytest.approx(my + (np.array(v[2:5]) - mean) @ slopes, rel=1e-6, abs=1e-6)


def test_five_hundred_wells_take_as_many_jobs_as_five(spark):
    jobs = []
    for wells in (5, 500):
        df = spark.createDataFrame(planted(wells, 12), SCHEMA).cache()
        df.count()
        group = f"folds-{wells}"
        spark.sparkContext.setJobGroup(group, group)
        out = models.skill(models.leave_one_out_ridge(df, ["a", "b", "c"], "y", 0.01), "y", ["well_id"]).collect()
        spark.sparkContext.setJobGroup("", "")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert len(out) == wells and np.median([r.r2 for r in out]) > 0.9
    assert jobs[1] <= jobs[0] + 2


def test_a_well_s_own_samples_never_reach_its_fit(spark):
    rows = planted(8, 20)
    spoiled = [(*x[:5], x[5] + 1e6 if x[0] == "W0003" else x[5], x[6]) for x in rows]
    a, b = ({r.well_id: r for r in models.fold_fits(spark.createDataFrame(d, SCHEMA), ["a", "b"], "y").collect()} for d in (rows, spoiled))
    assert a["W0003"].slopes == pytest.approx(b["W0003"].slopes, rel=1e-6) and a["W0001"].slopes != pytest.approx(b["W0001"].slopes, rel=1e-3)
    few = models.fold_fits(spark.createDataFrame(rows[:24], SCHEMA), ["a"], "y")  # of the second well four samples alone
    assert {r.well_id: r.slopes is None for r in few.collect()} == {"W0000": True, "W0001": False}
    assert models.leave_one_out_ridge(spark.createDataFrame([], SCHEMA), ["a"], "y").count() == 0
