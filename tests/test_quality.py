"""Profiles of zeros by sums of arrays, and what is told of a survey's quality."""

import pytest

from lithos.operators import quality, seismic

SCHEMA = "dataset_id string, trace_idx long, inline int, crossline int, samples array<double>"


def test_zero_profile_of_unequal_and_missing_samples(spark):
    rows = [("A", 1, 1, 1, [0.0, 1.0, 0.0]), ("A", 2, 1, 2, [2.0, 0.0]), ("A", 3, 2, 1, [None, 0.0, 5.0, 0.0]), ("B", 1, 1, 1, [0.0]), ("B", 2, None, None, None), ("B", 3, 1, 3, []), (None, 9, 1, 1, [0.0, float("nan")])]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 4):
        got = {(r.dataset_id, r.sample_idx): r.zero_fraction for r in seismic.zero_profile(df.repartition(parts)).collect()}
        assert got == {("A", 0): 0.5, ("A", 1): pytest.approx(2 / 3), ("A", 2): 0.5, ("A", 3): 1.0, ("B", 0): 1.0, (None, 0): 1.0, (None, 1): 0.0}
    assert seismic.zero_profile(df.limit(0)).count() == 0
    plan = seismic.zero_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow")  # samples are exploded of sums alone


def test_verdicts(spark):
    def verdict(profile):
        return quality.mute_verdict(spark.createDataFrame([("A", i, p) for i, p in enumerate(profile)], "dataset_id string, sample_idx int, zero_fraction double")).first()

    assert verdict([0.30, 0.32, 0.31]).verdict == "constant"
    assert verdict([0.9, 0.5, 0.1]).verdict == "clears" and verdict([0.9, 0.5, 0.1]).clearest == 2
    assert verdict([0.1, 0.5, 0.1]).verdict == "mixed" and verdict([0.1, 0.5, 0.1]).clearest == 0
    rows = [("A", i, 10 + i // 4, 20 + i % 4, [0.0, 0.0] if i % 4 == 3 or i < 4 else [1.0, 0.0]) for i in range(16)] + [("DEAD", 1, 5, 6, [0.0]), ("DEAD", 2, 7, 8, None)]
    got = {r.dataset_id: r.asDict() for r in quality.footprint_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["A"]["n"], got["A"]["n_dead"], got["A"]["live_inline_min"], got["A"]["live_crossline_max"], got["A"]["crossline_max"]) == (16, 7, 11, 22, 23)
    assert got["DEAD"]["n_dead"] == 2 and got["DEAD"]["live_inline_min"] is None and got["DEAD"]["inline_max"] == 7
