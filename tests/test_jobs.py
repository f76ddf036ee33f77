"""Job records in versions: races, dead writers, old runs, batches that come again; records of wells."""

import pytest
from pyspark.sql import functions as F

from lithos.operators import records
from lithos.sources.jobs import Conflict, JobStore


@pytest.fixture
def store(spark, tmp_path):
    return JobStore(spark, str(tmp_path / "jobs"), buckets=4)


def wells(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "well_id string")


def results(spark, token, *rows):
    return spark.createDataFrame([(w, token, "ready", v) for w, v in rows], "well_id string, run_token string, status string, tie_correlation double")


def by_well(store, version=None):
    return {r.well_id: r for r in store.records(version).collect()}


def test_only_the_current_run_changes_a_record(spark, store):
    assert store.records() is None and store.record("A") is None
    store.start(wells(spark, *"ABCDEFG"), "one")
    store.start(wells(spark, "B"), "two")
    store.finish(results(spark, "one", ("A", 0.5), ("B", 0.6), ("X", 0.7)))
    got = by_well(store)
    assert set(got) == set("ABCDEFG") and (got["A"].status, got["A"].tie_correlation) == ("ready", 0.5)
    assert (got["B"].status, got["B"].run_token, got["B"].tie_correlation) == ("processing", "two", None) and got["C"].status == "processing"
    store.finish(results(spark, "two", ("B", 0.9)))
    assert store.record("B")["tie_correlation"] == 0.9 and store.record("A")["tie_correlation"] == 0.5 and store.record("X") is None
    assert by_well(store, 1)["B"].run_token == "one"  # an older version is still whole
    assert len(store.versions()) == 4 and store.vacuum(1) > 0 and len(store.versions()) == 1
    assert store.record("B")["tie_correlation"] == 0.9 and len(by_well(store)) == 7


def test_of_two_racing_writers_the_second_tries_again(spark, store, monkeypatch):
    store.start(wells(spark, "A", "B"), "one")
    other = JobStore(spark, store.folder, buckets=4)
    real, raced = JobStore._publish, []

    def late(self, manifest):
        if self is store and not raced:
            raced.append(manifest["version"])
            other.start(wells(spark, "A"), "two")  # takes the version that this writer was about to publish
        return real(self, manifest)

    monkeypatch.setattr(JobStore, "_publish", late)
    store.finish(results(spark, "one", ("A", 0.1), ("B", 0.2)))
    got = by_well(store)
    assert raced == [2] and store.versions() == [1, 2, 3]
    assert (got["A"].run_token, got["A"].status, got["A"].tie_correlation) == ("two", "processing", None)  # the older run loses
    assert got["B"].tie_correlation == 0.2
    monkeypatch.setattr(JobStore, "_publish", lambda self, m: False)
    with pytest.raises(Conflict):
        store._update(wells(spark, "Z").withColumn("run_token", F.lit("t")), False, tries=2)


def test_a_writer_that_dies_leaves_the_version_before(spark, store, monkeypatch):
    store.start(wells(spark, "A"), "one")

    def die(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(JobStore, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        store.finish(results(spark, "one", ("A", 0.1)))
    monkeypatch.undo()
    assert store.record("A")["status"] == "processing" and store.versions() == [1]
    store.finish(results(spark, "one", ("A", 0.3)))
    assert store.record("A")["tie_correlation"] == 0.3


def test_a_stream_changes_records_once(spark, store, tmp_path):
    store.start(wells(spark, "A", "B"), "one")
    assert store.finish(results(spark, "one", ("A", 0.1)), "feed", 0) is True
    assert store.finish(results(spark, "one", ("A", 0.9)), "feed", 0) is False
    assert store.record("A")["tie_correlation"] == 0.1
    schema = "well_id string, run_token string, status string, tie_correlation double"
    results(spark, "one", ("A", 0.4), ("B", 0.5)).write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.foreachBatch(store.sink("files")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        stream.awaitTermination()
    assert store.record("A")["tie_correlation"] == 0.4 and store.record("B")["tie_correlation"] == 0.5
    assert store.manifest()["batches"] == {"feed": 0, "files": 0}


def test_answers_come_from_records_first(spark):
    schema = "well_id string, tie_available boolean, tie_error string, tie_correlation double"
    kept = spark.createDataFrame([("A", True, None, 0.5), ("B", False, "no trace", None)], schema)
    live = spark.createDataFrame([("A", True, None, 0.9), ("B", True, None, 0.8), ("C", False, "no overlap", None)], schema)
    got = {r.well_id: r for r in records.answered(kept, wells(spark, *"ABCD"), live, "tie").collect()}
    assert (got["A"].source, got["A"].tie_correlation) == ("record", 0.5) and (got["B"].source, got["B"].tie_correlation) == ("live", 0.8)
    assert (got["C"].source, got["C"].tie_error) == ("none", "no overlap") and got["D"].source == "none"
    new = records.new_records(wells(spark, "D"), "t").first()
    assert (new.status, new.run_token) == ("ready", "t") and new.created_at.endswith("+00:00")
