"""Choices that reach SEG-Y files: what is planned, how many bytes are read, many files, odd traces."""

import struct

import numpy as np
import pytest

from lithos.plans import ingest
from lithos.sources import segy
from lithos.sources.store import TableStore

SAMPLES = 500


def survey(lines=20, per_line=30, samples=SAMPLES, odd=None):
    """Traces of inlines 100.. and crosslines 200.., each with its number in all samples."""
    out = [b" " * 3200]
    head = bytearray(400)
    struct.pack_into(">hhhhh", head, 16, 2000, 0, samples, 0, 5)
    out.append(bytes(head))
    for i in range(lines * per_line):
        h = bytearray(240)
        struct.pack_into(">h", h, 114, samples)
        struct.pack_into(">h", h, 116, 4000 if i == odd else 2000)
        struct.pack_into(">ii", h, 188, 100 + i // per_line, 200 + i % per_line)
        out += [bytes(h), struct.pack(f">{samples}f", *([float(i)] * samples))]
    return b"".join(out)


@pytest.fixture
def counted(monkeypatch):
    """Bytes that a reader in this process reads."""
    total = [0]
    real = segy.open_file

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            total[0] += n
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

    monkeypatch.setattr(segy, "open_file", lambda path: Counting(real(path)))
    return total


def rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_a_line_costs_its_own_traces_and_the_headers(tmp_path, counted):
    path = tmp_path / "big.sgy"
    path.write_bytes(survey())
    every = 3600 + 600 * (240 + 4 * SAMPLES)
    got = rows(segy.SegyReader({"path": str(path), "traces": "100", "inline": "107"}))
    assert [r["trace_idx"] for r in got] == list(range(210, 240)) and all(r["samples"] == [float(r["trace_idx"])] * SAMPLES for r in got)
    assert counted[0] <= 3600 + 600 * 240 + 30 * (240 + 4 * SAMPLES) + 240 < 0.2 * every
    counted[0] = 0
    got = rows(segy.SegyReader({"path": str(path), "traces": "100", "trace_idx": "250-259"}))
    assert [r["trace_idx"] for r in got] == list(range(250, 260)) and counted[0] == 3600 + 10 * (240 + 4 * SAMPLES)
    counted[0] = 0
    got = rows(segy.SegyReader({"path": str(path), "traces": "100", "inline": "102, 104-105", "crossline": "229", "trace_idx": "0-149"}))
    assert [r["trace_idx"] for r in got] == [89, 149] and counted[0] <= 3600 + 150 * 240 + 2 * (240 + 4 * SAMPLES) + 240
    counted[0] = 0
    heads = rows(segy.SegyReader({"path": str(path), "samples": "false"}))
    assert len(heads) == 600 and "samples" not in heads[0] and counted[0] <= 3600 + 601 * 240


def test_choices_in_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.sgy").write_bytes(survey(4, 5, 8))
    (tmp_path / "in" / "two.SEGY").write_bytes(survey(3, 5, 300))
    (tmp_path / "in" / "notes.txt").write_text("no")
    spark.dataSource.register(segy.SegyDataSource)
    read = lambda **options: spark.read.format("segy").options(**options).load(str(tmp_path / "in"))
    d = read()
    assert d.count() == 35 and {tuple(r) for r in d.groupBy("dataset_id").count().collect()} == {("ONE", 20), ("TWO", 15)}
    assert d.where("inline = 101").count() == 10 and d.count() == 35
    for options, want in (({"inline": "101"}, 10), ({"inline": "100,103", "crossline": "203-900"}, 6), ({"trace_idx": "0-3"}, 8), ({"inline": "7"}, 0)):
        assert read(**options).count() == want, options
        assert read(**options, samples="false").count() == want
    with pytest.raises(ValueError):
        segy.ranges("7-")
    assert "samples" not in spark.read.format("segy").option("samples", "false").load(str(tmp_path / "in" / "one.sgy")).columns
    store = TableStore(spark, str(tmp_path / "store"))
    got = {r["dataset_id"]: r["n_traces"] for r in ingest.ingest_seismic(spark, f"{tmp_path}/in/one.sgy,{tmp_path}/in/two.SEGY", store).collect()}
    assert got == {"ONE": 20, "TWO": 15}


def test_traces_that_say_otherwise_are_an_error(spark, tmp_path):
    (tmp_path / "odd.sgy").write_bytes(survey(2, 5, 8, odd=7))
    with pytest.raises(ValueError, match="interval of trace 7 is 4000, of the file 2000"):
        rows(segy.SegyReader({"path": str(tmp_path / "odd.sgy")}))
    reader = segy.SegyReader({"path": str(tmp_path / "odd.sgy"), "inline": "100"})
    assert len(rows(reader)) == 5
    assert np.isclose(sum(r["dt_ms"] for r in rows(reader)), 10.0)
