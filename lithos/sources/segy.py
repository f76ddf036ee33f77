"""Seismic files (SEG-Y): a Python data source whose partitions are ranges of traces.

    spark.dataSource.register(SegyDataSource)
    spark.read.format("segy").option("inline", "107,110-112").load(path)

path: a file, a folder, or several of either with commas between. Textual headers are read once to
plan; traces of a file have one length, so every task seeks to its own. The options trace_idx, inline
and crossline take numbers and ranges: trace_idx chooses ranges of traces when planning, lines are
tested on the headers, and only traces that pass are read whole. option("samples", "false"): headers
alone, without the column of samples. Paths are local ones or URIs that pyarrow's file systems open.

Spark's own way for conditions (pushFilters) isn't used: in 4.1 a condition once pushed stays with the
relation, and a later query of the same DataFrame loses rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where the standard puts header fields (first byte, counted from 1).
STANDARD = {"inline": 189, "crossline": 193, "source_x": 73, "source_y": 77}
CDP_X, CDP_Y, SCALAR, DELAY = 181, 185, 71, 109
LENGTH, INTERVAL = 115, 117
#: First bytes of the four-byte fields of a trace header.
FIELDS = {1, 5, 9, 13, 17, 21, 25, 37, 41, 45, 49, 53, 57, 61, 65, 73, 77, 81, 85, 181, 185, 189, 193, 197}
ENCODINGS = ("cp037", "ascii", "latin-1")
PRINTABLE = set(range(0x20, 0x7F)) | {0x09, 0x0A, 0x0D}
TRACES = 4096
SCHEMA = "dataset_id string, trace_idx long, inline int, crossline int, cdp_x double, cdp_y double, source_x double, source_y double, delay_ms double, dt_ms double, samples array<double>"


def printable(text: str) -> float:
    return sum(ord(c) in PRINTABLE for c in text) / len(text) if text else 0.0


def decode_header(raw: bytes) -> tuple[str, str]:
    """(text, encoding): the encoding that gives most printable characters, the first of equals."""
    tries = [(raw.decode(e, "replace"), e) for e in ENCODINGS]
    return max(tries, key=lambda x: printable(x[0]))


def byte_locations(text: str) -> dict[str, int]:
    """Where the text says the fields are ("inline ... at byte 9"), else the standard's places."""
    out = dict(STANDARD)
    for name in out:
        words = r"\s*".join(name.split("_"))
        if m := re.search(rf"\b{words}\b[^0-9]{{0,40}}?\bat\b[^0-9]{{0,10}}(\d{{1,4}})", text, re.I):
            out[name] = int(m[1])
    wrong = {k: v for k, v in out.items() if v not in FIELDS}
    if wrong:
        raise ValueError(f"no trace header field begins at {wrong}")
    return out


def ibm(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floats (as big-endian 32-bit numbers) in double precision."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    return sign * (raw & 0xFFFFFF) / 2.0**24 * 16.0 ** (((raw >> 24) & 0x7F).astype(np.int64) - 64)


def system_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str):
    system, inner = system_of(path)
    return system.open_input_file(inner)


def files_of(paths: str) -> list[str]:
    """The files that a path, or several with commas between, names: of a folder, its .sgy and .segy files by name."""
    from pyarrow import fs

    out = []
    for path in paths.split(","):
        system, inner = system_of(path)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.extension.lower() in ("sgy", "segy"))
            out += [f"{path.rstrip('/')}/{n}" for n in names]
        else:
            out.append(path)
    return out


def dataset_of(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1]).upper()


def layout(path: str) -> dict:
    """What planning needs: sizes, format, sample interval, field places, number of traces."""
    with open_file(path) as f:
        size = f.size()
        raw = f.read(3600)
    if len(raw) < 3600:
        raise ValueError("shorter than its headers")
    two = lambda at: int.from_bytes(raw[3200 + at - 1 : 3200 + at + 1], "big")
    interval, samples, code = two(17), two(21), two(25)
    if code not in (1, 2, 3, 5, 8):
        raise ValueError(f"sample format {code}")
    if not samples:
        raise ValueError("traces without samples")
    width = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}[code]
    text, encoding = decode_header(raw[:3200])
    stride = 240 + samples * width
    if (size - 3600) % stride:
        raise ValueError(f"{size - 3600} bytes aren't whole traces of {stride}")
    return {"samples": samples, "code": code, "width": width, "dt_ms": interval / 1000.0, "stride": stride, "n": (size - 3600) // stride, "at": byte_locations(text), "encoding": encoding}


def check_first(path: str, plan: dict, row: dict) -> None:
    """ValueError if the first trace's header, read by itself, differs from what the read of the whole gave."""
    with open_file(path) as f:
        f.seek(3600)
        head = f.read(240)
    own = {k: int.from_bytes(head[at - 1 : at + 3], "big", signed=True) for k, at in plan["at"].items()}
    wrong = {k: (v, row[k]) for k, v in own.items() if v != row[k]}
    if wrong:
        raise ValueError(f"header of the first trace disagrees: {wrong}")


def newest(spark, folder: str) -> str | None:
    """The SEG-Y file of a folder that was changed last, by name among equals; None if there is none."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS]*[gG][yY]").load(folder).select("path", "modificationTime")
    best = files.where(F.lower("path").rlike(r"\.(sgy|segy)$")).agg(F.max(F.struct("modificationTime", "path"))["path"]).first()[0]
    return best


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, plan: dict):
        self.path, self.first, self.last, self.plan = path, first, last, plan


LINES = ("inline", "crossline")
#: Headers are read one by one if the samples between two of them are so many times longer.
APART = 4


def ranges(text: str) -> list[tuple[int, int]]:
    """First and last of each range of "7,10-12"; ValueError for anything else."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(-?\d+)\s*(?:-\s*(-?\d+)\s*)?", part)
        if not m:
            raise ValueError(f"{text!r} isn't made of numbers and ranges")
        out.append((int(m[1]), int(m[2] if m[2] is not None else m[1])))
    return out


class SegyReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"]
        self.each = int(options.get("traces", TRACES))
        self.samples = options.get("samples", "true").lower() != "false"
        self.chosen = {k: ranges(options[k]) for k in ("trace_idx", *LINES) if k in options}

    def passes(self, name: str, x: np.ndarray) -> np.ndarray:
        """Which numbers are chosen."""
        if name not in self.chosen:
            return np.ones(len(x), bool)
        return np.logical_or.reduce([(x >= lo) & (x <= hi) for lo, hi in self.chosen[name]])

    def partitions(self):
        out, empty = [], None
        for path in files_of(self.paths):
            plan = layout(path)
            empty = empty or Range(path, 0, 0, plan)
            for i in range(0, plan["n"], self.each):
                there = np.flatnonzero(self.passes("trace_idx", np.arange(i, min(i + self.each, plan["n"]))))
                if len(there):
                    out.append(Range(path, i + int(there[0]), i + int(there[-1]) + 1, plan))
        return out or ([empty] if empty else [Range("", 0, 0, {})])

    def read(self, part):
        if part.last == part.first:
            return
        p, n = part.plan, part.last - part.first
        stride, start = p["stride"], 3600 + part.first * p["stride"]
        field = lambda rows, at, kind=">i4": rows[:, at - 1 : at - 1 + int(kind[-1])].copy().view(kind)[:, 0]
        chosen = any(k in self.chosen for k in LINES)
        with open_file(part.path) as f:
            if (self.samples and not chosen) or stride < 240 * (1 + APART):
                f.seek(start)
                whole = np.frombuffer(f.read(n * stride), np.uint8).reshape(-1, stride)
                heads = whole[:, :240]
            else:
                whole, heads = None, np.empty((n, 240), np.uint8)
                for k in range(n):
                    f.seek(start + k * stride)
                    heads[k] = np.frombuffer(f.read(240), np.uint8)
            at = np.arange(part.first, part.last)
            lines = {k: field(heads, p["at"][k]) for k in LINES}
            keep = self.passes("trace_idx", at)
            for k in LINES:
                keep &= self.passes(k, lines[k])
            rows = np.flatnonzero(keep)
            check_uniform(heads[rows], p, field, part.first + rows)
            if part.first == 0 and 0 in rows:
                check_first(part.path, p, {k: int(field(heads[:1], p["at"][k])[0]) for k in STANDARD})
            heads = heads[rows]
            if self.samples and whole is None:
                # runs of neighbours are read together
                cut = np.flatnonzero(np.diff(rows) > 1) + 1
                parts = []
                for run in np.split(rows, cut) if len(rows) else []:
                    f.seek(start + int(run[0]) * stride)
                    parts.append(f.read(len(run) * stride))
                whole = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, stride)
            elif self.samples:
                whole = whole[rows]
        n = len(rows)
        scalar = field(heads, SCALAR, ">i2").astype(float)
        factor = np.where(scalar > 0, scalar, np.where(scalar < 0, 1.0 / np.where(scalar == 0, 1, np.abs(scalar)), 1.0))
        numbers = [field(heads, a) * factor for a in (CDP_X, CDP_Y, p["at"]["source_x"], p["at"]["source_y"])]
        numbers += [field(heads, DELAY, ">i2").astype(float), np.full(n, p["dt_ms"])]
        cols = [pa.array([dataset_of(part.path)] * n, pa.string()), pa.array(at[rows]), *[pa.array(lines[k][rows].astype(np.int32)) for k in LINES], *(pa.array(c.astype(np.float64)) for c in numbers)]
        if self.samples:
            kind = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[p["code"]]
            values = np.ascontiguousarray(whole[:, 240:]).view(kind)
            values = ibm(values.astype(np.uint32)) if p["code"] == 1 else values.astype(float)
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p["samples"]), pa.array(values.ravel().astype(np.float64))))
        yield pa.RecordBatch.from_arrays(cols, NAMES[: len(cols)])


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def check_uniform(heads: np.ndarray, plan: dict, field, at: np.ndarray) -> None:
    """ValueError if a trace says of itself that it has another length or interval than the file's."""
    for name, place, want in (("samples", LENGTH, plan["samples"]), ("interval", INTERVAL, round(1000 * plan["dt_ms"]))):
        said = field(heads, place, ">u2").astype(np.int64)
        odd = np.flatnonzero((said != 0) & (said != want))
        if len(odd):
            raise ValueError(f"{name} of trace {at[odd[0]]} is {said[odd[0]]}, of the file {want}")


class SegyDataSource(DataSource):
    @classmethod
    def name(cls):
        return "segy"

    def schema(self):
        return SCHEMA if self.options.get("samples", "true").lower() != "false" else SCHEMA.rsplit(", ", 1)[0]

    def reader(self, schema):
        return SegyReader(self.options)


def coordinates(traces):
    """traces with tx, ty: CDP coordinates unless they are all zero in the dataset, else the source's, else NULL."""
    from pyspark.sql import functions as F

    seen = traces.groupBy("dataset_id").agg(*[F.coalesce(F.max(F.greatest(F.abs(a), F.abs(b))) > 0, F.lit(False)).alias(n) for a, b, n in (("cdp_x", "cdp_y", "__c"), ("source_x", "source_y", "__s"))])
    t = traces.join(F.broadcast(seen), "dataset_id")
    pick = lambda k: F.when(F.col("__c"), F.col(f"cdp_{k}")).when(F.col("__s"), F.col(f"source_{k}"))
    return t.withColumn("tx", pick("x")).withColumn("ty", pick("y")).drop("__c", "__s")
