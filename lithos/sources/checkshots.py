"""Checkshot workbooks (xlsx): a sheet for each well, two-way time in column C and depth in column E."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TIME, DEPTH = "C", "E"


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse(content: bytes) -> dict[str, list[tuple[float, float]]]:
    """{sheet: [(depth, time)]} in order of depth; rows without two numbers are left out. ValueError if nothing is left."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a workbook") from e
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in s.iter() if _plain(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _plain(s.tag) != "sheet":
            continue
        target = links[next(v for k, v in s.attrib.items() if _plain(k) == "id")].lstrip("/")
        points = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
            if _plain(row.tag) != "row" or row.get("r") == "1":
                continue
            got = {}
            for c in row:
                text = next((v.text for v in c.iter() if _plain(v.tag) in ("v", "t") and v.text), None)
                if text is not None:
                    got[re.sub(r"\d", "", c.get("r", ""))] = strings[int(text)] if c.get("t") == "s" else text
            try:
                points.append((float(got[DEPTH]), float(got[TIME])))
            except (KeyError, ValueError):
                continue
        if points:
            out[s.get("name")] = sorted(points, key=lambda p: p[0])
    if not out:
        raise ValueError("no sheet has rows with a time and a depth")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, depth, twt) of all workbooks of a folder; unreadable ones are left out."""

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                try:
                    rows = [(k, *p) for k, v in parse(content).items() for p in v]
                except ValueError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64()))], ["sheet", "depth", "twt"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInArrow(run, "sheet string, depth double, twt double")
