"""Well-log files (LAS 2.0): a file is one row of binaryFile, parsed where it is read.

parsed() gives a row for each file with all that is in it; rows(), heads_of() and declared() are its
curves, its head and the units that it declares, so a file is parsed once if parsed() is kept. read(),
heads() and errors() parse for themselves. One bad file never stops the others. write() makes LAS text
of a well.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL = -9999.25
# The names a curve or a header entry goes by, the first that is there counts.
CURVES = {
    "DEPT": ["DEPT", "DEPTH", "MD"],
    "GR": ["GR", "GRAY", "GAMMA"],
    "RESISTIVITY": ["RESISTIVITY", "RT", "RDEP", "RES_DEEP", "ILD", "LLD"],
    "RHOB": ["RHOB", "DEN", "RHOZ"],
    "NPHI": ["NPHI", "NEUT", "TNPH"],
    "DT": ["DT", "DTC", "AC"],
}
HEADER = {
    "x": ["XWELL", "XCOORD", "SURFACE_X", "SURX", "X"],
    "y": ["YWELL", "YCOORD", "SURFACE_Y", "SURY", "Y"],
    "kb": ["KB", "KBELEV", "KELLY_BUSHING", "EKB"],
    "td": ["TD", "TOTAL_DEPTH", "TDD", "TDL"],
}
# What declared units are called.
UNITS = {
    "us/f": "us_per_ft", "usec/f": "us_per_ft", "us/ft": "us_per_ft", "usec/ft": "us_per_ft", "us/m": "us_per_m", "usec/m": "us_per_m",
    "g/c3": "g_cc", "g/cc": "g_cc", "gm/cc": "g_cc", "gcc": "g_cc", "k/m3": "kg_m3", "api": "api", "gapi": "api",
    "v/v": "v_v", "frac": "v_v", "fraction": "v_v", "dec": "v_v", "vol/vol": "v_v",
}
LINE = re.compile(r"^\s*([^.\s]+)\s*\.(\S*)\s*(.*?)\s*(?::(.*))?$")
FIELDS = ("DEPT", "GR", "RESISTIVITY", "RHOB", "NPHI", "DT", "DPTM")


def number(x: str) -> float | None:
    try:
        v = float(x)
    except ValueError:
        return None
    return v if math.isfinite(v) else None


def parse(text: str) -> tuple[dict, list[tuple[str, str]], list[list[str]]]:
    """Header entries, (curve, unit) in order, and the rows of data as strings."""
    part, head, curves, rows, held, wrapped = "", {}, [], [], [], False
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("~"):
            part = line[1:2].upper()
            continue
        if part == "A":
            held += line.split()
            if not wrapped or len(held) >= len(curves):
                rows.append(held)
                held = []
        elif part in "VWC" and (m := LINE.match(line)):
            name, unit, value = m[1].upper(), m[2], m[3]
            if part == "C":
                curves.append((name, unit))
            elif part == "V" and name == "WRAP":
                wrapped = value.upper() == "YES"
            elif part == "W":
                head.setdefault(name, value)
    return head, curves, rows


def load(content: bytes) -> tuple[dict, list[dict]]:
    """The head of a well and its rows; ValueError says what is wrong with the file."""
    head, curves, rows = parse(content.decode("utf-8", "replace"))
    names = [c for c, _ in curves]
    at = {}
    for c, others in CURVES.items():
        found = next((a for a in others if a in names), None)
        if found is not None:
            at[c] = names.index(found)
    missing = [c for c in CURVES if c not in at]
    if missing:
        raise ValueError("missing curves: " + ", ".join(missing))
    if "DPTM" in names:
        at["DPTM"] = names.index("DPTM")
    null = number(head.get("NULL", "")) or NULL
    near = 0.01 + 1e-5 * abs(null)

    def value(row: list[str], c: str) -> float | None:
        v = number(row[at[c]]) if c in at and at[c] < len(row) else None
        return None if v is None or abs(v - null) <= near else v

    out = [{c: value(r, c) for c in FIELDS} for r in rows]
    out = [r for r in out if r["DEPT"] is not None]
    if not out:
        raise ValueError("no rows with a depth")
    wanted = {k: next((number(head[a].split()[0]) for a in aliases if head.get(a)), None) for k, aliases in HEADER.items()}
    declared = {c: curves[k][1].strip() or None for c, k in at.items()}
    return {"well_name": head.get("WELL", ""), "null_value": null, "stop": out[-1]["DEPT"], "declared": declared, **wanted}, out


HEAD = "well_name string, null_value double, x double, y double, kb double, td double, stop double, error string"
PARSED = f"well_id string, path string, {HEAD}, declared map<string,string>, " + ", ".join(f"{c} array<double>" for c in FIELDS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The .las files of a folder (not of those below it), or one file."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sS]").load(path)
    return f.select("path", F.upper(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)).alias("well_id"), "content")


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """PARSED: a row for each file, with error and no curves for one that can't be used."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches):
        for b in batches:
            for well, file, content in zip(*(b.column(c).to_pylist() for c in ("well_id", "path", "content"))):
                row = dict.fromkeys(schema.names) | {"well_id": well, "path": file}
                try:
                    head, rows = load(content)
                    row |= head | {"declared": list(head["declared"].items())} | {c: [r[c] for r in rows] for c in FIELDS}
                except ValueError as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files(spark, path).mapInArrow(run, PARSED)


def rows(parsed: DataFrame) -> DataFrame:
    """well_id, row_idx and the curves of all files that can be used."""
    flat = parsed.where("error IS NULL").select("well_id", F.posexplode(F.arrays_zip(*FIELDS)).alias("row_idx", "z"))
    return flat.select("well_id", F.col("row_idx").cast("long").alias("row_idx"), *[F.col(f"z.{c}").alias(c) for c in FIELDS])


def heads_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("well_id", "path", *[x.split()[0] for x in HEAD.split(", ")])


def declared(parsed: DataFrame) -> DataFrame:
    """(well_id, curve, declared): the units as the files have them; NULL for a curve without."""
    return parsed.where("error IS NULL").select("well_id", F.explode("declared").alias("curve", "declared"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(parsed(spark, path))


def heads(spark: SparkSession, path: str) -> DataFrame:
    return heads_of(parsed(spark, path))


def errors(spark: SparkSession, path: str) -> DataFrame:
    return heads(spark, path).where("error IS NOT NULL").select("well_id", "path", "error")


def las_text(name: str, curves: dict[str, list], step: float | None = None) -> str:
    """LAS 2.0 text of the numeric curves of one well, DEPT first."""
    depth = curves["DEPT"]
    show = lambda v: f"{NULL:.5f}" if v is None or not math.isfinite(v) else f"{v:.5f}"
    out = ["~Version", "VERS. 2.0 :", "WRAP. NO :", "~Well", f"STRT.m {show(depth[0])} :", f"STOP.m {show(depth[-1])} :", f"STEP.m {show(step)} :", f"NULL. {NULL} :", f"WELL. {name} :", "~Curve"]
    out += [f"{c}. :" for c in curves] + ["~ASCII"]
    return "\n".join([*out, *(" ".join(show(v) for v in row) for row in zip(*curves.values()))]) + "\n"


def write(logs: DataFrame, curves: list[str]) -> DataFrame:
    """(well_id, las): the text of every well of a table, each well in one group."""

    def run(key, table):
        t = table.sort_by("row_idx")
        return pa.table({"well_id": [key[0].as_py()], "las": [las_text(key[0].as_py(), {c: t[c].to_pylist() for c in curves})]})

    return logs.select("well_id", "row_idx", *[F.col(c).cast("double").alias(c) for c in curves]).groupBy("well_id").applyInArrow(run, "well_id string, las string")
