"""Joins by place: nearest, within a radius, interpolation from wells to a grid, and calibration of axes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Wells that may be sent to every executor: 24 bytes each, so at most 24 MB.
SMALL = 1_000_000
#: Places in a cell of the finest level of a pyramid, about; levels whose cells may be sent to every executor (4 ** 6 of 60 bytes at most).
PER_CELL, SENT_LEVELS = 8, 6
#: Cells of a grid, and wells, that are taken together.
CELLS, WELLS = 2048, 1024


def within_radius(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """All pairs (point_id, target_id, distance) at most radius apart.

    Both sides are dealt into square cells of that side and a point looks into the nine cells around
    it: an equi-join on the cell, whatever the number of points.

    points: point_id, px, py; targets: target_id, tx, ty. Rows without a place join nothing.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = points.where("px IS NOT NULL AND py IS NOT NULL").select("point_id", "px", "py", around.alias("d"))
    p = p.select("point_id", "px", "py", (cell("px") + F.col("d.i")).alias("cx"), (cell("py") + F.col("d.j")).alias("cy"))
    t = targets.where("tx IS NOT NULL AND ty IS NOT NULL").select("target_id", "tx", "ty", cell("tx").alias("cx"), cell("ty").alias("cy"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("ty"), F.lit(2.0)))
    return p.join(t, ["cx", "cy"]).select("point_id", "target_id", d.alias("distance")).where(F.col("distance") <= radius)


def neighbours(points: DataFrame, targets: DataFrame, radius: float, most: int) -> DataFrame:
    """Up to `most` targets of each point within the radius, the nearest first, ties by id."""
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "target_id"))
    return within_radius(points, targets, radius).withColumn("rank", rank).where(F.col("rank") <= most)


def nearest(points: DataFrame, targets: DataFrame, radius: float | None = None) -> DataFrame:
    """(point_id, target_id, distance) of the nearest target, ties to the least id; NULLs if none is within the radius.

    Without a radius the point descends a pyramid of cells, however far away it is.
    """
    near = nearest_anywhere(points, targets) if radius is None else within_radius(points, targets, radius)
    best = near.groupBy("point_id").agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "b.target_id", "b.distance")


def squared(a, lo, hi):
    """Of a number and an interval: the squares of the distance, of that to the nearer end and of that to the farther end."""
    outside = F.greatest(lo - a, a - hi, F.lit(0.0))
    near, far = F.least(F.abs(a - lo), F.abs(a - hi)), F.greatest(F.abs(a - lo), F.abs(a - hi))
    return outside * outside, near * near, far * far


def nearest_anywhere(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(point_id, target_id, distance) of targets among which is the nearest of each point.

    Targets are put into cells, cells into cells of four times the side, and so on; each keeps the box
    around its targets. A point starts in the one cell at the top, and meets sixteen boxes. Each step joins its cells to the
    cells in them, by number, and keeps those that can't be excluded: as every side of a box has a
    target on it, the nearest one is no farther than the nearer side's farther corner. So a point holds
    few cells at every level, and meets the targets of the last ones alone.
    """
    places = targets.where("tx IS NOT NULL AND ty IS NOT NULL").groupBy("tx", "ty").agg(F.min("target_id").alias("target_id"))
    size = places.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in ("tx", "ty") for k, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    levels = 2 * math.ceil(max(0.0, math.log(max(size["n"], 1) / PER_CELL, 4)) / 2)
    side = 1 << levels
    edge = max(size["hitx"] - size["lotx"], size["hity"] - size["loty"]) / side if size["n"] else 0.0
    number = lambda c: F.least(F.lit(side - 1), F.floor((F.col(c) - size[f"lo{c}"]) / edge)).cast("long") if edge else F.lit(0).cast("long")
    places = places.withColumn("cx", number("tx")).withColumn("cy", number("ty"))

    here = points.where("px IS NOT NULL AND py IS NOT NULL").select("point_id", "px", "py").withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long"))
    own = Window.partitionBy("point_id", "px", "py")
    for level in range(2, levels + 1, 2):
        up = levels - level
        cell = [F.shiftright(c, up).alias(c) for c in ("cx", "cy")]
        boxes = places.groupBy(*cell).agg(*[f(c).alias(f"{k}{c}") for c in ("tx", "ty") for k, f in (("lo", F.min), ("hi", F.max))])
        boxes = boxes.select(F.shiftright("cx", 2).alias("ux"), F.shiftright("cy", 2).alias("uy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), "lotx", "hitx", "loty", "hity")
        boxes = F.broadcast(boxes) if level <= SENT_LEVELS else boxes
        met = here.join(boxes, (F.col("cx") == F.col("ux")) & (F.col("cy") == F.col("uy")))
        (out_x, near_x, far_x), (out_y, near_y, far_y) = (squared(F.col(p), F.col(f"lo{t}"), F.col(f"hi{t}")) for p, t in (("px", "tx"), ("py", "ty")))
        met = met.withColumn("least", out_x + out_y).withColumn("most", F.least(near_x + far_y, near_y + far_x))
        met = met.withColumn("bound", F.min("most").over(own)).where(F.col("least") <= F.col("bound") * (1 + 1e-9) + 1e-9)
        here = met.select("point_id", "px", "py", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("ty"), F.lit(2.0)))
    last = places if levels else F.broadcast(places)  # one cell: PER_CELL places at most
    return here.join(last, ["cx", "cy"]).select("point_id", "target_id", d.alias("distance"))


def bin_spacing(targets: DataFrame, sample: int = 200, radius: float | None = None) -> DataFrame:
    """The median distance from a sampled target to its nearest other one; the sample is by hash, so it repeats."""
    s = targets.orderBy(F.xxhash64("target_id"), "target_id").limit(sample).select(F.col("target_id").alias("point_id"), F.col("tx").alias("px"), F.col("ty").alias("py"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("ty"), F.lit(2.0)))
    near = targets.join(F.broadcast(s), F.col("point_id") != F.col("target_id")).groupBy("point_id").agg(F.min(d).alias("d"))
    return near.agg(F.percentile("d", F.lit(0.5)).alias("spacing"))


def idw(cells: DataFrame, wells: DataFrame, power: float = 2.0, floor: float = 1.0) -> DataFrame:
    """(cell_id, value): the mean of the wells' values, weighted by distance ** -power, at least `floor` apart.

    cells: cell_id, x, y (one without a place has no value); wells: wx, wy, value (those that lack one
    don't count). Every cell is a mean of all wells, so the work is cells times wells; it is done in
    arrays, a tile of cells against a tile of wells, and only sums leave a task: a row for each cell,
    or for each cell and tile of wells where there are too many wells (SMALL) to send around.
    """
    known = wells.where("wx IS NOT NULL AND wy IS NOT NULL AND value IS NOT NULL").groupBy("wx", "wy").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    count = known.count()
    tiles = max(1, math.ceil(count / WELLS))
    packed = known.groupBy(F.pmod(F.xxhash64("wx", "wy"), F.lit(tiles)).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("wx", "wy", "v", "n"))).alias("w"))
    packed = packed.select("tile", *[F.col(f"w.{c}").alias(c) for c in ("wx", "wy", "v", "n")])
    kind = cells.schema["cell_id"].dataType.simpleString()

    def pack(batches):
        for b in batches:
            for k in range(0, b.num_rows, CELLS):
                part = b.slice(k, CELLS)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, part.column(c)) for c in ("cell_id", "x", "y")], ["ids", "x", "y"])

    def sums(batches):
        held = None  # ids and sums of a tile of cells, while rows of the same come in
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column("ids").slice(k, 1).flatten()
                x, y, wx, wy, v, n = (b.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "wx", "wy", "v", "n"))
                d = np.maximum(np.hypot(x[:, None] - wx, y[:, None] - wy), floor) ** -power
                if held and held[0].equals(ids):
                    held[1] += d @ v
                    held[2] += d @ n
                else:
                    if held:
                        yield pa.RecordBatch.from_arrays([held[0], pa.array(held[1]), pa.array(held[2])], ["cell_id", "top", "bottom"])
                    held = [ids, d @ v, d @ n]
        if held:
            yield pa.RecordBatch.from_arrays([held[0], pa.array(held[1]), pa.array(held[2])], ["cell_id", "top", "bottom"])

    tiled = cells.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(pack, f"ids array<{kind}>, x array<double>, y array<double>")
    tiled = tiled.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    both = tiled.join(F.broadcast(packed) if count <= SMALL else packed, "tile").drop("tile")
    value = F.sum("top") / F.when(F.sum("bottom") > 0, F.sum("bottom"))
    return both.mapInArrow(sums, f"cell_id {kind}, top double, bottom double").groupBy("cell_id").agg(F.when(~F.isnan(value), value).alias("value"))


def axis_fit(wells: DataFrame, survey: DataFrame) -> DataFrame:
    """One row a, b, c, d with X = a x + b and Y = c y + d, from the ranges of both sides; NULL where wells are fewer than two or don't spread."""
    w = wells.where("wx IS NOT NULL AND wy IS NOT NULL").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in ("wx", "wy") for k, f in (("lo", F.min), ("hi", F.max))])
    s = survey.agg(*[f(c).alias(f"{k}{c}") for c in ("tx", "ty") for k, f in (("lo", F.min), ("hi", F.max))])
    ok = (F.col("n") >= 2) & (F.col("hiwx") > F.col("lowx")) & (F.col("hiwy") > F.col("lowy"))
    slope = lambda t, w_: F.when(ok, (F.col(f"hi{t}") - F.col(f"lo{t}")) / F.when(ok, F.col(f"hi{w_}") - F.col(f"lo{w_}")))
    both = w.join(s, F.lit(True)).withColumn("a", slope("tx", "wx")).withColumn("c", slope("ty", "wy"))
    return both.select("n", "a", (F.col("lotx") - F.col("a") * F.col("lowx")).alias("b"), "c", (F.col("loty") - F.col("c") * F.col("lowy")).alias("d"))


def unknown(asked: DataFrame, wells: DataFrame) -> DataFrame:
    """The well_ids asked for that no well has."""
    return asked.join(wells.select("well_id"), "well_id", "left_anti").select("well_id")


def fit_on(wells: DataFrame, chosen: DataFrame, survey: DataFrame) -> DataFrame:
    """axis_fit of the chosen wells (well_id); KeyError with some of the ids if any is unknown."""
    missing = [r["well_id"] for r in unknown(chosen, wells).limit(10).collect()]
    if missing:
        raise KeyError(", ".join(missing))
    return axis_fit(wells.join(chosen, "well_id", "left_semi"), survey)


def stored_fit(store, wells: DataFrame, survey: DataFrame, version: str) -> DataFrame:
    """The fit kept for this version of the survey, fitted anew and kept if there is none. store: sources.store.TableStore."""
    there = store.get("calibrations")
    if there is not None and not (kept := there.where(F.col("version") == version)).isEmpty():
        return kept
    store.save("calibrations", axis_fit(wells, survey).withColumn("version", F.lit(version)), "version")
    return store.one("calibrations", "version", version)


def calibrated(wells: DataFrame, fit: DataFrame) -> DataFrame:
    """wells with cx, cy under an axis fit (one row)."""
    return wells.join(F.broadcast(fit.select("a", "b", "c", "d")), F.lit(True)).withColumn("cx", F.col("a") * F.col("wx") + F.col("b")).withColumn("cy", F.col("c") * F.col("wy") + F.col("d")).drop("a", "b", "c", "d")


def resolve_trace(wells: DataFrame, overrides: DataFrame, traces: DataFrame, radius: float | None = None) -> DataFrame:
    """The trace of each well and how it was found: an override by line numbers, else the nearest one.

    wells: well_id, wx, wy; overrides: well_id, inline, crossline; traces: target_id, tx, ty, inline, crossline.
    """
    by_line = overrides.join(traces.select("target_id", "inline", "crossline"), ["inline", "crossline"]).groupBy("well_id").agg(F.min("target_id").alias("o"))
    near = nearest(wells.select(F.col("well_id").alias("point_id"), F.col("wx").alias("px"), F.col("wy").alias("py")), traces, radius).select(F.col("point_id").alias("well_id"), F.col("target_id").alias("n"), "distance")
    out = wells.select("well_id").join(by_line, "well_id", "left").join(near, "well_id", "left")
    method = F.when(F.col("o").isNotNull(), "override").when(F.col("n").isNotNull(), "nearest")
    return out.select("well_id", F.coalesce("o", "n").alias("trace_idx"), method.alias("method"), F.when(F.col("o").isNull(), F.col("distance")).alias("distance"))


def prefix_match(sheets: DataFrame, wells: DataFrame) -> DataFrame:
    """The sheet of each well: the same name, else the same but for case, else the longest name the well's begins with, up to a sign that isn't a letter or digit.

    sheets: sheet; wells: well_id. Both are cut at every such sign, so the join is on equal strings.
    """
    w = wells.select("well_id", F.explode(F.sequence(F.lit(1), F.length("well_id"))).alias("n"))
    w = w.where((F.col("n") == F.length("well_id")) | F.expr("substring(well_id, n + 1, 1)").rlike("[^A-Za-z0-9]")).select("well_id", "n", F.lower(F.expr("substring(well_id, 1, n)")).alias("key"))
    hit = w.join(sheets.select("sheet", F.lower("sheet").alias("key")), "key")
    order = [(F.col("sheet") == F.col("well_id")).desc(), F.desc("n"), F.asc("sheet")]
    best = hit.withColumn("k", F.row_number().over(Window.partitionBy("well_id").orderBy(*order))).where("k = 1").select("well_id", "sheet")
    return wells.select("well_id").join(best, "well_id", "left")
