"""Wells and traces made of the driver's tables by fixed arithmetic, for queries where no field data is at hand.

The SQL texts build the same rows in DuckDB, as common table expressions to begin a query with.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL = -9999.25
#: Rows of a well; the number of wells grows with the events.
WELL_ROWS = 700
#: Rows of logs in a task of the queries of ties in context, whatever the tables: few, so that 0.1 GB of tables fill the tasks of a cluster already.
TASK_ROWS = 1 << 15


def number(event):
    return F.floor(event / WELL_ROWS)


def numbers(spark, sf_dir: str) -> DataFrame:
    """(k, well_id, m): the number of each well, its name, and the number modulo 7."""
    k = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(number(F.col("event_id")).alias("k")).count().select("k")
    return k.select("k", F.concat(F.lit("W"), F.col("k").cast("string")).alias("well_id"), (F.col("k") % 7).alias("m"))


NUMBERS_SQL = "wn AS (SELECT k, 'W' || CAST(k AS VARCHAR) AS well_id, k % 7 AS m FROM (SELECT DISTINCT event_id // 700 AS k FROM events))"


def raw_logs(spark, sf_dir: str) -> DataFrame:
    """Wells of WELL_ROWS events each; every curve misses some rows (the header's null value)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    i = F.col("event_id")
    curve = lambda x, gap: F.when(i % gap == 0, F.lit(NULL)).otherwise(x)
    return e.select(
        F.concat(F.lit("W"), number(i).cast("string")).alias("well_id"), i.alias("row_idx"), (1000.0 + i % WELL_ROWS * 0.14).alias("DEPT"),
        curve(20.0 + (i * 7919 % 1009) * 0.1, 17).alias("GR"), curve(0.5 + (i * 613 % 1999) * 0.05, 31).alias("RESISTIVITY"),
        curve(2.0 + (i * 104729 % 997) * 0.001, 29).alias("RHOB"), curve((i * 31 % 449) * 0.001, 19).alias("NPHI"), curve(60.0 + (i * 271 % 601) * 0.1, 23).alias("DT"),
    )


RAW_SQL = """
raw AS (SELECT 'W' || CAST(event_id // 700 AS VARCHAR) AS well_id, event_id AS row_idx, 1000.0::DOUBLE + event_id % 700 * 0.14::DOUBLE AS DEPT,
  CASE WHEN event_id % 17 = 0 THEN -9999.25::DOUBLE ELSE 20.0::DOUBLE + (event_id * 7919 % 1009) * 0.1::DOUBLE END AS GR,
  CASE WHEN event_id % 31 = 0 THEN -9999.25::DOUBLE ELSE 0.5::DOUBLE + (event_id * 613 % 1999) * 0.05::DOUBLE END AS RESISTIVITY,
  CASE WHEN event_id % 29 = 0 THEN -9999.25::DOUBLE ELSE 2.0::DOUBLE + (event_id * 104729 % 997) * 0.001::DOUBLE END AS RHOB,
  CASE WHEN event_id % 19 = 0 THEN -9999.25::DOUBLE ELSE (event_id * 31 % 449) * 0.001::DOUBLE END AS NPHI,
  CASE WHEN event_id % 23 = 0 THEN -9999.25::DOUBLE ELSE 60.0::DOUBLE + (event_id * 271 % 601) * 0.1::DOUBLE END AS DT
  FROM events)"""

_no = "CASE WHEN abs({0} + 9999.25) <= 0.01 + 1e-5 * 9999.25 THEN NULL ELSE {0} END AS {0}"
LOGS_SQL = RAW_SQL + ",\nlogs AS (SELECT well_id, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS row_idx, DEPT, " + ", ".join(_no.format(c) for c in ("GR", "RESISTIVITY", "RHOB", "NPHI", "DT")) + " FROM raw)"


def logs(spark, sf_dir: str, wells: DataFrame | None = None) -> DataFrame:
    """The cleaned logs, of all wells or of those in a table with well_id (an id a well, sent to all tasks: the logs are not sorted for it), then dealt into parts()."""
    from lithos.operators.cleaning import clean

    raw = raw_logs(spark, sf_dir)
    return clean(raw if wells is None else raw.join(F.broadcast(wells.select("well_id")), "well_id", "left_semi").repartition(parts(spark, sf_dir), "well_id"))


def parts(spark, sf_dir: str) -> int:
    """Tasks for the logs, by their rows: adaptive execution goes by compressed bytes, and 64 MB may be millions of rows."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def traces(spark, sf_dir: str) -> DataFrame:
    """A survey from embeddings: a vector is a trace at 2 ms from 2030 ms; lines by label and id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    return e.select(
        F.lit("SURVEY").alias("dataset_id"), i.alias("trace_idx"), F.col("label").alias("inline"), F.floor(i / 10).cast("int").alias("crossline"),
        (1000.0 + 25.0 * (i % 50)).alias("tx"), (5000.0 + 25.0 * F.floor(i / 50)).alias("ty"), F.lit(2030.0).alias("delay_ms"), F.lit(2.0).alias("dt_ms"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


TRACES_SQL = """
traces AS (SELECT 'SURVEY' AS dataset_id, vec_id AS trace_idx, label AS inline, CAST(vec_id // 10 AS INTEGER) AS crossline,
  1000.0::DOUBLE + 25.0::DOUBLE * (vec_id % 50) AS tx, 5000.0::DOUBLE + 25.0::DOUBLE * (vec_id // 50) AS ty, 2030.0::DOUBLE AS delay_ms, 2.0::DOUBLE AS dt_ms,
  [CAST(x AS DOUBLE) FOR x IN embedding] AS samples FROM embeddings)"""


def wells(spark, sf_dir: str) -> DataFrame:
    """Well heads from suppliers; every thirteenth has no place."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    place = lambda x: F.when(k % 13 != 0, x)
    return s.select(F.concat(F.lit("S"), k.cast("string")).alias("well_id"), k.alias("point_id"), place(1000.0 + (k * 137 % 1250)).alias("wx"), place(5000.0 + (k * 89 % 260)).alias("wy"), (F.col("s_nationkey") * 0.02).alias("value"))


WELLS_SQL = """
wells AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS well_id, s_suppkey AS point_id,
  CASE WHEN s_suppkey % 13 <> 0 THEN 1000.0::DOUBLE + (s_suppkey * 137 % 1250) END AS wx,
  CASE WHEN s_suppkey % 13 <> 0 THEN 5000.0::DOUBLE + (s_suppkey * 89 % 260) END AS wy, s_nationkey * 0.02::DOUBLE AS value FROM supplier)"""


def muted(spark, sf_dir: str) -> DataFrame:
    """The survey with zeros at the top of each trace, every ninety-seventh trace dead, and no coordinates of the first kind."""
    t = traces(spark, sf_dir)
    i = F.col("trace_idx")
    quiet = F.transform("samples", lambda x, k: F.when((i % 97 == 0) | (k < i % 7 * 2), 0.0).otherwise(x))
    return t.withColumn("samples", quiet)


MUTED_SQL = TRACES_SQL + """,
muted AS (SELECT * REPLACE ([CASE WHEN trace_idx % 97 = 0 OR k - 1 < trace_idx % 7 * 2 THEN 0.0::DOUBLE ELSE samples[k] END FOR k IN range(1, len(samples) + 1)] AS samples) FROM traces)"""


def ties(spark, sf_dir: str) -> DataFrame:
    """Ties of the stand-in wells, good and bad: some are pinned, some have no correlation."""
    k, m = F.col("k"), F.col("m")
    return numbers(spark, sf_dir).select(
        "well_id", (10 * k + 1).alias("trace_idx"), (3.0 * m - 8.0).alias("shift_ms"),
        F.when(m != 5, F.round(0.9 - 0.13 * m, 2)).alias("correlation"), (m == 2).alias("boundary_pinned"),
    )


TIES_SQL = NUMBERS_SQL + """,
ties AS (SELECT well_id, CAST(10 * k + 1 AS BIGINT) AS trace_idx, 3.0::DOUBLE * m - 8.0::DOUBLE AS shift_ms,
  CASE WHEN m <> 5 THEN round(0.9::DOUBLE - 0.13::DOUBLE * m, 2) END AS correlation, m = 2 AS boundary_pinned FROM wn)"""


def tied(spark, sf_dir: str) -> DataFrame:
    """The well_ids of the ties whose trace there is: other wells are in no context, and their logs needn't be sorted for one."""
    return ties(spark, sf_dir).join(traces(spark, sf_dir).select("trace_idx"), "trace_idx", "left_semi").select("well_id")


def heads(spark, sf_dir: str) -> DataFrame:
    """Places of the stand-in wells; some have none and some are far away."""
    k, m = F.col("k"), F.col("m")
    far = F.when(m < 5, 30.0 * m + k % 10).otherwise(9000.0)
    return numbers(spark, sf_dir).select("well_id", k.alias("point_id"), F.when(m < 6, 1000.0 + 180.0 * m + k % 10).alias("wx"), (5000.0 + far).alias("wy"))


HEADS_SQL = """h AS (SELECT well_id, k AS point_id, CASE WHEN m < 6 THEN 1000.0::DOUBLE + 180.0::DOUBLE * m + k % 10 END AS wx,
  5000.0::DOUBLE + CASE WHEN m < 5 THEN 30.0::DOUBLE * m + k % 10 ELSE 9000.0::DOUBLE END AS wy FROM wn)"""


def tie_points(spark, sf_dir: str) -> DataFrame:
    """Three stretch points (x: depth, y: ms) of every second well."""
    j = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")
    return numbers(spark, sf_dir).where("k % 2 = 1").select("well_id", "m", j).select("well_id", (1000.0 + 10 * F.col("j")).alias("x"), (4.0 * F.col("j") - F.col("m")).alias("y"))


POINTS_SQL = "tp AS (SELECT well_id, 1000.0::DOUBLE + 10 * j AS kx, 4.0::DOUBLE * j - m AS y FROM wn, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS j) WHERE k % 2 = 1)"


def shots(spark, sf_dir: str) -> DataFrame:
    """Five checkshots of the other wells."""
    j = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")
    return numbers(spark, sf_dir).where("k % 2 = 0").select("well_id", "m", j).select("well_id", (998.0 + 1.5 * F.col("j") + F.col("m") * 0.1).alias("depth"), (2035.0 + 3.0 * F.col("j")).alias("twt"))


SHOTS_SQL = "sh AS (SELECT well_id, 998.0::DOUBLE + 1.5::DOUBLE * j + m * 0.1::DOUBLE AS depth, 2035.0::DOUBLE + 3.0::DOUBLE * j AS twt FROM wn, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS j) WHERE k % 2 = 0)"
