"""Views and exports: display scales, labels, sorted tables, log tracks, crossplot presets, CSV and JSON lines, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.columns import is_true
from lithos.operators.seismic import rms

# The crossplots offered, as x, y, colour and the axes that are logarithmic.
CROSSPLOTS = {
    "neutron_density": ("NPHI", "RHOB", "VSH", ""),
    "pickett": ("RESISTIVITY", "PHIE", "ZONES", "xy"),
    "porosity_permeability": ("PHIE", "PERM_TIXIER", "ZONES", "y"),
    "shale_depth": ("VSH", "DEPT", "ZONES", ""),
    "porosity_depth": ("PHIE", "DEPT", "ZONES", ""),
}
GOOD, FAIR, LOW = 0.7, 0.4, 0.3


def preset(df: DataFrame, name: str) -> DataFrame:
    """(well_id, row_idx, x, y, color) of a preset; on a logarithmic axis values that aren't positive have no place, and their rows go."""
    x, y, color, logs = CROSSPLOTS[name]
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    value = {}
    for axis, c in (("x", x), ("y", y)):
        v = F.col(c).cast("double")
        if axis in logs:
            d = d.where(v > 0)
            v = F.log10(v)
        value[axis] = v
    return d.select("well_id", "row_idx", value["x"].alias("x"), value["y"].alias("y"), F.col(color).cast("double").alias("color"))


def rms_scaled(traces: DataFrame) -> DataFrame:
    """Samples over their root mean square, which counts as 1 where it is next to nothing."""
    r = rms()
    floor = F.when(is_true(r > 1e-12), r).otherwise(1.0)
    return traces.withColumn("__r", floor).withColumn("samples", F.transform("samples", lambda x: x / F.col("__r"))).drop("__r")


def unit_scaled(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with scaled: a value between the least and the largest of its keys, as 0 to 1; 0.5 where they are equal. Two numbers a group, joined back."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    scaled = F.when(F.col(value).isNull(), None).when(span > 0, (F.col(value) - F.col("__lo")) / F.when(span > 0, span)).otherwise(0.5)
    return df.join(ends, keys).withColumn("scaled", scaled).drop("__lo", "__hi")


def labelled(ties: DataFrame) -> DataFrame:
    """Ties with label (good, marginal, poor, unknown) and low_confidence; an unknown correlation is of low confidence only if pinned."""
    c = F.col("correlation")
    label = F.when(c.isNull(), "unknown").when(c >= GOOD, "good").when(c >= FAIR, "marginal").otherwise("poor")
    return ties.withColumn("label", label).withColumn("low_confidence", is_true(F.col("boundary_pinned")) | is_true(c < LOW))


def ranked(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """df (a row for each well) with rank by a column; missing values are last in both directions, ties by well."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, "well_id")))


def best_tie(ties: DataFrame) -> DataFrame:
    """The well with the largest correlation."""
    return ties.where("correlation IS NOT NULL").orderBy(F.desc("correlation"), "well_id").limit(1)


def on_map(ties: DataFrame, wells: DataFrame) -> DataFrame:
    """Wells with a place and a tie."""
    return wells.where("wx IS NOT NULL AND wy IS NOT NULL").join(ties.where("correlation IS NOT NULL").select("well_id", "correlation"), "well_id")


def mean_of_means(summaries: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean over datasets of each mean that isn't missing."""
    return summaries.agg(*[F.avg(c).alias(c) for c in columns])


def tracks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(well_id, row_idx, DEPT, track, value) of columns of any type; what is no number is NULL."""
    cells = F.array(*[F.struct(F.lit(c).alias("track"), F.expr(f"try_cast(`{c}` AS double)").alias("value")) for c in columns])
    return df.select("well_id", "row_idx", "DEPT", F.explode(cells).alias("t")).select("well_id", "row_idx", "DEPT", "t.*")


def csv_lines(df: DataFrame, key: str, order: str, columns: list[str], digits: int = 4) -> DataFrame:
    """(key, order, line): a comma-separated line for each row, numbers with `digits` decimals and nothing for NULL. The header is csv_header()."""
    types = dict(df.dtypes)
    text = lambda c: F.format_string(f"%.{digits}f", F.col(c)) if types[c] in ("double", "float") else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNull(), "").otherwise(text(c)) for c in columns]
    return df.select(key, order, F.concat_ws(",", *cells).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join(columns)


def write_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV files with a header, in a folder for each value of key if one is given."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(key) if key else w).csv(path)


def json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(well_id, row_idx, json): a record for each row, null for what is missing."""
    return df.select("well_id", "row_idx", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json_lines(df: DataFrame, schema: str) -> DataFrame:
    return df.select("well_id", "row_idx", F.from_json("json", schema).alias("j")).select("well_id", "row_idx", "j.*")


def cached(keys: DataFrame, cache: DataFrame, computed: DataFrame) -> DataFrame:
    """(key, value, error, source) of each key: the cached record if it is ready or failed, else what was computed, else an error.

    cache: key, status ("ready", "error", "processing"), value, error; computed: key, value.
    """
    c = cache.select("key", "status", F.col("value").alias("__v"), F.col("error").alias("__e"))
    d = keys.join(c, "key", "left").join(computed.select("key", F.col("value").alias("__n")), "key", "left")
    hit = is_true(F.col("status").isin("ready", "error"))
    value = F.when(hit, F.col("__v")).otherwise(F.col("__n"))
    error = F.when(hit, F.col("__e")).when(F.col("__n").isNull(), "not available")
    source = F.when(hit, "cache").when(F.col("__n").isNotNull(), "live").otherwise("none")
    return d.select("key", value.alias("value"), error.alias("error"), source.alias("source"))


def write_back(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """The cache with what was computed live; a record that is still processing gives way to it."""
    live = answered.where("source = 'live'").select("key", F.lit("ready").alias("status"), "value", F.lit(None).cast("string").alias("error"))
    return cache.join(live, "key", "left_anti").unionByName(live)


def started(cache: DataFrame, key: str, token: str) -> DataFrame:
    """The cache with a record of an upload that has begun (run_token tells this run from others) in place of the key's."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    new = cache.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit("processing").alias("status"), F.lit(token).alias("run_token"), now.alias("updated_at"))
    return cache.where(F.col("key") != key).unionByName(new, allowMissingColumns=True)
