"""Keyed tables in a folder: wells, traces, checkshots, calibrations, overrides, tie points, job records.

A table is Parquet partitioned by its key. Saving a key replaces its partition alone (dynamic
partition overwrite), so the wells of other runs are never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _there(self, table: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def save(self, table: str, df: DataFrame, key: str) -> None:
        """Replace the rows of every key value that df has."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(self.path(table))

    def get(self, table: str) -> DataFrame | None:
        """The whole table, NULL for columns that a partition lacks; None if nothing was saved."""
        return self.spark.read.option("mergeSchema", "true").option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(self.path(table)) if self._there(table) else None

    def one(self, table: str, key: str, value: str) -> DataFrame:
        """The rows of one key value (its partition alone is read); KeyError if there are none."""
        df = self.get(table)
        out = df.where(F.col(key) == value) if df is not None else None
        if out is None or out.isEmpty():
            raise KeyError(value)
        return out

    def keys(self, table: str, key: str) -> DataFrame:
        """The key values in order."""
        return self.get(table).select(key).distinct().orderBy(key)

    def delete(self, table: str, key: str, value: str) -> bool:
        """Drop one key's partition; False if it isn't there."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{key}={value}")
        return bool(target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def upsert_if_current(records: DataFrame, results: DataFrame) -> DataFrame:
    """Job records with the results whose run_token is still the record's; results of older runs are dropped.

    records, results: key, run_token, status, payload. A key has one record.
    """
    fresh = results.select("key", "run_token", F.col("status").alias("__s"), F.col("payload").alias("__p"))
    out = records.join(fresh, ["key", "run_token"], "left")
    return out.select("key", "run_token", F.coalesce("__s", "status").alias("status"), F.when(F.col("__s").isNotNull(), F.col("__p")).otherwise(F.col("payload")).alias("payload"))
