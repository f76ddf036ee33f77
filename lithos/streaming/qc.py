"""Streams (beyond the batch engine): arriving well files, and windowed quality control of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files of one trigger: their names go through the driver.
FILES = 1000


def window_quality(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows, missing values and mean by time window and type; works on streams (with a watermark) and tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("n_missing"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "n_missing", "mean_value")


def arriving_wells(spark: SparkSession, folder: str, into: str, checkpoint: str):
    """Interpret every new .las file of a folder once and keep its well in a store; returns the running query."""
    from lithos.plans.ingest import ingest_wells
    from lithos.sources.store import TableStore

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[lL][aA][sS]").option("maxFilesPerTrigger", FILES).load(folder)

    def keep(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # FILES names at most
        if paths:
            ingest_wells(batch.sparkSession, paths, TableStore(batch.sparkSession, into))

    return files.select("path").writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
