"""Batch loads: a folder of well files, or a seismic file, to kept tables and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators import cleaning, seismic, spectral, wells
from lithos.operators.petrophysics import interpretation
from lithos.plans.config import SEISMIC
from lithos.sources import las, segy
from lithos.sources.store import TableStore


def ingest_wells(spark: SparkSession, paths, store: TableStore) -> DataFrame:
    """Read, put units right, interpret and keep all wells of a folder or of a list of files; returns their summaries.

    Files are parsed once. Where each curve's unit comes from is kept as units; files that can't be used
    are kept, with the reason, as failures.
    """
    found = las.parsed(spark, paths).persist()
    try:
        logs = las.rows(found)
        units = cleaning.resolve_units(logs, las.declared(found), las.UNITS)
        store.save("units", units, "well_id")
        dt = store.get("units").where("curve = 'DT'").select("well_id", "unit")
        heads = las.heads_of(found)
        known = heads.where("error IS NULL").select("well_id", "well_name", "x", "y", "kb", "td", "stop")
        store.save("wells", interpretation(cleaning.normalise_dt(logs, dt)), "well_id")
        store.save("heads", cleaning.standardise_header(known), "well_id")
        bad = heads.where("error IS NOT NULL").select("well_id", "path", "error")
        if not bad.isEmpty():
            store.save("failures", bad, "well_id")
        ids = [r["well_id"] for r in known.select("well_id").limit(10_001).collect()]
        mine = store.get("wells")
        # few wells are named, so their partitions alone are read
        mine = mine.where(F.col("well_id").isin(ids)) if len(ids) <= 10_000 else mine.join(known.select("well_id"), "well_id", "left_semi")
        return wells.well_summary(mine)
    finally:
        found.unpersist()


def attributes(traces: DataFrame, config: dict = SEISMIC) -> DataFrame:
    """The attributes of every trace, with the proxies of its dataset."""
    keys = ["dataset_id", "trace_idx"]
    a = traces.select(*keys, seismic.rms().alias("rms_amplitude"))
    a = a.join(spectral.envelopes(traces), keys).join(seismic.dominant_frequency(seismic.spectrum(traces)), keys)
    return seismic.proxies(a, config)


def ingest_seismic(spark: SparkSession, path: str, store: TableStore, config: dict = SEISMIC) -> DataFrame:
    """Read SEG-Y (a file, a folder or several), keep traces and attributes; returns the summary of each dataset."""
    spark.dataSource.register(segy.SegyDataSource)
    store.save("traces", spark.read.format("segy").load(path), "dataset_id")
    mine = [segy.dataset_of(p) for p in segy.files_of(path)]
    store.save("attributes", attributes(store.get("traces").where(F.col("dataset_id").isin(mine)), config), "dataset_id")
    return seismic.summary(store.get("attributes").where(F.col("dataset_id").isin(mine)))


def is_stale(store: TableStore, active: str) -> bool:
    """Whether the kept traces are of another file than the active one."""
    kept = store.get("traces")
    return kept is None or kept.where(F.col("dataset_id") == active).isEmpty()
