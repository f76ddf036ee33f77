"""Records of jobs by key, in versions: readers see one whole version, writers swap it.

A version is a small manifest that names the folder of each bucket of keys. A writer puts the buckets
that it changes into a new folder and then publishes the next manifest by renaming it to its number,
which the file system does for one writer only. Who comes second reads the new version and tries again.
A writer that dies leaves files that no manifest names; the version before stays whole.

Results carry the run_token of the run they come from and change a record only while it is that run's:
what an older run has to say about a key that was started anew is dropped. Batches of a stream are
numbered in the manifest, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Other writers were always first."""


class JobStore:
    def __init__(self, spark: SparkSession, folder: str, key: str = "well_id", buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    # files
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._system().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._system().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or a certain one."""
        have = self.versions()
        if not have:
            return {"version": 0, "buckets": {}, "batches": {}}
        version = have[-1] if version is None else version
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{version:020d}.json").first()[0])

    def _publish(self, manifest: dict) -> bool:
        """Whether this manifest became the version of its number."""
        jvm = self.spark.sparkContext._jvm
        temporary, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:020d}.json")
        out = self._system().create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(rename, 1)
        plain[0] = rename.NONE  # never over a file that is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, final, plain)
            return True
        except Exception as e:
            self._system().delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # reading
    def _read(self, manifest: dict, buckets=None) -> DataFrame | None:
        paths = [f"{self.folder}/{p}" for b, p in sorted(manifest["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def records(self, version: int | None = None) -> DataFrame | None:
        """All records of the newest version, or a certain one; None if there are none."""
        return self._read(self.manifest(version))

    def record(self, key: str) -> dict | None:
        """One record, from its bucket alone."""
        manifest = self.manifest()
        bucket = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
        rows = self._read(manifest, {bucket})
        row = rows.where(F.col(self.key) == key).first() if rows is not None else None
        return row.asDict() if row else None

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    # writing
    def start(self, keys: DataFrame, token: str) -> None:
        """A new record, processing, of this run for each key."""
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        self._update(keys.select("*", F.lit("processing").alias("status"), F.lit(token).alias("run_token"), now.alias("created_at"), now.alias("updated_at")), False)

    def put(self, records: DataFrame) -> None:
        """These records in place of those of their keys. A key has one record."""
        self._update(records, False)

    def finish(self, results: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """The results (key, run_token, some columns) in the records whose run they are of; False for a batch that was there before."""
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        return self._update(results.withColumn("updated_at", now), True, source, batch)

    def sink(self, source: str):
        """For foreachBatch: finish() with each batch of a stream, once."""
        return lambda results, batch: self.finish(results, source, batch) and None

    def _update(self, changed: DataFrame, of_the_run: bool, source: str | None = None, batch: int | None = None, tries: int = 20) -> bool:
        if source is not None and self.manifest()["batches"].get(source, -1) >= batch:
            return False
        name = f"data/{uuid.uuid4().hex}"
        changed.withColumn("__bucket", self._bucket(F.col(self.key))).write.parquet(f"{self.folder}/{name}-in")  # computed once, whatever is tried again
        changed = self.spark.read.parquet(f"{self.folder}/{name}-in")
        touched = {r[0] for r in changed.select("__bucket").distinct().collect()}  # BUCKETS numbers at most
        for k in range(tries):
            base = self.manifest()
            if source is not None and base["batches"].get(source, -1) >= batch:
                return False
            old = self._read(base, touched)
            after = self._merged(old, changed, of_the_run) if touched else None
            where = {}
            if after is not None:
                after.withColumn("__bucket", self._bucket(F.col(self.key))).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{name}-{k}")
                where = {str(b): f"{name}-{k}/__bucket={b}" for b in touched if self._system().exists(self._path(f"{name}-{k}/__bucket={b}"))}
            batches = base["batches"] | ({source: batch} if source is not None else {})
            if self._publish({"version": base["version"] + 1, "buckets": base["buckets"] | where, "batches": batches}):
                return True
        raise Conflict(f"version {base['version'] + 1} after {tries} tries")

    def _merged(self, old: DataFrame | None, changed: DataFrame, of_the_run: bool) -> DataFrame | None:
        changed = changed.drop("__bucket")
        if old is None:
            return None if of_the_run else changed
        if not of_the_run:
            return old.join(changed.select(self.key), self.key, "left_anti").unionByName(changed, allowMissingColumns=True)
        o, c = old.alias("o"), changed.withColumn("__hit", F.lit(True)).alias("c")
        both = o.join(c, [F.col(f"o.{x}") == F.col(f"c.{x}") for x in (self.key, "run_token")], "left")
        new = lambda x: F.when(F.col("c.__hit"), F.col(f"c.{x}")).otherwise(F.col(f"o.{x}") if x in old.columns else F.lit(None))
        return both.select(*[(new(x) if x in changed.columns else F.col(f"o.{x}")).alias(x) for x in [*old.columns, *[x for x in changed.columns if x not in old.columns]]])

    def vacuum(self, keep: int = 2) -> int:
        """Drop all versions but the last ones, and the data that none of those name; how many folders went. Not while others write."""
        have = self.versions()
        for v in have[:-keep]:
            self._system().delete(self._path(f"manifests/{v:020d}.json"), False)
        named = {p.split("/")[1] for v in have[-keep:] for p in self.manifest(v)["buckets"].values()}
        gone = [f.getPath() for f in self._system().listStatus(self._path("data")) if f.getPath().getName() not in named] if self._system().exists(self._path("data")) else []
        for path in gone:
            self._system().delete(path, True)
        return len(gone)
