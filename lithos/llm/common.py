"""Shared pieces of the training-data operators: scratch tables, text buffers, blocks of documents."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block, whatever the corpus.
BLOCK_BYTES = 4 << 20

#: The bytes between words.
WHITE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)

#: Shuffle files of a query go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: set[str] = set()
_tables: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, it is a temporary one in local mode (tests) and an error on a cluster."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lithos-scratch-")
        sc.setCheckpointDir(shared)
    return shared


@contextmanager
def freeing(spark: SparkSession):
    """What is written inside frees what it has shuffled as soon as it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it again: cuts the lineage, and frees what the write has shuffled."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lithos-{uuid.uuid4().hex}"
    with freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    _paths.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lithos_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lithos_path", None)
        if path:
            _delete(df.sparkSession, path)
        table = getattr(df, "_lithos_table", None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            _tables.discard(table)


@contextmanager
def collecting():
    """Names of the scratch tables that are made inside, for drop() once nothing reads them."""
    before = _paths | _tables
    made: list[str] = []
    try:
        yield made
    finally:
        made += sorted((_paths | _tables) - before)


def drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        if name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            _tables.discard(name)
        elif name in _paths:
            _delete(spark, name)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _paths.discard(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_paths):
        _delete(spark, path)
    for table in list(_tables):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def n_blocks(total_bytes: int, least: int = 24) -> int:
    return max(least, math.ceil(total_bytes / BLOCK_BYTES))


def place(id_col: str, text_col: str):
    """A hash of a row's id and text: null ids, and rows of one id, are dealt by their texts."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def block_of(h, blocks: int):
    """Blocks are ranges of the hash, so the order by hash is that by block and by hash within it."""
    top = F.shiftright(h, 33) + F.lit(1 << 30)  # 31 bits, so that the product stays within 64
    return F.shiftright(top * F.lit(blocks), 31).cast("int")


def block_table(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """docs with __place (unless they have it) and __block, as a table bucketed by the block: one shuffle, then every pass over the blocks reads it in place."""
    spark = docs.sparkSession
    name = f"lithos_tmp_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    _tables.add(name)
    _paths.add(path)
    buckets = min(blocks, 4096)
    rows = docs if "__place" in docs.columns else docs.withColumn("__place", place(id_col, text_col))
    rows = rows.withColumn("__block", block_of(F.col("__place"), blocks)).repartition(buckets, "__block")
    with freeing(spark):
        rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "__block").saveAsTable(name)
    out = spark.table(name)
    out._lithos_table, out._lithos_path = name, path
    return out


def in_order(table: pa.Table, id_col: str) -> pa.Table:
    """Rows by id, nulls first, then by the hash of id and text: the order within a block in every pass."""
    return table.take(pc.sort_indices(table, sort_keys=[(id_col, "ascending"), ("__place", "ascending")], null_placement="at_start"))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each begins; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int):
    """Runs [i, j) of documents of about size bytes, a longer document alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def segments(off: np.ndarray, size: int, overlap: int):
    """(lo, hi, off): runs of whole documents of about size units, or overlapping parts of a longer one.

    Every run of overlap + 1 units of a document begins in exactly one part and lies in it.
    """
    for i, j in chunks(off, size):
        lo, end = int(off[i]), int(off[j])
        if j - i > 1 or end - lo <= 2 * size + overlap:
            yield lo, end, off[i : j + 1] - lo
        else:
            for x in range(lo, max(end - overlap, lo + 1), size):
                hi = min(x + size + overlap, end)
                yield x, hi, np.array([0, hi - x])


def word_parts(data: np.ndarray, off: np.ndarray, size: int):
    """(i, j, data, off, ended): runs of whole documents of about size bytes, or parts of a longer one that end between words.

    ended: whether the part is the last of its document. A word longer than size stays whole.
    """
    for i, j in chunks(off, size):
        lo, end = int(off[i]), int(off[j])
        if j - i > 1 or end - lo <= 2 * size:
            yield i, j, data[lo:end], off[i : j + 1] - lo, True
            continue
        while lo < end:
            hi = lo + size
            while hi < end:
                white = np.flatnonzero(np.isin(data[hi : hi + 4096], WHITE))
                if len(white):
                    hi += int(white[0])
                    break
                hi += 4096
            hi = min(hi, end)
            yield i, j, data[lo:hi], np.array([0, hi - lo]), hi == end
            lo = hi
