"""Balanced contiguous shards by global prefix sums of bytes, with DataFrame functions only.

The documents are put into one global order: by digest of the text, then by id. In that order the
prefix sum of sizes runs from 0 to the total, and equal targets, total * k / shards, cut it; a document
goes to the side of a cut where its middle lies, so each shard misses its target by half a document at
each end. Copies of a text stand together; a cut that would fall into a group of copies of at most
WHOLE of a shard moves to the nearer end of the group. Larger groups are cut.

No task sees more than one part of the order. Range partitioning makes the parts (a group that holds a
third of all rows is split by id and row number), each part is summed once with partial aggregation, a
window over the parts, one row each, gives every part its start, and a window within the part the rest.
Texts are read once; sorting moves only id, size and digests. The cuts, 3 numbers for each shard, go
through the driver.

Nulls: a null text counts as empty; null ids stand before others of their text. Repeated rows and
equal ids are documents of their own. A document larger than a shard's target leaves shards beside it
empty. An empty table gives no rows. A column of the input with the name of a result is replaced by it;
names that begin with two underscores are the operator's own, and such columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import materialize

SHARDS = 40
#: What a document takes besides its text.
OVERHEAD = 16
#: Rows of a part of the order, about.
PART_ROWS = 50_000
#: Groups of copies up to 1 / WHOLE of a shard are not cut.
WHOLE = 100

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """docs without the text, with size, text_crc32, law ("bytes"), shard, slot and grown_shard (null)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c != text and c not in MADE and not c.startswith("__")]
    base = docs.select(
        *kept,
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("__text"),
        F.monotonically_increasing_id().alias("__number"),
    )
    base = materialize(base)  # once: from here on a row has its number, whatever is computed anew
    parts = max(1, math.ceil(base.count() / part_rows))
    order = [F.col("__text"), F.col(id_col).asc_nulls_first(), F.col("__number")]
    placed = materialize(base.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))

    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, a row for each
    starts = placed.groupBy("__part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = starts.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("bytes", "rows")])
    within = Window.partitionBy("__part").orderBy(*order)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__bytes") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    row = F.col("__rows") + F.row_number().over(within) - 1
    told = placed.join(starts, "__part").select(*kept, "size", "text_crc32", "__text", start.alias("__start"), row.cast("long").alias("__row"))
    told = materialize(told)
    first = cuts(told, shards)
    shard = sum(((F.col("__row") >= c).cast("int") for c in first[1:]), F.lit(0))
    out = told.withColumn("law", F.lit("bytes")).withColumn("shard", shard)
    slot = F.col("__row") - F.element_at(F.array(*[F.lit(c).cast("long") for c in first]), F.col("shard") + 1)
    return out.withColumn("slot", slot.cast("long")).withColumn("grown_shard", F.lit(None).cast("int")).select(*kept, *MADE)


def cuts(told: DataFrame, shards: int) -> list[int]:
    """The number of the first row of each shard (of the next one that has rows, if it is empty)."""
    total = told.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [0] * shards
    plain = F.expr(f"least({shards - 1}L, (2 * __start + size) * {shards}L div {2 * total}L)").cast("int")
    borders = told.groupBy(plain.alias("shard")).agg(F.min(F.struct("__row", "__start", "__text")).alias("b")).select("shard", "b.*")
    at = {r["shard"]: r for r in borders.collect()}  # a row for each shard
    texts = told.sparkSession.createDataFrame([(t,) for t in {r["__text"] for r in at.values()}], "__text string")
    copies = told.join(F.broadcast(texts), "__text").groupBy("__text")  # the copies at the cuts: a text for each shard
    ends = copies.agg(F.min("__start").alias("lo"), F.max(F.col("__start") + F.col("size")).alias("hi"), F.min("__row").alias("first"), (F.max("__row") + 1).alias("after"))
    group = {r["__text"]: r for r in ends.collect()}
    out = [0]
    for k in range(1, shards):
        later = [s for s in at if s >= k]
        if not later:
            out.append(2**62)
            continue
        border = at[min(later)]
        g = group[border["__text"]]
        cut = border["__row"]
        if g["lo"] < border["__start"] and (g["hi"] - g["lo"]) * shards * WHOLE <= total:
            cut = g["first"] if 2 * total * k <= (g["lo"] + g["hi"]) * shards else g["after"]
        out.append(cut)
    return out


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """The documents as Parquet files below path/shard=k, each shard's rows in the order of slot (a column)."""
    rows = materialize(docs.withColumn("row_of_shards", F.monotonically_increasing_id()))
    place = assign(rows.select("row_of_shards", id_col, text), id_col, text, shards).select("row_of_shards", "shard", "slot")
    rows = rows.drop("shard", "slot").join(place, "row_of_shards").drop("row_of_shards")
    rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The same in DuckDB, with one window over all documents; the checksum by its table of 256 steps.
OP12_SQL = """
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, md5(text) AS m,
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes
  FROM d),
n AS (
  SELECT doc_id, size, m, xor(4294967295, list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc,
    row_number() OVER o - 1 AS row, CAST(sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM b, steps WINDOW o AS (ORDER BY m, doc_id NULLS FIRST)),
p AS (SELECT *, least(39, (2 * start + size) * 40 // (2 * total)) AS plain FROM n),
k AS (SELECT k, min(row) AS row FROM range(1, 40) r(k) JOIN p ON plain >= k GROUP BY k),
g AS (SELECT m, min(start) AS lo, max(start + size) AS hi, min(row) AS first, max(row) + 1 AS after FROM p GROUP BY m),
c AS (
  SELECT CASE WHEN lo < start AND (hi - lo) * 40 * 100 <= total
    THEN CASE WHEN 2 * total * k <= (lo + hi) * 40 THEN first ELSE after END ELSE p.row END AS cut
  FROM k JOIN p USING (row) JOIN g USING (m))
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law,
  CAST((SELECT count(*) FROM c WHERE cut <= p.row) AS INTEGER) AS shard,
  p.row - coalesce((SELECT max(cut) FROM c WHERE cut <= p.row), 0) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
