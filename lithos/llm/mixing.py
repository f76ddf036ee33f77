"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document has the same expected number of copies, target words / source
words. The documents of a source stand in a fixed order (coarse size, then a hash of id and text), the
expected copies are summed along it, one offset of the source is added, and a document is emitted
once for every integer its own stretch of that sum crosses. Documents of like size stand together,
so the words taken come near the target as well as the copies do.

The sum along the order needs no window over a whole source: a source is cut into slices
(size class, leading bits of the hash), the slices are counted with a partial aggregation, a window
over the counts gives each slice its start, and only the documents of one slice are numbered
together. The slices of a size class grow in number with the corpus. Words are counted in one pass over
the texts, into a table without them; emit() joins the copies to the texts at the end.

Nulls: a null text has size 0; null sources are one source, ordered last. Documents of size 0 are
taken like the others of their source and add no words; a source without words has target 0 and
takes nothing. Repeated rows are separate documents. An empty table gives an empty mix. A column of
the input that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Rows that a slice of a source should hold about, and the size classes that share them.
SLICE_ROWS, CLASSES = 50_000, 40

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of each source, from rows (source, __size).

    Sources share `share` of all words by weight; a source stops at `most` times its own words and
    the rest is shared again by weight. The sources that stop are those with the least words for
    their weight, so one pass along that order finds where stopping ends. One row for each source:
    the windows over all of them see no documents.
    """
    per = sizes.groupBy(source).agg(F.sum("__size").alias("source_size"))
    k = len(weights)
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % k + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("__w"), F.col(source).asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    per = (
        per.withColumn("__total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("__wsum", F.sum("__w").over(everything))
        .withColumn("__before_s", F.sum("source_size").over(upto) - F.col("source_size"))
        .withColumn("__before_w", F.sum("__w").over(upto) - F.col("__w"))
        # the words for each unit of weight if all sources before this one have stopped
        .withColumn("__rate", (F.col("__total") - F.lit(most) * F.col("__before_s")) / (F.col("__wsum") - F.col("__before_w")))
        # this grows while sources stop and falls after that: its peak is the level of all that don't
        .withColumn("__level", F.max("__rate").over(everything))
    )
    stop = F.lit(most) * F.col("source_size")
    target = F.least(stop, F.col("__level") * F.col("__w"))
    return per.select(F.col(source).alias("__source"), "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """docs without the text, with size, source_size, target, copies and taken (= copies * size).

    copies is the number of times the mix holds the document; emit() repeats the rows. The result
    is a function of the rows alone, so reruns agree however Spark deals them.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    # md5 rather than a Spark hash: the same order can be written in any SQL; with the text, rows of one id are dealt, too
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    base = docs.select(*[c for c in docs.columns if c not in made and c != text], word_count(text).alias("size"), F.md5(own).alias("__h"))
    base = materialize(base)
    targets = source_targets(base.select(F.col(source), F.col("size").alias("__size")), source, weights, share, most)
    rows = base.count()
    digits = 1
    while 16**digits < rows / (slice_rows * CLASSES) and digits < 6:
        digits += 1
    base = base.withColumn("__class", F.length(F.bin("size")) * 4 + F.when(F.col("size") >= 4, F.substring(F.bin("size"), 2, 2).cast("int")).otherwise(0))
    base = base.withColumn("__slice", F.substring("__h", 1, digits))
    key = ["__source", "__class", "__slice"]
    base = base.withColumn("__source", F.col(source))
    slices = base.groupBy(*key).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__class", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("s.__source"), F.lit("null")))), 1, 7), 16, 10).cast("double") / float(16**7)
    s, t = slices.alias("s"), targets.alias("t")
    slices = s.join(t, F.col("s.__source").eqNullSafe(F.col("t.__source"))).select("s.__source", "__class", "__slice", "__start", "source_size", "target", offset.alias("__u"))
    b, p = base.alias("b"), slices.alias("p")
    joined = b.join(p, F.col("b.__source").eqNullSafe(F.col("p.__source")) & (F.col("b.__class") == F.col("p.__class")) & (F.col("b.__slice") == F.col("p.__slice")))
    joined = joined.select("b.*", "__start", "source_size", "target", "__u")
    within = Window.partitionBy(*key).orderBy("__h", F.col(id_col).asc_nulls_last(), "size")
    rank = F.col("__start") + F.row_number().over(within)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = joined.withColumn("__rank", rank).withColumn("__each", each)
    copies = (F.floor(F.col("__rank") * F.col("__each") + F.col("__u")) - F.floor((F.col("__rank") - 1) * F.col("__each") + F.col("__u"))).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__h", "__class", "__slice", "__source", "__start", "__u", "__rank", "__each")


def emit(docs: DataFrame, mixed: DataFrame, row: str) -> DataFrame:
    """The documents of a mix, each as many times as it is taken; row: a column that numbers the documents, written before, as a number that Spark computes anew may be another row's."""
    taken = mixed.where("copies > 0").select(row, F.col("copies").cast("int").alias("__copies"))
    return docs.join(taken, row).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same sums in DuckDB: the whole order of a source in one window.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
c AS (SELECT *, CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END AS bits FROM d),
e AS (SELECT *, length(bits) * 4 + CASE WHEN size >= 4 THEN CAST(substr(bits, 2, 2) AS INTEGER) ELSE 0 END AS class FROM c),
per0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
per1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM per0),
per2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total, sum(w) OVER () AS wsum,
  CAST(sum(source_size) OVER o AS BIGINT) - source_size AS before_s, sum(w) OVER o - w AS before_w
  FROM per1 WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
per3 AS (SELECT *, (total - 2.0::DOUBLE * before_s) / (wsum - before_w) AS rate FROM per2),
per4 AS (SELECT *, max(rate) OVER () AS level FROM per3),
per AS (SELECT source, source_size, CAST(least(2.0::DOUBLE * source_size, level * w) AS DOUBLE) AS target FROM per4),
r AS (SELECT e.doc_id, e.size, per.source_size, per.target,
  row_number() OVER (PARTITION BY e.source ORDER BY e.class, e.h, e.doc_id NULLS LAST, e.size) AS rnk,
  CASE WHEN per.source_size > 0 THEN per.target / per.source_size ELSE 0.0::DOUBLE END AS each_,
  CAST(('0x' || substr(md5('42:' || coalesce(e.source, 'null')), 1, 7)) AS BIGINT)::DOUBLE / 268435456.0::DOUBLE AS u
  FROM e JOIN per ON e.source IS NOT DISTINCT FROM per.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rnk * each_ + u) - floor((rnk - 1) * each_ + u)) * size AS BIGINT) AS taken
FROM r
"""
