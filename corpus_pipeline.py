"""The corpus pipeline: five stages over documents, each written and read again before the next.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents; further columns of docs are left out, whatever their names.
The stages decide by row: null ids, and ids that several rows have, are rows like others. An empty
table gives an empty one.

What a stage returns is to be written before the thread runs the next stage, which deletes the
scratch tables of the one before, unless its docs still read them.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm import kneser_ney, mixing, near_copies, packing, rlz_dedup
from lithos.llm.common import collecting, drop, materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_thread = threading.local()


def stage(f):
    """A stage first drops what earlier stages of this thread left in the scratch folder, but for what docs reads."""

    @wraps(f)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = getattr(_thread, "scratch", [])
        files = docs.inputFiles() if left else []
        if not any(name.rsplit("/", 1)[-1] in file for name in left for file in files):
            drop(spark, left)
            left = []
        with collecting() as made:
            out = f(spark, docs.select(*COLUMNS), sf_dir)
        _thread.scratch = [*left, *made]
        return out

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with __row, a number of their own: ids may be null or stand for several rows."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()))


def keep_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose row is wanted."""
    return rows.join(wanted.select("__row"), "__row", "left_semi").select(*COLUMNS)


@stage
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is too high for their language go.

    Texts without words (null, empty, white space) go too; a null language is one of its own. Repeated
    rows share their verdict.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = numbered(docs)
    return keep_rows(rows, kneser_ney.classify(rows.select("__row", "doc_id", "text", "lang"), labels).where("kept"))


@stage
def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id (null ids last; then by a digest of the text).

    Texts without words are copies of each other, and repeated rows are: one of them stays.
    """
    rows = numbered(docs)
    group = near_copies.groups(rows.select("__row", "text"), "__row")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64("lang", "source", "n_chars"), "__row")
    first = rows.select("__row", rank.alias("rank")).join(group, "__row").groupBy("component").agg(F.min("rank").alias("rank"))
    return keep_rows(rows, first.select("rank.__row"))


@stage
def substrings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that stand earlier in the corpus are cut out; a document of which nothing is left goes.

    Texts without words stay as they are. Of repeated rows with 20 words or more the first stays.
    n_chars follows the text where words were cut out.
    """
    out = rlz_dedup.dedup(docs)
    rest = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_words = 0 OR n_removed < n_words").withColumn("text", rest)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


@stage
def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken so that the sources' words come near their targets; one may come twice.

    Texts without words are taken like the others of their source; null is a source of its own.
    """
    rows = numbered(docs)
    return mixing.emit(rows, mixing.mix(rows.select("__row", "doc_id", "text", "source")), "__row").select(*COLUMNS)


@stage
def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens: a row for each piece of a document, with its sequence and place there.

    A text without words is one token, the end mark. Repeated rows are packed each.
    """
    return packing.pack(materialize(packing.pieces(docs.select("doc_id", "text"), packing.tokenizer_path())))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The stages train a model and hash with XXH64, which SQL can't say; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        out = materialize(f(spark, docs, sf_dir))  # the scratch of a stage goes when the next one starts
        release(docs)  # does nothing to the input tables
        docs = out
    return docs
