"""Quality rules with adaptive limits from mergeable quantile sketches per language and source.

Each document gets counts (words, symbols, repeated lines, repeated word windows, capitals). Five
rates of them are put into logarithmic buckets; the counts per bucket are the sketch of a group:
sketches of parts add up to that of the whole, whatever the parts, and a quantile read from one
has a relative error of 2 % at most. A rate may not exceed

    q(0.8) + 3 * (q(0.8) - q(0.5)) + slack

of its own language and source, nor may the length of words fall below q(0.2) - 3 * (q(0.5) - q(0.2))
- slack. The quantiles stop at 0.8 so that a fifth of junk in a group can't lift its limits; where
most documents have a rate of 0 the slack is what is left of a limit, until a fifth of a group has
more. Sketches are merged upwards: the quantiles of a language are drawn towards those of all
documents, and those of a group towards its language's, with the weight of PRIOR documents; so a
small group leans on the larger ones, by degrees. The limits are then joined to the documents, and a
document that breaks one is not kept. Two fixed rules stay as a base (at least 50 words; at most half
of the words in repeated windows).

Nulls: a null text has no words and fails the base; null languages and sources are groups of their
own. A document without words has rates 0. Repeated rows count as often as they come; an empty table
gives no rows. A column of the input with the name of a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import hashing as H
from lithos.llm.common import chunks, materialize, utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Rates, and what they may exceed the limit of their group by.
RATES = {"r_length": ("word_chars", "n_words", 2.0), "r_symbols": ("n_symbols", "n_words", 0.15), "r_lines": ("n_dup_lines", "n_lines", 0.3), "r_repeats": ("n_repeat_words", "n_words", 0.2), "r_capitals": ("n_capitals", "word_chars", 0.2)}
GAMMA = 1.02 / 0.98
SMALLEST = 1e-4
#: Documents that the quantiles of the next larger group count as.
PRIOR = 100
#: The rate that has a lower limit, and its slack.
LOW, LOW_SLACK = "r_length", 1.0
CHUNK = 1 << 18

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a buffer."""
    n = len(off) - 1
    some = np.flatnonzero(np.diff(off))

    def per(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(some):
            out[some] = np.add.reduceat(mask, off[some], dtype=np.int64)
        return out

    s, e, first = H.word_spans(data, off)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = per(~H.SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per(SYMBOL[data])
    out["n_capitals"] = per(CAPITAL[data])
    doc = np.repeat(np.arange(n), np.diff(first))
    # lines: between line ends and document borders, those that hold a word
    cut = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    a, b = cut[:-1], cut[1:].copy()
    ended = data[b - 1] == 10
    b[ended] -= 1
    full = np.logical_or.reduceat(~H.SPACE[data], a) if len(a) else np.zeros(0, bool)
    a, b = a[full], b[full]
    line_doc = np.searchsorted(off, a, "right") - 1
    lines = H.mix(H.span_hashes(data, a, b) ^ (line_doc.astype(np.uint64) * H.ODD))
    kinds, at = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[at], minlength=n)
    # words in windows of three that the document holds twice
    h = H.span_hashes(data, s, e)
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        start = np.flatnonzero(doc[2:] == doc[:-2])
        w = H.mix(H.window_hashes(h, 3)[start] ^ (doc[start].astype(np.uint64) * H.ODD))
        _, kind, count = np.unique(w, return_inverse=True, return_counts=True)
        start = start[count[kind] > 1]
        for k in range(3):
            repeated[start + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=n)
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the counts."""
    keep = [f for f in docs.schema if f.name != text and f.name not in COUNTS]
    out = T.StructType([*keep, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(text))
            parts = [text_counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off, CHUNK)]
            cols = [batch.column(f.name) for f in keep]
            cols += [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, out)


def rate(name: str):
    top, bottom, _ = RATES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bucket(value):
    """0 for less than SMALLEST, else the bucket of a logarithmic sketch."""
    return F.when(value < SMALLEST, F.lit(0)).otherwise(F.ceil(F.log(value / SMALLEST) / F.lit(float(np.log(GAMMA)))) + 1).cast("int")


def limits(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """__lang, __source and the limit of each rate."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES]))
    keys = ["__lang", "__source", "rate"]
    sketch = measured.select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), rates.alias("r")).select("__lang", "__source", "r.*").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    every = sketch.select("__lang", "__source", "rate").distinct()
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.pow(F.lit(GAMMA), F.col("bucket") - 1.5))

    def quantiles(level: list[str]) -> DataFrame:
        merged = sketch.groupBy(*level, "rate", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*level, "rate")
        total, upto = F.sum("n").over(part), F.sum("n").over(part.orderBy("bucket"))
        merged = merged.withColumn("total", total).withColumn("upto", upto)
        q = lambda p: F.min(F.when(F.col("upto") >= F.col("total") * p, value))
        return merged.groupBy(*level, "rate").agg(F.max("total").alias("total"), q(0.5).alias("q50"), q(0.8).alias("q80"), q(0.2).alias("q20"))

    def same(a, b, cols):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]

    own, by_lang, whole = quantiles(["__lang", "__source"]), quantiles(["__lang"]), quantiles([])
    joined = every.alias("e").join(own.alias("o"), same("e", "o", keys)).join(by_lang.alias("l"), same("e", "l", ["__lang", "rate"])).join(whole.alias("w"), same("e", "w", ["rate"]))

    def pick(c: str):
        own, by_lang, whole = (F.col(f"{a}.{c}") for a in "olw")
        n, k = F.col("o.total"), F.col("l.total")
        return (n * own + PRIOR * (k * by_lang + PRIOR * whole) / (k + PRIOR)) / (n + PRIOR)

    slack = F.coalesce(*[F.when(F.col("e.rate") == r, F.lit(s)) for r, (_, _, s) in RATES.items()])
    top = pick("q80") + 3.0 * (pick("q80") - pick("q50")) + slack
    low = pick("q20") - 3.0 * (pick("q50") - pick("q20")) - LOW_SLACK
    flat = joined.select(F.col("e.__lang").alias("__lang"), F.col("e.__source").alias("__source"), F.col("e.rate").alias("rate"), top.alias("limit"), low.alias("low"))
    pivot = [F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"limit_{r}") for r in RATES]
    return flat.groupBy("__lang", "__source").agg(*pivot, F.max(F.when(F.col("rate") == LOW, F.col("low"))).alias("low_limit"))


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with base_failed and kept."""
    measured = measured.drop("base_failed", "kept")
    top = limits(measured, lang, source).alias("t")
    m = measured.alias("m")
    # one row of limits for each language and source: small whatever the corpus, so mostly a broadcast; else a join that can split a large key
    joined = m.join(top, F.col(f"m.{lang}").eqNullSafe(F.col("t.__lang")) & F.col(f"m.{source}").eqNullSafe(F.col("t.__source")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.lit(True)
    for r in RATES:
        fine = fine & F.coalesce(rate(r) <= F.col(f"limit_{r}"), F.lit(True))
    fine = fine & F.coalesce(rate(LOW) >= F.col("low_limit"), F.lit(True))
    return joined.select("m.*", base.alias("base_failed"), (~base & fine).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = materialize(measure(docs))
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
