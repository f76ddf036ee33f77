"""Language-model scoring by cross-entropy difference.

Two bigram models with the same smoothing and the same vocabulary, all words of the corpus: the
background is counted over all documents, the target over the trusted ones,

    p(w)     = (c(w) + ALPHA) / (N + ALPHA * V)
    p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU)

and a document's score is the mean over its words of the loss under the target less the loss under
the background: the lower, the more it looks like trusted text. A word never sees its own count: one
is taken off the background's counts, and off the target's if the document is trusted, so labelled
and unlabelled documents are judged alike.

Words and bigrams of a block of documents are sent to shards once each with their two counts; the
shards add up over all blocks and answer with the corpus' counts (64 bits). What is exchanged follows
the corpus; nothing is capped, and a word that all documents have costs one entry per block. A
block's documents are worked off in chunks, so a task holds a block's different keys, not its words.

Nulls: a null text has no words; scores of texts without words are null. Labels of unknown
documents count for nothing, nor do null ids. A repeated row is counted and scored each time. Without
trusted documents the target is uniform over the vocabulary. A text of any length is scored whole. An
empty table gives no rows. A column of the input with the name of a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import exchange as X
from lithos.llm import hashing as H
from lithos.llm.common import block_table, chunks, n_blocks, place, text_size, utf8

ALPHA = 0.1
MU = 2.0
CHUNK = 1 << 18
PAIR = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
COUNTS = [X.COUNT, X.COUNT]


def keys_of(data: np.ndarray, off: np.ndarray):
    """Even keys of words, odd keys of pairs of neighbours in a document, and the documents of both."""
    s, e, first = H.word_spans(data, off)
    h = H.span_hashes(data, s, e) & ~ONE
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = H.mix(h[inner - 1] * PAIR + H.mix(h[inner] ^ H.ODD)) | ONE
    return h, pair, doc, inner, first


def chunk_keys(docs: pa.Table, text_col: str):
    """(first document, last, hashes and so on of keys_of) of each chunk of a block."""
    data, off = utf8(docs[text_col])
    for i, j in chunks(off, CHUNK):
        yield i, j, *keys_of(data[off[i] : off[j]], off[i : j + 1] - off[i])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of parts, sorted, and the sums of their counts (rows of counts: several for each key)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)
    k, c = np.concatenate(keys), np.concatenate(counts, 1)
    order = np.argsort(k, kind="stable")
    k = k[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.stack([np.add.reduceat(row[order], new) if len(new) else row[:0] for row in c])


def block_counts(docs: pa.Table, trusted: np.ndarray, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a block and how often all and trusted documents have them."""
    keys, counts = [], []
    for i, j, h, pair, doc, inner, _ in chunk_keys(docs, text_col):
        own = trusted[i:j]
        k, at, n = np.unique(np.concatenate([h, pair]), return_inverse=True, return_counts=True)
        good = np.bincount(at[np.concatenate([own[doc], own[doc[inner]]])], minlength=len(k))
        keys.append(k)
        counts.append(np.stack([n, good]).astype(np.uint64))
        if len(keys) > 8:
            keys, counts = ([x] for x in merged(keys, counts))
    return merged(keys, counts)


def add(key: np.ndarray, _, background: np.ndarray, target: np.ndarray):
    """The corpus' counts of the keys of a shard; for the shard: different words, and both totals of words."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.concatenate([[True], k[1:] != k[:-1]])
    new = np.flatnonzero(start)
    word = (k[new] & ONE) == 0
    of = np.cumsum(start) - 1
    out, stats = [], [int(word.sum())]
    for x in (background, target):
        sums = np.add.reduceat(x[order].astype(np.uint64), new)
        stats.append(int(sums[word].sum()))
        told = np.empty(len(key), np.uint64)
        told[order] = sums[of]
        out.append(told)
    return out, stats


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", alpha: float = ALPHA, mu: float = MU, fan: int = X.FAN) -> DataFrame:
    """docs without the text, with n_words, ce_target, ce_background and ce_difference.

    labels: a row (id_col) for each trusted document.
    """
    made = ["n_words", "ce_target", "ce_background", "ce_difference"]
    kept = [f for f in docs.schema if f.name not in made and f.name != text]
    plan = X.layout(n_blocks(text_size(docs, text)), fan)
    # what is joined with the labels is the place of each document, not its text; the places found go to the blocks as rows
    base = docs.select(*[f.name for f in kept], text).withColumn("__place", place(id_col, text)).withColumn("__mark", F.lit(False))
    good = labels.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    marks = base.select(id_col, "__place").join(good, id_col, "left_semi").select("__place", F.lit(True).alias("__mark")).distinct()
    placed = block_table(base.unionByName(marks, allowMissingColumns=True), id_col, text, plan.blocks)

    def split(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The documents of a block, and which of them are trusted."""
        rows = table.filter(pc.invert(table["__mark"]))
        return rows, pc.is_in(rows["__place"], pc.unique(table.filter(table["__mark"])["__place"])).to_numpy(zero_copy_only=False).astype(bool)

    def count(key, table):
        rows, trusted = split(table)
        keys, counts = block_counts(rows, trusted, text)
        return X.ask(key[0].as_py(), keys, list(counts), COUNTS, plan)

    sent = placed.select(text, "__place", "__mark", "__block").groupBy("__block").applyInArrow(count, X.SENT)
    told, stats = X.exchange(sent, plan, add, COUNTS, COUNTS)
    size, *totals = (int(x or 0) for x in stats.agg(*[F.sum(F.col("stats")[k]) for k in range(3)]).first())
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in made[1:]]])

    def losses(key, table, replies):
        table, trusted = split(table)
        n = len(table)
        keys, _ = block_counts(table, trusted, text)
        counts = X.heard(replies, keys, COUNTS) if len(keys) else [keys, keys]
        sums, words = np.zeros((2, n)), np.zeros(n, np.int64)
        for i, j, h, pair, doc, inner, first in chunk_keys(table, text):
            words[i:j] = np.diff(first)
            kinds, where = np.unique(np.concatenate([h, pair]), return_inverse=True)
            at = np.searchsorted(keys, kinds)
            own = trusted[i:j][doc].astype(np.float64)
            for k, (c, total) in enumerate(zip(counts, totals)):
                mine = c[at].astype(np.float64)[where]
                less = own if k else np.ones(len(h))
                cw = np.maximum(mine[: len(h)] - less, 0)
                single = (cw + alpha) / (np.maximum(total - less, 0) + alpha * size)
                both = single.copy()
                both[inner] = (np.maximum(mine[len(h) :] - less[inner], 0) + mu * single[inner]) / (cw[inner - 1] + mu)
                sums[k, i:j] = np.bincount(doc, weights=-np.log(both), minlength=j - i)
        ce = [pa.array(np.where(words > 0, s / np.maximum(words, 1), np.nan), from_pandas=True) for s in (sums[1], sums[0], sums[1] - sums[0])]
        return pa.table([*[table[f.name] for f in kept], pa.array(words), *ce], schema.names)

    return placed.groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(losses, schema)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return score(docs, labels)
