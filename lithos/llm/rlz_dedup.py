"""Substring dedup by Relative Lempel-Ziv parsing against an index of all reference blocks.

The corpus is dealt into blocks, and every block is indexed: its documents are cut into *phrases*,
runs of window starts that share their least six-word gram (a choice that the words of a window
make alone, so equal windows choose alike wherever they stand), and the phrases of all blocks meet
in the shards of one index, by the hash of that gram. The index answers for each phrase in which
block its words stand earlier, if they do.

A document is then parsed from left to right: a factor takes whole phrases for as long as the same
reference block has them. Where the parse stops, at the borders of factors, a phrase may still
agree with an earlier place in part; the windows of these phrases (those that share their gram with
a different phrase) are looked up one by one in a second index, 128 bits a window, and lengthen the
factors word by word. A factor is one window (20 words) at least, so each is a duplicate span: all
its windows start earlier in the corpus, and no window outside the factors does.

Earlier means a smaller id (a whole number), nulls first; rows with the same id by a hash of id and
text, and within a document by position. Everything is judged on the input. Nulls and empty texts have
no words. Texts of any length are parsed whole: phrases of a long one are found in overlapping parts.
A repeated row's words are removed from the later one. An empty table gives no rows. A column of the
input with the name of a result is replaced by it. Ids that aren't whole numbers are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import exchange as X
from lithos.llm import hashing as H
from lithos.llm.common import block_table, chunks, in_order, n_blocks, segments, text_size, utf8

WINDOW = 20
GRAM = 6
#: Bytes of text, and words of one document, handled at once.
CHUNK = 1 << 18
WORDS = 1 << 18

NONE, LOOK = -1, -2
KINDS = [np.uint64, np.int64]


class Parse:
    """The phrases of a block, chunk by chunk, always in the same order."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, gram: int):
        self.table = in_order(table, id_col)
        self.data, self.off = utf8(self.table[text_col])
        self.ids = self.table[id_col].cast(pa.int64()).fill_null(-(2**63)).to_numpy()
        self.window, self.parts = window, []
        for i, j in chunks(self.off, CHUNK):
            base = self.off[i]
            data, off = self.data[base : self.off[j]], self.off[i : j + 1] - base
            s, e, first = H.word_spans(data, off)
            h = H.span_hashes(data, s, e)
            found = [(x + lo, y + lo, z + lo, w) for lo, hi, part in segments(first, WORDS, window - 1) for x, y, z, w in [H.reigns(h[lo:hi], part, window, gram)]]
            a, b, at, g = (np.concatenate(x) for x in zip(*found))
            context = H.mix(H.span_hash(H.prefix_hashes(h), a, b + window) ^ H.mix(((at - a) << 32 | (b - a)).astype(np.uint64)))
            doc = np.searchsorted(first, a, "right") - 1 + i
            self.parts.append((i, j, s + base, e + base, first, h, a, b, doc, g, context))

    def all(self, k: int) -> np.ndarray:
        got = [p[k] for p in self.parts]
        return np.concatenate(got) if got else np.zeros(0, np.int64)

    def windows(self, phrases: np.ndarray):
        """Two hashes of each window of the chosen phrases, and its document."""
        one, two, docs, at = [], [], [], 0
        for _, _, _, _, _, h, a, b, doc, g, _ in self.parts:
            chosen = phrases[at : at + len(g)]
            at += len(g)
            if chosen.any():
                start, run = H.expand(a[chosen], b[chosen])
                one.append(H.mix(H.window_hashes(h, self.window)[start]))
                two.append(H.mix(H.window_hashes(H.mix(h ^ H.ODD), self.window, H.BASE2)[start]))
                docs.append(doc[chosen][run])
        if not one:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(one), np.concatenate(two), np.concatenate(docs)


def index_phrases(g: np.ndarray, block: np.ndarray, context: np.ndarray, ids: np.ndarray):
    """For each phrase: the block where it stands first, or LOOK at its windows, or NONE if its gram has no other phrase."""
    n = len(g)
    order = np.lexsort((np.arange(n), block, ids, context, g))
    g, context = g[order], context[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    kinds = np.bincount(np.cumsum(new_gram) - 1, weights=new)[np.cumsum(new_gram) - 1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    reply = np.empty(n, np.int32)
    reply[order] = np.where(new, np.where(kinds > 1, LOOK, NONE), block[order][first])
    return [reply], ()


def index_windows(a: np.ndarray, block: np.ndarray, b: np.ndarray, ids: np.ndarray):
    """For each window: the block where it stands first, or NONE if that is here."""
    n = len(a)
    order = np.lexsort((np.arange(n), block, ids, b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    reply = np.empty(n, np.int32)
    reply[order] = np.where(new, NONE, block[order][first])
    return [reply], ()


def replies(table: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
    """What the shards said to the keys of a block, in the order of the keys."""
    if not len(keys):
        return np.zeros(0, np.int32)
    return X.heard(table.filter(pc.equal(table["kind"], kind)), keys, [np.int32])[0]


def factors(found: np.ndarray, first: np.ndarray, window: int):
    """Left-to-right factors of each document from the reference block of every window start (NONE: no earlier one).

    A factor goes on while the same block has the next window too. Gives begin, end (in words).
    """
    hit = found != NONE
    new = hit.copy()
    new[1:] &= ~(hit[:-1] & (found[1:] == found[:-1]))
    new[first[:-1][first[:-1] < len(found)]] = hit[first[:-1][first[:-1] < len(found)]]
    last = hit.copy()
    last[:-1] &= ~hit[1:] | new[1:]
    return np.flatnonzero(new), np.flatnonzero(last) + window


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, output: str = "text", fan: int = X.FAN) -> DataFrame:
    """docs with n_words, n_removed, n_factors; output "text": also kept_text (kept words with the white
    space after them as it was); "digest": kept_sha256 of the kept words joined by single spaces instead of text."""
    made = ["n_words", "n_removed", "n_factors", "kept_text", "kept_sha256"]
    kept = [f for f in docs.schema if f.name not in made and not (output == "digest" and f.name == text)]
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} has to be a whole number")
    plan = X.layout(n_blocks(text_size(docs, text)), fan)
    base = docs.select(*[f.name for f in kept], *([text] if output == "digest" else []))
    placed = block_table(base, id_col, text, plan.blocks)
    lean = placed.select(id_col, text, "__place", "__block").groupBy("__block")

    def phrases(key, table):
        p = Parse(table, id_col, text, window, gram)
        return X.ask(key[0].as_py(), p.all(9).astype(np.uint64), [p.all(10), p.ids[p.all(8).astype(np.int64)]], KINDS, plan)

    one, _ = X.exchange(lean.applyInArrow(phrases, X.SENT), plan, index_phrases, KINDS, [np.int32])
    one = one.withColumn("kind", F.lit(1))

    def borders(key, table, told):
        p = Parse(table, id_col, text, window, gram)
        a, b, doc = p.windows(replies(told, 1, p.all(9).astype(np.uint64)) == LOOK)
        return X.ask(key[0].as_py(), a, [b, p.ids[doc]], KINDS, plan)

    asked = lean.cogroup(one.groupBy("__block")).applyInArrow(borders, X.SENT)
    two, _ = X.exchange(asked, plan, index_windows, KINDS, [np.int32])

    last = [T.StructField("kept_text", T.StringType())] if output == "text" else [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in made[:3]], *last])

    def parse(key, table, told):
        p = Parse(table, id_col, text, window, gram)
        phrase = replies(told, 1, p.all(9).astype(np.uint64))
        a, _, _ = p.windows(phrase == LOOK)
        single = replies(told, 2, a)
        n = len(p.ids)
        counts = np.zeros((3, n), np.int64)
        texts, at, used = [], 0, 0
        for i, j, s, e, first, h, start, end, _, g, _ in p.parts:
            found = np.full(len(h), NONE, np.int32)
            mine = phrase[at : at + len(g)]
            at += len(g)
            where, run = H.expand(start, end)
            found[where] = np.where(mine[run] == LOOK, NONE, mine[run])
            look = where[mine[run] == LOOK]
            found[look] = single[used : used + len(look)]
            used += len(look)
            begin, stop = factors(found, first, window)
            gone = H.covered(len(h), begin, stop)
            counts[0, i:j] = np.diff(first)
            upto = np.concatenate([[0], np.cumsum(gone)])
            counts[1, i:j] = upto[first[1:]] - upto[first[:-1]]
            counts[2, i:j] = np.bincount(np.searchsorted(first, begin, "right") - 1, minlength=j - i)
            for d in range(j - i):
                w = slice(first[d], first[d + 1])
                lo, hi = p.off[i + d], p.off[i + d + 1]
                texts.append(rest(p.data, s[w], e[w], ~gone[w], lo, hi, output))
        cols = [p.table[f.name] for f in kept] + [pa.array(c) for c in counts]
        return pa.table([*cols, pa.array(texts, pa.string())], [*[f.name for f in kept], *made[:3], last[0].name])

    told = one.unionByName(two.withColumn("kind", F.lit(2)))
    return placed.groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(parse, schema)


def rest(data: np.ndarray, s: np.ndarray, e: np.ndarray, kept: np.ndarray, lo: int, hi: int, output: str) -> str:
    """The kept words of a document: as they stood, or a digest of them."""
    if output == "text":
        if kept.all():
            return data[lo:hi].tobytes().decode()
        # a removed word goes with the white space after it
        nxt = np.append(s[1:], hi)
        gone = H.covered(hi - lo, s[~kept] - lo, nxt[~kept] - lo)
        return data[lo:hi][~gone].tobytes().decode()
    raw = data[lo:hi].tobytes()
    words = [raw[a:b] for a, b in zip((s[kept] - lo).tolist(), (e[kept] - lo).tolist())]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, output="digest").select("doc_id", "n_words", "n_removed", "kept_sha256")
