"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has bit k set if more than half of the hashes of a text's word shingles have it.
Different fingerprints are sorted by the number of set bits in their four 16-bit parts and cut into
tiles of equal size. Two fingerprints that differ in at most r bits have counts that differ by at
most r in sum over the parts, so a pair of tiles whose ranges of counts lie farther apart is
skipped; all other pairs are compared with exclusive-or and bit counts in numpy. No pair within the
radius is lost and none is guessed.

Equal fingerprints are compared once and then belong together, so copies cost nothing. A pair of
tiles returns a spanning forest of its links, at most one link for each fingerprint, which keeps
the components and stays small where thousands of texts are alike.

Nulls: a null text has no words; its fingerprint is zero, like that of any text without words, and
is linked like any other. Texts with fewer words than a shingle have one shingle, the whole
sequence. Repeated rows are in the component of their fingerprint. An empty table gives no rows. A
column of the input with the name of a result is replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import hashing as H
from lithos.llm.common import materialize, utf8
from lithos.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile.
TILE = 512
#: Fingerprints in a strip that one task holds against another one: the root of their number times ROOT, between these two.
LEAST_STRIP, MOST_STRIP, ROOT = 4096, 1 << 21, 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprint(words: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int, seed: int) -> int:
    """words: lower-case words of one text joined by single spaces; starts, ends: of each word in it."""
    from xxhash import xxh64_intdigest

    n = len(starts)
    if not n:
        return 0
    a, b = (starts, ends[shingle - 1 :]) if n >= shingle else (starts[:1], ends[-1:])
    a, b = a[: len(b)].tolist(), b.tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(b), CHUNK):
        h = np.array([xxh64_intdigest(words[x:y], seed) for x, y in zip(a[i : i + CHUNK], b[i : i + CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(b)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs without the text, with __f: the fingerprint's bits as a long."""
    keep = [f for f in docs.schema if f.name != text]
    out = T.StructType([*keep, T.StructField("__f", T.LongType())])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(text))
            got = np.zeros(len(off) - 1, np.uint64)
            for i in range(len(off) - 1):
                d = LOWER[data[off[i] : off[i + 1]]]
                s, e, _ = H.word_spans(d, np.array([0, len(d)]))
                words = d.tobytes()
                if len(s) and ((s[1:] - e[:-1] != 1).any() or (d[e[:-1]] != 32).any()):
                    words = b" ".join([words[x:y] for x, y in zip(s.tolist(), e.tolist())])
                    size = e - s
                    e = np.cumsum(size + 1) - 1
                    s = e - size
                got[i] = fingerprint(words, s, e, shingle, seed)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(got.view(np.int64))], out.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, out)


def parts(f: np.ndarray) -> np.ndarray:
    """Set bits of the four 16-bit parts of each fingerprint."""
    return np.bitwise_count(f.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two sorted strips within the radius, as a spanning forest."""
    lp, rp = parts(left), parts(right)
    cuts_l, cuts_r = range(0, len(left), TILE), range(0, len(right), TILE)
    box = lambda p, cuts: [(p[c : c + TILE].min(0), p[c : c + TILE].max(0)) for c in cuts]
    bl, br = box(lp, cuts_l), box(rp, cuts_r)
    out_i, out_j = [], []
    for x, (lo, hi) in zip(cuts_l, bl):
        a = left[x : x + TILE]
        for y, (lo2, hi2) in zip(cuts_r, br):
            if same and y < x:
                continue
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi)).sum()
            if gap > radius:
                continue
            b = right[y : y + TILE]
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                out_i.append(i + x)
                out_j.append(j + y)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(out_i), np.concatenate(out_j) + (0 if same else len(left)))


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links (i, j) connect."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def strip_size(n: int, least: int = LEAST_STRIP, most: int = MOST_STRIP, root: int = ROOT) -> int:
    """Strips grow with the root of the number of rows, so that each is sent as often as that root, not as often as the rows."""
    return min(most, max(least, math.ceil(root * math.sqrt(n) / TILE) * TILE))


def links(kinds: DataFrame, radius: int = RADIUS, strip: int | None = None) -> DataFrame:
    """(a, b) of a table of different fingerprints (__f, __id): ids whose fingerprints are linked, as forests."""
    n = kinds.count()
    strip = strip or strip_size(n)
    strips = max(1, math.ceil(n / strip))
    count = F.concat_ws("", *[F.lpad(F.bit_count(F.shiftrightunsigned("__f", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("string"), 2, "0") for k in range(4)]).cast("int")
    schema = "strip int, n long, f binary, ids binary, lo array<int>, hi array<int>"

    def packed(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        f = t["__f"].to_numpy().view(np.uint64)
        ids = t["__id"].to_numpy()
        p = parts(f)
        order = np.lexsort((f, *p.T[::-1]))
        f, ids, p = f[order], ids[order], p[order]
        # a partition is cut into strips of equal size
        for k in range(0, len(f), strip):
            q = p[k : k + strip]
            yield pa.RecordBatch.from_pylist([{"strip": 0, "n": len(q), "f": f[k : k + strip].tobytes(), "ids": ids[k : k + strip].tobytes(), "lo": q.min(0).tolist(), "hi": q.max(0).tolist()}], schema=pa.schema([("strip", pa.int32()), ("n", pa.int64()), ("f", pa.binary()), ("ids", pa.binary()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))]))

    cut = kinds.withColumn("__count", count).repartitionByRange(max(1, math.ceil(strips / 4)), "__count", "__f").select("__f", "__id").mapInArrow(packed, schema)
    cut = materialize(cut.withColumn("strip", F.monotonically_increasing_id()))
    # strips are narrow in the count of the first part: those within the radius there meet by equal counts
    first = lambda name, wide: cut.select(F.struct("strip", "lo", "hi").alias(name), F.explode(F.sequence(F.col("lo")[0] - wide, F.col("hi")[0] + wide)).alias("c"))
    gap = F.aggregate(F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0), x, y)), F.lit(0), lambda s, x: s + x)
    near = first("a", radius).join(first("b", 0), "c").where((F.col("a.strip") <= F.col("b.strip")) & (gap <= radius))
    near = near.select(F.col("a.strip").alias("strip"), F.col("b.strip").alias("other")).distinct()
    near = materialize(near)
    left = near.join(cut.select("strip", F.col("f").alias("fa"), F.col("ids").alias("ia")), "strip")
    pairs = left.join(cut.select(F.col("strip").alias("other"), F.col("f").alias("fb"), F.col("ids").alias("ib")), "other")
    # every pair of strips is a piece of work of its own
    pairs = spread_out(pairs, near, "strip", "other")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["strip"] == r["other"]
                ids = np.concatenate([np.frombuffer(r["ia"], np.int64), np.frombuffer(r["ib"], np.int64)])
                i, j = tile_links(np.frombuffer(r["fa"], np.uint64), np.frombuffer(r["fb"], np.uint64), radius, same)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


#: Pairs of tiles or strips that a task takes at most, about.
PAIRS = 16


def spread_out(pairs: DataFrame, near: DataFrame, *key: str) -> DataFrame:
    """pairs over as many tasks as their number (that of near) asks for."""
    least = 4 * int(pairs.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(max(least, math.ceil(near.count() / PAIRS)), F.xxhash64(*key))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """docs without the text, with fingerprint and component_id (the least id of the component)."""
    kept = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    prints = materialize(fingerprints(docs.select(*kept), text, shingle, seed))
    kinds = materialize(prints.groupBy("__f").agg(F.min(id_col).alias("__id")))
    # an id that is null or stands for several fingerprints can't name one: components are of fingerprints
    of = components(links(kinds.select("__f", F.col("__f").alias("__id")), radius))
    least = kinds.join(of, F.col("__f") == F.col("node"), "left").select("__f", "__id", F.coalesce("component", "__f").alias("__c"))
    first = least.groupBy("__c").agg(F.min("__id").alias("component_id"))
    # component ids by fingerprint: as many rows as there are different fingerprints
    named = least.join(first, "__c").select("__f", "component_id")
    out = prints.join(named, "__f")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("__f"), 16, "0"))).drop("__f")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
