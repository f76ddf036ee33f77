"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 and more.

Rows with the same set of shingles (SHINGLE lower-case words) are one *kind*. Kinds are compared by
simhashes of 128 bits of their sets, tile by tile as in simhash.py, but in the order of the sets'
sizes: a similarity of s needs sizes in a ratio of s at least, so tiles farther apart are skipped.
At a similarity of 0.8 some 19 bits differ, with a standard deviation of 4; the kinds that differ in
at most RADIUS bits are candidates (sf0.1: all 48 similar pairs of kinds are among them; none
differs in more than 25 bits). Their sets are then compared exactly, and only pairs that are
similar enough become links.

A group of g near copies has g * g / 2 candidates. So a pair of strips first returns at most FEW
partners for each kind, chosen by a hash, and one for each kind that nobody chose; the links among
them join most groups. A second pass over the kinds that have candidates brings their sets along and
compares all pairs that are not in one component yet within the task, so only links become rows.
The components are those that all candidates would give.

Nulls and texts without words have the empty set, and are copies of each other. Texts with fewer
words than a shingle have one shingle, the whole sequence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm import hashing as H
from lithos.llm.common import chunks, materialize, release, utf8
from lithos.llm.components import components
from lithos.llm.simhash import LOWER, spread_out, strip_size

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
RADIUS = 34
FEW = 4
TILE = 512
#: Kinds in a strip: as simhash.strip_size.
LEAST_STRIP, MOST_STRIP, ROOT = 2048, 1 << 18, 16
#: Hashes in a strip that brings its sets along.
HASHES = 1 << 20
#: Bands of sizes in the ratio that a similarity allows; a strip lies in one band.
BANDS = 2
CHUNK = 1 << 18
#: Shingles whose bits are counted at once.
ROWS = 1 << 14
SECOND = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, shingle: int):
    """The sorted different shingle hashes of each text of a column."""
    data, off = utf8(column)
    for i, j in chunks(off, CHUNK):
        part, at = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, first = H.word_spans(part, at)
        h = H.span_hashes(part, s, e)
        windows = H.window_hashes(h, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            w = windows[a : b - shingle + 1] if b - a >= shingle else H.window_hashes(h[a:b], b - a) if b > a else h[:0]
            yield np.unique(H.mix(w))


def simhash(kind: np.ndarray) -> np.ndarray:
    """128 bits of a set: those that more than half of its hashes have."""
    ones = np.zeros(128, np.int64)
    for i in range(0, len(kind), ROWS):
        k = kind[i : i + ROWS]
        both = np.stack([k, H.mix(k ^ SECOND)], axis=1).view(np.uint8)
        ones += np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(kind), bitorder="little")


def kinds_of(docs: DataFrame, row: str, text: str, shingle: int) -> DataFrame:
    """(row, set, f, n): a digest of each row's set of shingles, its simhash and its size."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            out = [(xxh3_128_digest(k.tobytes()), simhash(k).tobytes(), len(k)) for k in shingle_sets(b.column(text), shingle)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(row), *[pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()))]], ["row", "set", "f", "n"])

    return docs.select(F.col(row).cast("long").alias(row), text).mapInArrow(run, "row long, set binary, f binary, n long")


def possible(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether two different sets of these sizes can be similar enough."""
    top, bottom = SIMILAR
    same = n == m
    return bottom * (np.minimum(n, m) - same) >= top * (np.maximum(n, m) + same)


def tile_pairs(left, right, radius: int, same: bool):
    """Pairs (i, j) of two strips (f, n, label), each sorted by n, that may be similar and have different labels."""
    (f, n, c), (g, m, d) = left, right
    top, bottom = SIMILAR
    out = []
    for x in range(0, len(n), TILE):
        a, na = f[x : x + TILE], n[x : x + TILE]
        for y in range(x if same else 0, len(m), TILE):
            b, mb = g[y : y + TILE], m[y : y + TILE]
            if bottom * na[-1] < top * mb[0] or bottom * mb[-1] < top * na[0]:
                continue
            far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            i, j = np.divmod(np.flatnonzero(far <= radius), len(mb))
            fine = possible(na[i], mb[j]) & (c[x + i] != d[y + j])
            if same and x == y:
                fine &= i < j
            if fine.any():
                out.append((i[fine] + x, j[fine] + y))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (none, none)


def some(i: np.ndarray, j: np.ndarray, few: int) -> np.ndarray:
    """Which pairs to take: few of each j, by a hash, and one of each i."""
    h = H.mix(i.astype(np.uint64) * SECOND + j.astype(np.uint64))
    order = np.lexsort((h, j))
    start = np.flatnonzero(np.concatenate([[True], j[order][1:] != j[order][:-1]])) if len(j) else np.zeros(0, np.int64)
    rank = np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j))))
    take = np.zeros(len(j), bool)
    take[order[rank < few]] = True
    order = np.lexsort((h, i))
    take[order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(i) else order] = True
    return take


def candidates(kinds: DataFrame, radius: int = RADIUS, few: int | None = None, strip: int | None = None, sets: bool = False) -> DataFrame:
    """(a, b, more) of a table of kinds (node, f, n, label): pairs that may be similar; more: a pair of strips had others. sets: the kinds have hashes, and only similar ones are returned."""
    n = kinds.count()
    strip = strip or strip_size(n, LEAST_STRIP, MOST_STRIP, ROOT)
    top, bottom = SIMILAR
    names = ("node", "f", "n", "label", *["hashes"] * sets)
    schema = "strip long, " + ", ".join(f"{c} binary" for c in names) + ", lo long, hi long"
    # sets without partners of another size or their own stay out: fewer than four shingles
    band = F.floor(F.log("n") / F.log(F.lit(bottom / top)) * BANDS)
    wide = kinds.where("n >= 4").select(*names, band.alias("band"))
    # strips are counted by band of sizes, so their number follows the rows, not the partitions; with sets, long texts make strips of fewer kinds
    pieces = F.greatest(F.ceil(F.count("*") / strip), F.ceil(F.sum("n") / HASHES) if sets else F.lit(1))
    bands = wide.groupBy("band").agg(pieces.cast("long").alias("pieces"))
    # a size is a long, so there are at most some 200 * BANDS bands
    dealt = wide.join(F.broadcast(bands), "band").withColumn("strip", F.col("band") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), "pieces"))

    def packed(t: pa.Table) -> pa.Table:
        size, node = t["n"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort((node, size))
        size, node, label = size[order], node[order], t["label"].to_numpy()[order]
        row = [node.tobytes(), b"".join(t["f"].take(pa.array(order)).to_pylist()), size.tobytes(), label.tobytes()]
        if sets:
            row.append(b"".join(t["hashes"].take(pa.array(order)).to_pylist()))
        row = [pa.array([t["strip"][0].as_py()]), *[pa.array([v], pa.binary()) for v in row], pa.array([int(size[0])]), pa.array([int(size[-1])])]
        return pa.Table.from_arrays(row, ["strip", *names, "lo", "hi"])

    cut = materialize(dealt.select("strip", *names).groupBy("strip").applyInArrow(packed, schema))
    step = lambda x: F.floor(F.log(F.col(x)) / F.log(F.lit(bottom / top)))
    # strips whose sizes come within the ratio are at most one step of it apart
    side = lambda name, wide: cut.select(F.struct("strip", "lo", "hi").alias(name), F.explode(F.sequence(step("lo") - wide, step("hi") + wide)).alias("c"))
    pairs = side("x", 2).join(side("y", 0), "c").where(f"x.strip <= y.strip AND {bottom} * x.hi >= {top} * y.lo AND {bottom} * y.hi >= {top} * x.lo")
    pairs = pairs.select(F.col("x.strip").alias("strip"), F.col("y.strip").alias("other")).distinct()
    pairs = near = materialize(pairs)
    right = cut.select(F.col("strip").alias("other"), *[F.col(c).alias(f"{c}2") for c in names])
    pairs = spread_out(pairs.join(cut.select("strip", *names), "strip").join(right, "other"), near, "strip", "other")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda end: (np.frombuffer(r[f"f{end}"], np.uint64).reshape(-1, 2), np.frombuffer(r[f"n{end}"], np.int64), np.frombuffer(r[f"label{end}"], np.int64))  # noqa: B023, E731
                i, j = tile_pairs(read(""), read("2"), radius, r["strip"] == r["other"])
                take = np.ones(len(i), bool) if few is None else some(i, j, few)
                if sets:
                    x, y = (np.split(np.frombuffer(r[f"hashes{e}"], np.uint64), np.cumsum(np.frombuffer(r[f"n{e}"], np.int64))[:-1]) for e in ("", "2"))
                    take = np.array([alike(x[p], y[q]) for p, q in zip(i.tolist(), j.tolist())], bool)
                a, b = np.frombuffer(r["node"], np.int64)[i[take]], np.frombuffer(r["node2"], np.int64)[j[take]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), not take.all()))], ["a", "b", "more"])

    return materialize(pairs.mapInArrow(compare, "a long, b long, more boolean"))


def shingled(docs: DataFrame, nodes: DataFrame, row: str, text: str, shingle: int) -> DataFrame:
    """(row, hashes): the sets of the rows that nodes names."""

    def hashes(batches):
        for b in batches:
            sets = [k.tobytes() for k in shingle_sets(b.column(text), shingle)]
            yield pa.RecordBatch.from_arrays([b.column(row), pa.array(sets, pa.binary())], ["row", "hashes"])

    return docs.select(row, text).join(nodes, row, "left_semi").mapInArrow(hashes, "row long, hashes binary")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    top, bottom = SIMILAR
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return bottom * shared >= top * (len(x) + len(y) - shared)


def similar(pairs: DataFrame, docs: DataFrame, row: str, text: str, shingle: int) -> DataFrame:
    """The (a, b) of pairs whose texts' sets are similar enough."""
    nodes = pairs.select(F.col("a").alias(row)).unionByName(pairs.select(F.col("b").alias(row))).distinct()
    sets = materialize(shingled(docs, nodes, row, text, shingle))
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")

    def keep(batches):
        for b in batches:
            fine = []
            for x, y in zip(b.column("x"), b.column("y")):
                fine.append(alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return materialize(both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long"))


def inside(kinds: DataFrame, docs: DataFrame, row: str, text: str, shingle: int, radius: int, strip: int | None = None) -> DataFrame:
    """The links of all pairs of kinds (node, f, n, label) of different labels that are similar enough, found with their sets at hand."""
    sets = materialize(shingled(docs, kinds.select(F.col("node").alias(row)), row, text, shingle))
    return candidates(kinds.join(sets.select(F.col("row").alias("node"), "hashes"), "node"), radius, None, strip, True)


def groups(docs: DataFrame, row: str, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, few: int = FEW) -> DataFrame:
    """(row, component) of every row; row: a number that no two rows share."""
    rows = materialize(kinds_of(docs, row, text, shingle))
    kinds = materialize(rows.groupBy("set").agg(F.min("row").alias("node"), F.first("f").alias("f"), F.first("n").alias("n")))
    pairs = candidates(kinds.withColumn("label", F.col("node")), radius, few)
    links = similar(pairs.select("a", "b"), docs, row, text, shingle)
    of = components(links)
    if pairs.where("more").limit(1).count():
        named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        open_ = kinds.join(named, "node").join(of, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        rest = inside(materialize(open_), docs, row, text, shingle, radius)
        links = links.unionByName(rest.select("a", "b"))
        of = components(links)
    named = kinds.join(of, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    return rows.select("row", "set").join(named, "set").select(F.col("row").alias(row), "component")
