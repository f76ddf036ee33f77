"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

A unit vector is turned by a fixed random rotation and kept as the signs of its components (the
code) and one correction factor f, the inner product of the vector with its own code. For another
turned vector q, <q, code> / f is an unbiased estimate of the inner product, with an error of at
most BOUND * sqrt((1 - f * f) / (f * f * (d - 1))) but for a chance that falls with exp(-BOUND ** 2).
Pairs whose estimate plus that bound reaches the threshold are recomputed exactly in double
precision, and only these decide; all other pairs need the codes alone.

Vectors are compared within a label. Equal vectors are one kind with a count, so copies are never
paired. Each kind is encoded once: its turned vector in half precision (the q of a pair), its packed
signs and its factor are stored in a table of tiles, beside the vectors, which the comparison of codes
doesn't read. Kinds are dealt to tiles by their leading turned components, in the order of the cells
of a grid; pairs of tiles whose boxes lie farther apart than the threshold allows are skipped. Every other pair of tiles of a label is a piece of work of its own. It names the
rows that its bounds can't exclude, and only for these the vectors are fetched and multiplied. A
piece returns the number of links of each kind and a spanning forest of them, not the pairs. Tiles
grow with the root of a label, so a tile is sent as often as that root.

Nulls: vectors that are null, zero or hold null or non-finite components, and vectors without a
label, link with nothing and are components of their own, each row for itself. Vectors of different
lengths don't link. Repeated rows are linked like other equal vectors. An empty table gives no
rows. A column of the input with the name of a result is replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import materialize
from lithos.llm.components import components
from lithos.llm.simhash import forest, spread_out

THRESHOLD = 0.98
BOUND = 5.0
#: Vectors in a tile: the root of a label's number times ROOT, between these two.
LEAST_TILE, MOST_TILE, ROOT = 1024, 1 << 17, 32
#: Bytes of the vectors of a tile at most, however many components they have.
TILE_BYTES = 64 << 20
#: Rows of a tile that are compared at once, and the leading components that boxes and cells are made of.
ROWS = 256
LEADING = 16
#: Components that give a digit of a cell's number.
DIGITS = 8
SEED = 42


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray):
    """Turned unit vectors (half precision), their packed signs, the correction factor of each, and the cell of each."""
    d = x.shape[1]
    turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(d).T
    positive = turned >= 0
    factor = (turned * np.where(positive, 1.0, -1.0)).sum(1) / np.sqrt(d)
    # quarters of a normal distribution with the variance that the components of a turned unit vector have
    digit = np.searchsorted(np.array([-0.6745, 0.0, 0.6745]) / np.sqrt(d), turned[:, :DIGITS])
    cell = np.zeros(len(x), np.int64)
    for k in range(DIGITS):
        cell = cell * 4 + (digit[:, k] if k < d else 0)
    return turned.astype(np.float16), np.packbits(positive, axis=1), factor, cell


def slack(f: np.ndarray, d: int) -> np.ndarray:
    """How far the estimate may be off: the bound of the code, and the rounding of the other side."""
    return BOUND * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, d - 1))) + 2e-3 / f


def undecided(turned: np.ndarray, code: np.ndarray, f: np.ndarray, d: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a first and a second tile that have a pair whose estimate can't be told from the threshold.

    turned: of the first tile; code, f: of the second one.
    """
    signs = np.where(np.unpackbits(code, axis=1, count=d) > 0, np.float32(1), np.float32(-1)) / np.float32(np.sqrt(d))
    off = slack(f, d)
    rows, cols = np.zeros(len(turned), bool), np.zeros(len(code), bool)
    for x in range(0, len(turned), ROWS):
        q = turned[x : x + ROWS].astype(np.float32)
        for y in range(x if same else 0, len(code), 4 * ROWS):
            maybe = (q @ signs[y : y + 4 * ROWS].T) / f[y : y + 4 * ROWS] + off[y : y + 4 * ROWS] >= threshold
            if same:
                maybe &= np.arange(y, y + maybe.shape[1])[None, :] > np.arange(x, x + len(q))[:, None]
            rows[x : x + ROWS] |= maybe.any(1)
            cols[y : y + 4 * ROWS] |= maybe.any(0)
    return np.flatnonzero(rows), np.flatnonzero(cols)


def exact_links(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, threshold: float, same: bool):
    """Pairs (i, j) among the rows ia of a tile and ib of another with at least this cosine, in double precision, some rows at a time."""
    x, y = a[ia].astype(np.float64), b[ib].astype(np.float64)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for k in range(0, len(x), ROWS):
        exact = (x[k : k + ROWS] @ y.T) / (nx[k : k + ROWS, None] * ny[None, :])
        i, j = np.nonzero(exact >= threshold)
        i, j = ia[k + i], ib[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def usable(vector: str):
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda c: c != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, least_tile: int = LEAST_TILE) -> DataFrame:
    """vectors with n_links, component_id (the least id of the component) and kept (it has that id)."""
    made = ("n_links", "component_id", "kept")
    vectors = vectors.select(*[c for c in vectors.columns if c not in made])
    good = vectors.where(usable(vector) & F.col(label).isNotNull())
    kinds = good.groupBy(F.col(label).alias("__label"), F.size(vector).alias("__d"), F.col(vector).alias("__v")).agg(F.min(id_col).alias("__id"), F.count("*").alias("__n"))
    kinds = materialize(kinds.withColumn("__k", F.monotonically_increasing_id()))
    wide = np.float64 if isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType) else np.float32
    label_type = kinds.schema["__label"].dataType.simpleString()

    def code(batches):
        for batch in batches:
            sizes = batch.column("__d").to_numpy()
            for d in np.unique(sizes).tolist():
                b = batch.filter(pa.array(sizes == d))
                x = b.column("__v").flatten().to_numpy(zero_copy_only=False).astype(wide).reshape(-1, d)
                turned, signs, f, cell = encode(x.astype(np.float64))
                raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, turned, signs)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__label", "__d", "__k", "__n")), *raw, pa.array(f), pa.array(cell)], ["__label", "__d", "__k", "__n", "x", "turned", "code", "f", "cell"])

    coded = kinds.mapInArrow(code, f"__label {label_type}, __d int, __k long, __n long, x binary, turned binary, code binary, f double, cell long")
    # tiles: cells of a grid, as coarse as the label's size asks for; a cell with more than a tile is dealt by hash
    of_label = ["__label", "__d"]
    tile = F.least(F.greatest(F.lit(least_tile), F.ceil(F.sqrt("__rows") * ROOT)), F.lit(MOST_TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (F.col("__d") * np.dtype(wide).itemsize))))
    sizes = kinds.groupBy(*of_label).agg(F.count("*").alias("__rows")).withColumn("__tile", tile)
    digits = F.least(F.lit(DIGITS), F.floor(F.log(F.greatest(F.lit(1.0), F.col("__rows") / F.col("__tile"))) / math.log(4.0)))
    sizes = sizes.withColumn("__cells", F.pow(F.lit(4.0), F.lit(DIGITS) - digits).cast("long"))
    coded = materialize(coded.join(sizes, of_label).withColumn("__cell", F.floor(F.col("cell") / F.col("__cells"))).drop("cell", "__cells", "__rows"))
    parts = coded.groupBy(*of_label, "__cell").agg(F.ceil(F.count("*") / F.max("__tile")).alias("__parts"))
    dealt = coded.join(parts, [*of_label, "__cell"]).withColumn("__part", F.pmod(F.xxhash64("__k"), F.col("__parts")))

    def pack(key, t):
        lead = np.frombuffer(b"".join(t["turned"].to_pylist()), np.float16).reshape(len(t), -1)[:, :LEADING].astype(np.float32)
        row = {c: pa.array([b"".join(t[c].to_pylist())], pa.binary()) for c in ("x", "turned", "code")}
        row |= {c: pa.array([t[k].to_numpy().tobytes()], pa.binary()) for c, k in (("f", "f"), ("k", "__k"), ("n", "__n"))}
        box = {"lo": pa.array([lead.min(0).tolist()], pa.list_(pa.float32())), "hi": pa.array([lead.max(0).tolist()], pa.list_(pa.float32()))}
        return pa.table({"__label": t["__label"][:1], "__d": t["__d"][:1]} | row | box)

    tiles = dealt.groupBy(*of_label, "__cell", "__part").applyInArrow(pack, f"__label {label_type}, __d int, x binary, turned binary, code binary, f binary, k binary, n binary, lo array<float>, hi array<float>")
    tiles = materialize(tiles.withColumn("tile", F.monotonically_increasing_id()))
    # pairs of tiles by their boxes alone; then the codes, without the vectors
    a, b = (tiles.select(*of_label, F.col("tile").alias(f"tile{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")) for s in "ab")
    apart = F.zip_with(F.zip_with("loa", "hib", lambda x, y: x - y), F.zip_with("lob", "hia", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x.cast("double"), y.cast("double")))
    near = a.join(b, of_label).where("tilea <= tileb").where(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) <= 2 - 2 * threshold + 0.01)
    near = materialize(near.select("__d", "tilea", "tileb"))
    side = lambda s, *cols: tiles.select(F.col("tile").alias(f"tile{s}"), *[F.col(c).alias(f"{c}{s}") for c in cols])
    pairs = spread_out(near.join(side("a", "turned"), "tilea").join(side("b", "code", "f"), "tileb"), near, "tilea", "tileb")

    def estimate(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d = r["__d"]
                turned = np.frombuffer(r["turneda"], np.float16).reshape(-1, d)
                signs = np.frombuffer(r["codeb"], np.uint8).reshape(-1, (d + 7) // 8)
                i, j = undecided(turned, signs, np.frombuffer(r["fb"]), d, threshold, r["tilea"] == r["tileb"])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([r["tilea"]]), pa.array([r["tileb"]]), pa.array([i.astype(np.uint32).tobytes()]), pa.array([j.astype(np.uint32).tobytes()])], ["__d", "tilea", "tileb", "ia", "ib"])

    open_ = materialize(pairs.mapInArrow(estimate, "__d int, tilea long, tileb long, ia binary, ib binary"))
    pairs = spread_out(open_.join(side("a", "x", "k", "n"), "tilea").join(side("b", "x", "k", "n"), "tileb"), open_, "tilea", "tileb")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["tilea"] == r["tileb"]
                x, y = (np.frombuffer(r[c], wide).reshape(-1, r["__d"]) for c in ("xa", "xb"))
                ka, kb, na, nb = (np.frombuffer(r[c], np.int64) for c in ("ka", "kb", "na", "nb"))
                left, right = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
                trees = []
                shift = 0 if same else len(ka)
                for i, j in exact_links(x, y, np.frombuffer(r["ia"], np.uint32).astype(np.int64), np.frombuffer(r["ib"], np.uint32).astype(np.int64), threshold, same):
                    left += np.bincount(i, weights=nb[j], minlength=len(ka)).astype(np.int64)
                    right += np.bincount(j, weights=na[i], minlength=len(kb)).astype(np.int64)
                    trees.append(forest(i, j + shift))
                ids = ka if same else np.concatenate([ka, kb])
                n = left + right if same else np.concatenate([left, right])
                i, j = forest(*(np.concatenate(t) for t in zip(*trees))) if trees else (np.zeros(0, np.int64),) * 2
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[i], ids[some]])), pa.array(np.concatenate([ids[j], ids[some]])), pa.array(np.concatenate([np.zeros(len(i), np.int64), n[some]]))], ["a", "b", "n"])

    found = materialize(pairs.mapInArrow(compare, "a long, b long, n long"))
    of = components(found.where("n = 0").select("a", "b"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("__k")).agg(F.sum("n").alias("__links"))
    named = kinds.join(of, F.col("__k") == F.col("node"), "left").join(counts, "__k", "left")
    named = named.select("__k", "__label", "__v", "__id", F.coalesce("component", "__k").alias("__c"), (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("n_links"))
    least = named.groupBy("__c").agg(F.min("__id").alias("component_id"))
    named = materialize(named.join(least, "__c").select("__label", "__v", "n_links", "component_id"))
    out = vectors.join(named, (F.col(label) == F.col("__label")) & (F.col(vector) == F.col("__v")), "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", F.col(id_col)))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).drop("__label", "__v")


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")
