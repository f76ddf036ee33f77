"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Training. Trusted documents are labelled ones of good quality. Four fifths of all of them (by a hash
of their id) are used to count bigrams; the last fifth, which the model must not have seen, calibrates.
Counts, continuation counts and the three discounts of each order come from aggregations. The model
is then written as one table key -> value, in which interpolation has become addition:

    log p(w | v) = g(v) + u(w) + d(v, w)

with g the log of the weight that v leaves to the lower order, u the log of the continuation
probability of w, and d = log p(w | v) - g(v) - u(w) for the bigrams that were seen, 0 for others.

Scoring. Each task turns its documents into keys. The most frequent keys of the model are known
everywhere (HEAD of them, a fixed size); the others are joined in shards: a filter of a fixed size
drops keys that the model lacks, the rest go to the shard of their hash as packed arrays (each
different key once for a unit of documents, with the documents that have it), where the shard's
part of the model turns them into a sum for each document. A key that many documents of a unit have
goes without them, and its value comes back to the unit, so no key costs more than a few bytes for
each unit. Beyond SHARDS shards each one is split by the unit, and its part of the model repeated. The documents
are scored in PASSES parts one after another, so that the shuffle of one is on disk at a time.
The sums of all shards add up to the document's log-probability.

Deciding. The calibration documents give, for each language, the median log-perplexity and the
QUANTILE of its excess over the median in units that allow for a text's length (short texts scatter
more). Both are drawn towards the pooled values with the weight of PRIOR documents, so a language
with few of them leans on all, by degrees. They are read from counts per language and bucket of
STEP, which add up whatever the parts. A document is kept if its excess is at most that times MARGIN.

Nulls: a null text has no words; texts without words have no perplexity and are not kept. Null is a
language of its own. Without any trusted
document every text with words is kept. Repeated rows are scored alike; an empty table gives no
rows. A column of the input with the name of a result is replaced by it.
"""

from __future__ import annotations

import io
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import hashing as H
from lithos.llm.common import chunks, materialize, release, text_size, utf8

HEAD = 1 << 17
#: Bits of the filter, over all shards: the least, the most, and for a key of the model in between (as powers of 2).
FILTER_BITS, MOST_BITS, KEY_BITS = 26, 29, 3
QUANTILE = 0.99
MARGIN = 1.3
#: Calibration documents that the pooled median and quantile count as.
PRIOR = 100
#: Width of a bucket of log-perplexities when medians and quantiles are read.
STEP = 1 / 256
#: Words at which the scatter of a text's log-perplexity has doubled, as variance.
SHORT = 60.0
CHUNK = 1 << 18
#: Parts of the bigrams that get the values of their words one after another, and of the documents that are scored so.
PASSES = 4
UNIT = 12 << 20
#: Bytes of text for a shard, the most shards, and the documents of a unit that a key brings along.
SHARD, SHARDS, HEAVY = 24 << 20, 4096, 32

#: Kinds of rows of a unit: its documents, keys with the documents that have them, keys alone.
META, LIGHT, ASKED = 0, 1, 2
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
PAIR = np.uint64(0x9E3779B97F4A7C15)


def word_keys(data: np.ndarray, off: np.ndarray):
    """Hashes of the words of a buffer, and the number of the first word of each document."""
    s, e, first = H.word_spans(data, off)
    return H.span_hashes(data, s, e), first


def bigrams(h: np.ndarray, first: np.ndarray):
    """(context, word, document) of every event: the words and an end mark, after a start mark; documents without words have none."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    doc = np.repeat(full, n[full] + 1)
    size = len(h) + len(full)
    at_end = first[full + 1] + np.arange(len(full)) + 0
    word = np.empty(size, np.uint64)
    ends = np.zeros(size, bool)
    ends[at_end] = True
    word[ends] = END
    word[~ends] = h
    context = np.empty(size, np.uint64)
    context[1:] = word[:-1]
    context[first[full] + np.arange(len(full))] = START
    return context, word, doc


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return H.mix(v * PAIR + H.mix(w ^ H.ODD))


def count_bigrams(docs: DataFrame, text: str) -> DataFrame:
    """(v, w, c), counted in each batch first, with what all pairs of v have in common: t, the sum of c, and k1, k2, k3, the numbers of pairs seen once, twice and more often.

    Dealt by v alone, so the counts of a context need no further exchange; sorted by v, so they take no room in a file.
    """

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(text))
            for i, j in chunks(off, 8 * CHUNK):
                h, first = word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
                v, w, _ = bigrams(h, first)
                _, at, c = np.unique(pair_key(v, w), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(c.astype(np.int64))], ["v", "w", "c"])

    pairs = docs.select(text).mapInArrow(run, "v long, w long, c long").repartition("v").groupBy("v", "w").agg(F.sum("c").alias("c"))
    part, c = Window.partitionBy("v"), F.col("c")
    kinds = {"k1": c == 1, "k2": c == 2, "k3": c > 2}
    # a frame over a context's rows; a context has at most as many as there are words
    return pairs.select("v", "w", "c", F.sum("c").over(part).alias("t"), *[F.sum(F.when(k, 1).otherwise(0)).over(part).alias(n) for n, k in kinds.items()])


def discounts(n: list[int]) -> list[float]:
    """The three discounts of an order from the numbers of entries seen once to four times; 0.5, 1 and 1.5 where they are too few to tell."""
    n1, n2, n3, n4 = n
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def train(trusted: DataFrame, text: str = "text"):
    """The table (key, value, c) of a model, the value of unknown words, and what a document adds by its start."""
    pairs = materialize(count_bigrams(trusted, text))
    of = lambda c, k: F.sum(F.when(F.col(c) == k, 1).otherwise(0))
    words = pairs.groupBy("w").agg(F.count("*").alias("k"), F.sum("c").alias("c"))
    two = pairs.agg(*[of("c", k) for k in (1, 2, 3, 4)], F.count("*")).first()
    one = words.agg(*[of("k", k) for k in (1, 2, 3, 4)], F.sum(F.when(F.col("k") > 2, 1).otherwise(0)), F.count("*")).first()
    if not two[4]:
        return None
    d2, d1 = discounts([x or 0 for x in two[:4]]), discounts([x or 0 for x in one[:4]])
    types, vocabulary = two[4], one[5] + 1
    left = (d1[0] * one[0] + d1[1] * one[1] + d1[2] * one[4]) / types
    unknown = float(np.log(left / vocabulary))
    less = lambda c, d: F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
    u = F.log((F.col("k") - less("k", d1)) / types + left / vocabulary)
    words = words.select(F.col("w").alias("x"), u.alias("u"), "c")
    # the weight that a context leaves to the lower order
    g = F.log((F.col("k1") * d2[0] + F.col("k2") * d2[1] + F.col("k3") * d2[2]) / F.col("t")).alias("g")
    contexts = pairs.select(F.col("v").alias("x"), g, "t").distinct()
    single = materialize(words.join(contexts, "x", "full").select("x", F.coalesce("u", F.lit(unknown)).alias("u"), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("c", "t").alias("c")))
    marks = {r["x"]: r for r in single.where(F.col("x").isin(int(START), int(END))).collect()}
    fixed = marks[int(START)]["g"] + marks[int(END)]["u"]

    def keyed(batches):
        for b in batches:
            v, w = (b.column(x).to_numpy().view(np.uint64) for x in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(v, w).view(np.int64)), b.column("value").cast(pa.float32()), b.column("c")], ["key", "value", "c"])

    # a word counts as a word and as a context; unknown words have g = 0, and every word adds u(unknown) below
    alone = single.where(~F.col("x").isin(int(START), int(END))).select(F.col("x").alias("key"), (F.col("u") + F.col("g") - F.lit(unknown)).cast("float").alias("value"), "c")
    parts = [materialize(alone)]
    # the words' values come to the pairs in PASSES, so that a part of the pairs at a time is on its way
    for k in range(PASSES):
        mine = pairs.where(F.pmod(F.xxhash64("v"), F.lit(PASSES)) == k).select("v", "w", "c", "t", "k1", "k2", "k3")
        full = mine.join(single.select(F.col("x").alias("w"), "u"), "w").withColumn("g", g)
        p = (F.col("c") - less("c", d2)) / F.col("t") + F.exp(F.col("g") + F.col("u"))
        both = full.select("v", "w", (F.log(p) - F.col("g") - F.col("u")).alias("value"), "c")
        parts.append(materialize(both.mapInArrow(keyed, "key long, value float, c long")))
    release(pairs, single)
    table = reduce(DataFrame.unionByName, parts)
    table._lithos_parts = parts
    return table, unknown, fixed


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def by_shard(table: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, values) with the keys of a shard sorted, packed."""
    hashed = F.pmod(F.shiftrightunsigned("key", 40), F.lit(shards)).cast("int").alias("shard")

    def run(key, t):
        k, v = t["key"].to_numpy().view(np.uint64), t["value"].to_numpy()
        order = np.argsort(k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([k[order].tobytes()], pa.binary()), "values": pa.array([v[order].tobytes()], pa.binary())})

    return materialize(table.select(hashed, "key", "value").groupBy("shard").applyInArrow(run, "shard int, keys binary, values binary"))


def filter_bits(model: DataFrame, shards: int) -> np.ndarray:
    """One bit array over all shards: FILTER_BITS to MOST_BITS in all, by the number of keys."""
    keys = model.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    bits = min(max(FILTER_BITS, math.ceil(math.log2(keys + 1)) + KEY_BITS - 1), MOST_BITS)
    width = (1 << bits) // shards // 8 * 8

    def run(batches):
        for b in batches:
            for shard, keys in zip(b.column("shard").to_pylist(), b.column("keys").to_pylist()):
                bits = np.zeros(width, bool)
                bits[(np.frombuffer(keys, np.uint64) % np.uint64(width)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["shard", "bits"])

    out = np.zeros((shards, width // 8), np.uint8)
    for r in model.mapInArrow(run, "shard int, bits binary").toLocalIterator():
        out[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def score(docs: DataFrame, trained, text: str = "text", unit_bytes: int = UNIT, heavy: int = HEAVY, most_shards: int = SHARDS, last: bool = False) -> DataFrame:
    """docs without the text, with n_words and __logp: the log-probability of the words and the end. last: the model's table goes once its shards are made."""
    spark = docs.sparkSession
    table, unknown, fixed = trained
    wanted = text_size(docs, text) // SHARD
    shards = max(16, min(most_shards, wanted))
    salts = max(1, -(-wanted // most_shards))
    model = by_shard(table, shards)
    bits = filter_bits(model, shards)
    # the keys of all counts down to the least that still fits: at most HEAD rows come to the driver
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = table.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= HEAD).agg(F.min("c")).first()[0]
    head = table.where(F.col("c") >= F.lit(least)).select("key", "value").toPandas()
    order = np.argsort(head.key.to_numpy().view(np.uint64))
    if last:
        release(*table._lithos_parts)
    shared = spark.sparkContext.broadcast((head.key.to_numpy().view(np.uint64)[order], head.value.to_numpy()[order], bits))
    keep = [f for f in docs.schema if f.name not in (text, "n_words", "__logp")]
    names = [f.name for f in keep]

    def units(batches):
        known, value, there = shared.value
        width = there.shape[1] * 8
        unit = TaskContext.get().partitionId() << 32
        held, size, cols = [], 0, []

        def flush():
            sums = np.concatenate([x[0] for x in held])
            words = np.concatenate([x[1] for x in held])
            start = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
            keys = np.concatenate([x[2] for x in held])
            doc = np.concatenate([x[3] + start[k] for k, x in enumerate(held)]).astype(np.uint32)
            t = pa.Table.from_batches(cols).append_column("n_words", pa.array(words)).append_column("__logp", pa.array(sums))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            kinds, count = keys[new], np.diff(np.append(new, len(keys)))
            part = shard_of(kinds, shards)
            split = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[split], np.arange(shards + 1))
            small = np.uint16 if len(words) < 1 << 16 else np.uint32
            refs = lambda m: doc[H.expand(new[m], new[m] + count[m] - 1)[0]].astype(small).tobytes()
            many = count > heavy
            rows = []
            for k in range(shards):
                mine = split[cut[k] : cut[k + 1]]
                for kind, m in ((LIGHT, mine[~many[mine]]), (ASKED, mine[many[mine]])):
                    if len(m):
                        rest = (b"", b"") if kind == ASKED else (count[m].astype(np.uint32).tobytes(), refs(m))
                        rows.append((k, unit, len(words), kind, kinds[m].tobytes(), *rest))
            m = split[many[split]]
            home = int(H.mix(np.array([unit], np.uint64))[0] % np.uint64(shards))
            rows.append((home, unit, len(words), META, sink.getvalue(), count[m].astype(np.uint32).tobytes(), refs(m)))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "unit", "n", "kind", "x", "y", "z"])

        for batch in batches:
            data, off = utf8(batch.column(text))
            for i, j in chunks(off, CHUNK):
                h, first = word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
                v, w, doc = bigrams(h, first)
                words = np.diff(first)
                keys = np.concatenate([h, pair_key(v, w)])
                doc = np.concatenate([np.repeat(np.arange(j - i), words), doc])
                sums = np.where(words > 0, words * unknown + fixed, 0.0)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                sums = sums + np.bincount(doc[hit], weights=value[at[hit]], minlength=j - i)
                keys, doc = keys[~hit], doc[~hit]
                shard, bit = shard_of(keys, shards), (keys % np.uint64(width)).astype(np.int64)
                maybe = (there[shard, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
                held.append((sums, words, keys[maybe], doc[maybe]))
                cols.append(pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in names], names))
                size += off[j] - off[i] + 32 * (j - i)
                if size >= unit_bytes:
                    yield flush()
                    held, size, cols, unit = [], 0, [], unit + 1
        if held:
            yield flush()

    def join(key, model, asked):
        known = np.frombuffer(b"".join(model["keys"].to_pylist()), np.uint64)
        value = np.frombuffer(b"".join(model["values"].to_pylist()), np.float32)
        out = []
        for r in asked.to_pylist():
            if r["kind"] == META:
                out.append((r["unit"], META, 0, r["x"], r["y"], r["z"]))
                continue
            keys = np.frombuffer(r["x"], np.uint64)
            got = np.zeros(len(keys), np.float32)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                got = np.where(known[at] == keys, value[at], np.float32(0))
            if r["kind"] == ASKED:
                out.append((r["unit"], ASKED, r["shard"], got.tobytes(), b"", b""))
            else:
                doc = np.frombuffer(r["z"], np.uint16 if r["n"] < 1 << 16 else np.uint32)
                sums = np.bincount(doc, weights=np.repeat(got.astype(np.float64), np.frombuffer(r["y"], np.uint32)), minlength=r["n"])
                out.append((r["unit"], LIGHT, r["shard"], sums.tobytes(), b"", b""))
        cols = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["unit", "kind", "shard", "x", "y", "z"])

    salt = F.pmod(F.xxhash64("unit"), F.lit(salts)).cast("int").alias("salt")
    spread = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("__logp", T.DoubleType())])

    def add(key, table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("kind", "shard", "x", "y", "z"))))
        _, _, meta, count, doc = rows.pop(0)
        base = pa.ipc.open_stream(meta).read_all()
        total = base["__logp"].to_numpy().copy()
        for kind, _, x, _, _ in rows:
            if kind == LIGHT:
                total += np.frombuffer(x, np.float64)
        # the values of the keys that many documents have, in order of shard
        value = np.frombuffer(b"".join(x for kind, _, x, _, _ in rows if kind == ASKED), np.float32).astype(np.float64)
        doc = np.frombuffer(doc, np.uint16 if len(base) < 1 << 16 else np.uint32)
        total += np.bincount(doc, weights=np.repeat(value, np.frombuffer(count, np.uint32)), minlength=len(base))
        return base.set_column(base.num_columns - 1, "__logp", pa.array(total))

    def scored(part: DataFrame) -> DataFrame:
        asked = part.select(*names, text).mapInArrow(units, "shard int, unit long, n long, kind int, x binary, y binary, z binary").select("*", salt)
        sums = spread.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(join, "unit long, kind int, shard int, x binary, y binary, z binary")
        return materialize(sums.groupBy("unit").applyInArrow(add, out))

    # the keys of a part of the documents at a time are on their way
    of = F.pmod(F.xxhash64(*names), F.lit(PASSES)) if names else F.lit(0)
    parts = reduce(DataFrame.unionByName, [scored(docs.where(of == k)) for k in range(PASSES if names else 1)])
    shared.destroy()  # all parts are written
    return parts


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """The ids of trusted documents, with fold 0 to train (four fifths of all, or of `most`) and 1 to calibrate (all others)."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(id_col).where(F.col(id_col).isNotNull()).distinct()
    h = F.xxhash64(F.col(id_col), F.lit(7))
    fold = F.when(F.pmod(h, F.lit(5)) != 0, 0).otherwise(1)
    if most is None:
        return good.select(id_col, fold.alias("__fold"))
    trained = good.orderBy(h, id_col).limit(most).where(fold == 0)
    return good.join(trained.withColumn("__fold", F.lit(0)), id_col, "left").select(id_col, F.coalesce("__fold", F.lit(1)).alias("__fold"))


def quantiles(values: DataFrame, by: list[str], value, p: float) -> DataFrame:
    """by, n and q: the number of values of each group and their quantile, between the middles of buckets of STEP."""
    counts = values.groupBy(*by, F.floor(value / STEP).alias("bucket")).agg(F.count("*").alias("k"))
    # a group has as many rows as it has buckets, whatever the number of its values
    part = Window.partitionBy(*by)
    counts = counts.withColumn("n", F.sum("k").over(part)).withColumn("upto", F.sum("k").over(part.orderBy("bucket")))
    rank = (F.col("n") - 1) * F.lit(p)
    at = lambda k: F.min(F.when(F.col("upto") > k, (F.col("bucket") + 0.5) * STEP))
    part = F.max(rank - F.floor(rank))
    q = at(F.floor(rank)) + part * (at(F.ceil(rank)) - at(F.floor(rank)))
    return counts.groupBy(*by).agg(F.max("n").alias("n"), q.alias("q"))


def drawn(own: str, pooled: str, n: str):
    """A value of n documents, drawn towards that of all with the weight of PRIOR documents; the pooled one for none."""
    k = F.coalesce(F.col(n), F.lit(0))
    return (k * F.coalesce(F.col(own), F.col(pooled)) + PRIOR * F.col(pooled)) / (k + PRIOR)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """docs without the text, with n_words, perplexity, threshold (both as log-perplexity excess) and kept."""
    made = ["n_words", "log_perplexity", "excess", "threshold", "kept"]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    ids = materialize(trusted_ids(labels.withColumnRenamed("doc_id", id_col), id_col, most))
    trained = train(docs.join(ids.where("__fold = 0").select(id_col), id_col, "left_semi").select(text), text)
    if trained is None:
        plain = docs.withColumn("n_words", F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")).drop(text)
        null = F.lit(None).cast("double")
        return plain.withColumn("log_perplexity", null).withColumn("excess", null).withColumn("threshold", null).withColumn("kept", F.col("n_words") > 0)
    scored = score(docs, trained, text, last=True)
    scored = materialize(scored.withColumn("log_perplexity", F.when(F.col("n_words") > 0, -F.col("__logp") / (F.col("n_words") + 1))).drop("__logp"))
    # the trusted documents that the model has not seen
    held = materialize(scored.join(ids.where("__fold = 1").select(id_col), id_col, "left_semi").where("log_perplexity IS NOT NULL").select(lang, "n_words", "log_perplexity"))
    wide = F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("n_words"), F.lit(1)))
    pooled = quantiles(held, [], F.col("log_perplexity"), 0.5).agg(F.max("q").alias("pm"))
    own = quantiles(held.withColumnRenamed(lang, "__lang"), ["__lang"], F.col("log_perplexity"), 0.5).withColumnRenamed("q", "m")
    every = scored.select(F.col(lang).alias("__lang")).distinct()
    center = every.join(own, every["__lang"].eqNullSafe(own["__lang"]), "left").select(every["__lang"], "m", "n").crossJoin(F.broadcast(pooled))
    center = center.select("__lang", drawn("m", "pm", "n").alias("m"))
    center = materialize(center)
    with_center = lambda d: d.alias("d").join(center.alias("c"), F.col(f"d.{lang}").eqNullSafe(F.col("c.__lang"))).select("d.*", F.col("c.m").alias("__m"))
    excess = (F.col("log_perplexity") - F.col("__m")) / wide
    spread = with_center(held).withColumn("__e", excess)
    whole = quantiles(spread, [], F.col("__e"), quantile).agg(F.max("q").alias("pq"))
    by = quantiles(spread.withColumnRenamed(lang, "__l"), ["__l"], F.col("__e"), quantile).withColumnRenamed("n", "k")
    tops = center.join(by, center["__lang"].eqNullSafe(by["__l"]), "left").crossJoin(F.broadcast(whole))
    tops = materialize(tops.select("__lang", F.col("m").alias("__m"), (drawn("q", "pq", "k") * margin).alias("threshold")))
    out = scored.alias("d").join(tops.alias("c"), F.col(f"d.{lang}").eqNullSafe(F.col("c.__lang"))).select("d.*", "__m", "threshold").withColumn("excess", excess)
    kept = F.coalesce((F.col("excess") <= F.col("threshold")) | (F.col("threshold").isNull() & (F.col("n_words") > 0)), F.lit(False))
    return out.withColumn("kept", kept).drop("__m")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", "n_words", "log_perplexity", "excess", "threshold", "kept")
