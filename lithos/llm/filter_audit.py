"""What each filter of a chain does in every order: a packed bitmap index and counts over prefix subsets.

Five filters, A to E, judge each document alone (E by the whole table); a chain applies them in some
order. What a step of a chain removes depends only on the *set* of filters before it, so 80 pairs of
(set, filter) answer all 120 orders. Each task packs its rows into NumPy bitsets, a bit for each row:
one for each filter's failures, one for good and one for toxic labels, the rows of a part side by
side and padded to whole bytes. The survivors of a set are AND-NOTs of these bitsets, and byte-wise
popcounts summed over the bytes of a part are its counts. Spark adds up the counts of the tasks; no
row leaves its task but as part of a sum.

A text's first id is the least one of its digest (SHA-256), aggregated before it is joined back, only for
texts that several rows have. Labels are aggregated by id before they are joined.

Nulls: a null text counts as empty, a null source as the empty string; a null id is never larger than
another and has no labels. Several labels of one id count as their maximum. Repeated rows count each;
of equal ids none is the smaller. An empty table gives no rows. Texts of any length are counted whole,
a long one in parts that end between words. Further columns of the input are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm import hashing as H
from lithos.llm.common import materialize, utf8, word_parts

LETTERS = "ABCDE"
LEAST_WORDS = 200
CHUNK = 1 << 18
#: Parts whose counts a task holds before it passes them on.
HELD = 4096

CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|")] = True

#: (set of filters before, filter) as bits and a number: all that chains can ask for.
STEPS = [(s, f) for s in range(1 << len(LETTERS)) for f in range(len(LETTERS)) if not s >> f & 1]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each document of a buffer: whether it fails A to D."""
    n = len(off) - 1
    words, distinct, capitals, points = (np.zeros(n, np.int64) for _ in range(4))
    symbol = np.zeros(n, bool)
    held: list[np.ndarray] = []  # of a document in several parts, the different words so far
    for i, j, text, part, ended in word_parts(data, off, CHUNK):
        s, e, first = H.word_spans(text, part)
        h = H.span_hashes(text, s, e)
        words[i:j] += np.diff(first)
        for total, mask in ((capitals, CAPITAL[text]), (points, (text & 0xC0) != 0x80)):
            upto = np.concatenate([[0], np.cumsum(mask)])
            total[i:j] += upto[part[1:]] - upto[part[:-1]]
        upto = np.concatenate([[0], np.cumsum(SYMBOL[text])])
        symbol[i:j] |= upto[part[1:]] > upto[part[:-1]]
        if j - i == 1:
            held = [np.unique(np.concatenate([*held, h]))]
            if ended:
                distinct[i] = len(held.pop())
        else:
            doc = np.repeat(np.arange(j - i), np.diff(first))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
            distinct[i:j] = np.bincount(doc[new], minlength=j - i)
    fails = (words < LEAST_WORDS, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbol)
    return sum(x.astype(np.uint8) << k for k, x in enumerate(fails))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """__id, part, fails (bits of A to E) of each document."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(raw, 256)).alias("digest"), raw.alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(failures(*utf8(batch.column(3))).astype(np.int32))], ["__id", "part", "digest", "fails"])

    schema = f"__id {docs.schema[id_col].dataType.simpleString()}, part string, digest binary, fails int"
    rows = materialize(rows.mapInArrow(run, schema))
    copies = rows.groupBy("digest").agg(F.min("__id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copy = F.coalesce((F.col("__id") > F.col("least")).cast("int"), F.lit(0))
    return rows.join(copies, "digest", "left").select("__id", "part", (F.col("fails") + 16 * copy).alias("fails"))


def bitmap_counts(part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different parts, and COUNTS of each of STEPS for each (parts x steps x counts), of the rows of a task."""
    order = np.argsort(part, kind="stable")
    kinds, size = np.unique(part[order], return_counts=True)
    room = (size + 7) // 8  # each part begins at a byte of its own
    begin = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64)
    place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(8 * begin, size)

    def bits(flag: np.ndarray) -> np.ndarray:
        flat = np.zeros(8 * int(room.sum()), bool)
        flat[place] = flag[order]
        return np.packbits(flat)

    def count(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(x).astype(np.int64), begin)

    fail = [bits(fails >> f & 1 == 1) for f in range(len(LETTERS))]
    labels = [bits(good), bits(toxic)]
    alive = {0: bits(np.ones(len(part), bool))}
    for s in range(1, 1 << len(LETTERS)):
        f = s.bit_length() - 1
        alive[s] = alive[s ^ 1 << f] & ~fail[f]
    every = (1 << len(LETTERS)) - 1
    alone = [count(alive[every ^ 1 << f] & fail[f]) for f in range(len(LETTERS))]
    out = np.empty((len(kinds), len(STEPS), len(COUNTS)), np.int64)
    for k, (s, f) in enumerate(STEPS):
        gone = alive[s] & fail[f]
        out[:, k, 0] = count(alive[s | 1 << f])
        out[:, k, 1] = count(gone)
        out[:, k, 2] = count(fail[f] & ~alive[s])
        out[:, k, 3] = alone[f]
        for c, x in enumerate(labels):
            out[:, k, 4 + c] = count(gone & x)
    return kinds, out


def step_counts(rows: DataFrame) -> DataFrame:
    """part, before (bits), filter (number) and COUNTS over all rows (part, fails, good, toxic)."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            parts = list(held)
            flat = np.stack([held[p] for p in parts]).reshape(-1, len(COUNTS))
            steps = np.array(STEPS * len(parts), np.int32)
            cols = [pa.array(np.repeat(np.array(parts, object), len(STEPS)), pa.string()), pa.array(steps[:, 0]), pa.array(steps[:, 1]), *[pa.array(np.ascontiguousarray(flat[:, c])) for c in range(len(COUNTS))]]
            return pa.RecordBatch.from_arrays(cols, ["part", "before", "filter", *COUNTS])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("part").dictionary_encode()
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic")]
            kinds, counts = bitmap_counts(code.indices.to_numpy(), *flags)
            names = code.dictionary.to_pylist()
            for k, c in zip(kinds.tolist(), counts):
                held[names[k]] = held[names[k]] + c if names[k] in held else c
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.select("part", "fails", "good", "toxic").mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each part, order and step, with COUNTS and the shapley sum of the step's filter."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    rows = judged(docs, id_col, text, source)
    flag = [(F.coalesce(F.col(c), F.lit(0)) == 1).alias(c) for c in ("good", "toxic")]
    named, nameless = rows.where("__id IS NOT NULL"), rows.where("__id IS NULL")
    marked = named.join(known, "__id", "left").select("part", "fails", *flag).unionByName(nameless.select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    steps = materialize(step_counts(marked))  # 80 rows for each part
    # a set of k filters comes before a filter in k! (4 - k)! orders
    weight = [factorial(k) * factorial(len(LETTERS) - 1 - k) for k in range(len(LETTERS))]
    orders = F.element_at(F.array(*[F.lit(w) for w in weight]), (F.bit_count("before") + 1).cast("int"))
    shapley = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    chains = [("".join(LETTERS[f] for f in p), k + 1, sum(1 << f for f in p[:k]), p[k]) for p in permutations(range(len(LETTERS))) for k in range(len(LETTERS))]
    chains = steps.sparkSession.createDataFrame(chains, "filter_order string, step int, before int, filter int")
    out = steps.join(F.broadcast(chains), ["before", "filter"]).join(shapley, ["part", "filter"])  # chains: 600 rows
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same in DuckDB, from the counts of each part's 32 kinds of failures.
OP11_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM w),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT chr(65 + i::INT) AS c, (1 << i)::INT AS b FROM range(5) r(i)),
o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.b | q.b | r.b | s.b | t.b = 31),
k AS (SELECT filter_order, i::INT AS step, bits[i] AS b, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
c AS (
  SELECT part, filter_order, step, b,
    sum(CASE WHEN fails & (before | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & b <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & b <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley
FROM c
"""
