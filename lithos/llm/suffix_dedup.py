"""Exact substring dedup with sorted suffixes: front-coded runs, merged by common-prefix loser trees.

Which bytes lie in a string of `window` bytes that starts anywhere else, too? Only suffixes that can
matter are sorted. Window starts that share their least gram (`gram` bytes, chosen by the window's
content alone) form a reign; its suffix starts at the gram and ends with the last window. A gram
that the corpus has once ends the matter; its suffixes are never sent.

The other suffixes are sorted in each block, each followed by what stands before it, read
backwards, so that equal strings are reigns that are equal in full. A block's run is sent to ranges
of the order front-coded: of each suffix only what it doesn't share with the one before. A range
merges the runs of all blocks with a loser tree that keeps, for every head, its common prefix with
the last output: heads with different prefixes are ordered by those numbers alone, and equal ones
are compared from the end of the known prefix on. The output's own common prefixes say it all but
for the edges of passages:

* a suffix equal to a neighbour in full: all windows of the reign are repeated;
* a suffix that shares its gram with no different one: none is, but for the case above;
* suffixes that share the gram and differ: some windows may be repeated, others not.

Only for the last kind, one suffix for each different one, the windows themselves are compared by
128-bit hashes. Copies, however many, thus cost one suffix for each block that has them.

Beyond exchange.FAN blocks the merge has two levels: relays merge the runs of many blocks within a
coarse range, and the merged runs meet in its fine parts (by a hash of the gram).

Everything is judged on the input. Nulls and empty texts have no bytes. Matches never cross
documents, and texts of any length are treated whole (a long one in overlapping parts). Repeated rows are copies like others: both lose
what they share. An empty table gives no rows. A column of the input with the name of a result is
replaced by it.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm import exchange as X
from lithos.llm import hashing as H
from lithos.llm.common import block_table, in_order, materialize, n_blocks, segments, text_size, utf8

WINDOW = 200
GRAM = 40
CHUNK = 1 << 18
#: Suffixes that the border of a range is estimated from, suffixes taken of a document, and the least number of documents.
SAMPLE, SAMPLE_EACH, SAMPLE_DOCS = 30, 20, 400

REPEATED, LOOK = 1, 2
RUNS = "__shard int, __block int, a binary, b binary, c binary, d binary"


class Reigns:
    """The reigns of a block, chunk by chunk, always in the same order; places are in the block's bytes."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, gram: int):
        self.table = in_order(table, id_col)
        self.data, self.off = utf8(self.table[text_col])
        self.window = window
        got = []
        for lo, hi, off in segments(self.off, CHUNK, window - 1):
            first, last, at, g = H.reigns(H.BYTE[self.data[lo:hi]], off, window, gram)
            got.append((first + lo, last + lo, at + lo, g))
        cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        self.first, self.last, self.at, self.gram = cols

    def suffix(self, raw: bytes, k: int) -> bytes:
        """The suffix of a reign, then what stands before it backwards, then where the one ends."""
        first, last, at = self.first[k], self.last[k], self.at[k]
        end = last + self.window
        return raw[at:end] + raw[first:at][::-1] + int(end - at).to_bytes(4, "big")

    def sorted_run(self, chosen: np.ndarray):
        """The different suffixes of the chosen reigns in order, and the number of each reign's own."""
        raw = self.data.tobytes()
        every = [self.suffix(raw, k) for k in np.flatnonzero(chosen).tolist()]
        run = sorted(set(every))
        number = {s: i for i, s in enumerate(run)}
        return run, np.array([number[s] for s in every], np.int64)

    def windows(self, chosen: np.ndarray):
        """Starts of all windows of the chosen reigns, and two hashes of each."""
        start, _ = H.expand(self.first[chosen], self.last[chosen])
        one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        order = np.argsort(start, kind="stable")
        for lo, hi, _ in segments(self.off, CHUNK, self.window - 1):
            x, y = np.searchsorted(start[order], [lo, hi - self.window + 1])
            if y > x:
                mine = order[x:y]
                h = H.BYTE[self.data[lo:hi]]
                one[mine] = H.mix(H.window_hashes(h, self.window)[start[mine] - lo])
                two[mine] = H.mix(H.window_hashes(H.mix(h ^ H.ODD), self.window, H.BASE2)[start[mine] - lo])
        return start, one, two


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The common prefix of two strings that share `known` bytes."""
    top = min(len(a), len(b))
    step = 32
    while known < top and a[known : known + step] == b[known : known + step]:
        known = min(known + step, top)
    while known < top and a[known] == b[known]:
        known += 1
    return known


def front_code(run: list[bytes], shared: list[int], lo: int, hi: int):
    """Prefix lengths, lengths of the rest and the rests of run[lo:hi]; the first is sent in full."""
    prefix = [0, *shared[lo + 1 : hi]]
    return np.array(prefix, np.uint32).tobytes(), np.array([len(s) - p for s, p in zip(run[lo:hi], prefix)], np.uint32).tobytes(), b"".join(s[p:] for s, p in zip(run[lo:hi], prefix))


def decode(prefix: bytes, size: bytes, body: bytes):
    """Pairs (string, prefix it shares with the one before) of a front-coded run."""
    last, at = b"", 0
    for p, n in zip(np.frombuffer(prefix, np.uint32).tolist(), np.frombuffer(size, np.uint32).tolist()):
        last = last[:p] + body[at : at + n]
        at += n
        yield last, p


def merge(runs: list):
    """(run, string, common prefix with the string before) in order, of sorted runs of (string, prefix within the run)."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    known = [-1] * k  # with the last output; -1: no more
    for i, r in enumerate(runs):
        heads[i], known[i] = next(r, (None, -1))
    loser = [0] * k

    def meet(w: int, o: int) -> tuple[int, int]:
        """The winner and the loser of two heads whose prefixes with the last output are known."""
        if known[o] > known[w]:
            return o, w
        if known[o] == known[w] >= 0:
            a, b, h = heads[w], heads[o], known[w]
            h = common(a, b, h)
            if h < len(b) and (h == len(a) or a[h] < b[h]) or h == len(a) == len(b):
                known[o] = h
                return w, o
            known[w] = h
            return o, w
        return w, o

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, o = meet(build(2 * node), build(2 * node + 1))
        loser[node] = o
        return w

    w = build(1) if k > 1 else 0
    while known[w] >= 0:
        yield w, heads[w], known[w]
        heads[w], known[w] = next(runs[w], (None, -1))
        node = (w + k) // 2
        while node:
            w, loser[node] = meet(w, loser[node])
            node //= 2


def told(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table["kind"], kind))


def rows_of(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 4)], ["__shard", "__block", "a", "b", "c", "d"])


def count_grams(key: np.ndarray, _, n: np.ndarray):
    """Which grams the corpus has twice."""
    _, at = np.unique(key, return_inverse=True)
    return [(np.bincount(at, weights=n) > 1)[at].astype(np.uint8)], ()


def match_windows(a: np.ndarray, _, b: np.ndarray):
    """Which windows come twice among those that are sent."""
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    twice = np.zeros(len(a), np.uint8)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return [twice], ()


def merged(sent: pa.Table):
    """(suffix, prefix in common with the different one before, its places (run, number), several) of the runs of a table, in order."""
    a, b, c, d = (sent[x].to_pylist() for x in "abcd")
    at = [0] * len(a)
    last, prefix, group, several = b"", 0, [], False
    for r, s, shared in merge([decode(x, y, z) for x, y, z in zip(a, b, c)]):
        if not (group and shared == len(s) == len(last)):
            if group:
                yield last, prefix, group, several
            last, prefix, group, several = s, shared, [], False
        several = several or bool(group) or d[r][at[r]] > 0
        group.append((r, at[r]))
        at[r] += 1
    if group:
        yield last, prefix, group, several


def verdict(table: pa.Table, shard: int, sizes: list[int], flags: list[np.ndarray]) -> pa.Table:
    return X.answers(shard, table["__block"].to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), [np.concatenate(flags)], [np.uint8])


def merge_runs(gram: int):
    def run(key, table):
        sent = table.sort_by("__block")
        sizes = [len(x) // 4 for x in sent["a"].to_pylist()]
        out = [np.zeros(n, np.uint8) for n in sizes]
        kinds: list = []  # the different suffixes of one gram
        edge = True

        def close(last: bool) -> None:
            look = len(kinds) > 1 or edge or last
            for places, several in kinds:
                if several:
                    for r, i in places:
                        out[r][i] |= REPEATED
                if look:
                    out[places[0][0]][places[0][1]] |= LOOK

        for _, shared, places, several in merged(sent):
            if kinds and shared < gram:
                close(False)
                kinds, edge = [], False
            kinds.append((places, several))
        close(True)
        return verdict(sent, key[0].as_py(), sizes, out)

    return run


def relays(gram: int, spread: int):
    """The first level of a merge of many blocks: relay() deals a merged run to the fine ranges, back() hands their answers on."""
    fine = lambda s: zlib.crc32(s[:gram]) % spread

    def relay(key, table):
        group, coarse = key[0].as_py(), key[1].as_py()
        runs: dict = {}
        low = [0] * spread  # the least prefix in common since the last suffix of each fine range
        for s, shared, _, several in merged(table.sort_by("__block")):
            low = [min(x, shared) for x in low]
            f = fine(s)
            run, prefixes, flags = runs.setdefault(f, ([], [], bytearray()))
            run.append(s)
            prefixes.append(low[f] if len(run) > 1 else 0)
            flags.append(several)
            low[f] = len(s)
        return rows_of([(coarse * spread + f, group, *front_code(run, prefixes, 0, len(run)), bytes(flags)) for f, (run, prefixes, flags) in runs.items()])

    def back(key, table, replies):
        sent = table.sort_by("__block")
        sizes = [len(x) // 4 for x in sent["a"].to_pylist()]
        out = [np.zeros(n, np.uint8) for n in sizes]
        said = {s % spread: np.frombuffer(r[0], np.uint8) for s, r in zip(replies["shard"].to_pylist(), replies["reply"].to_pylist())}
        used = dict.fromkeys(said, 0)
        for s, _, places, _ in merged(sent):
            f = fine(s)
            flag = said[f][used[f]]
            used[f] += 1
            for r, i in places:
                out[r][i] |= flag & REPEATED
            out[places[0][0]][places[0][1]] |= flag & LOOK
        return verdict(sent, key[1].as_py(), sizes, out)

    return relay, back


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, output: str = "bytes", fan: int = X.FAN) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans; output "bytes": also kept (binary), "digest": kept_sha256 instead of the text."""
    made = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    names = [f for f in docs.schema if f.name not in made and not (output == "digest" and f.name == text)]
    plan = X.layout(n_blocks(text_size(docs, text)), fan)
    placed = block_table(docs.select(*[f.name for f in names], *([text] if output == "digest" else [])), id_col, text, plan.blocks)
    lean = placed.select(id_col, text, "__place", "__block")
    by_block = lean.groupBy("__block")
    parse = lambda table: Reigns(table, id_col, text, window, gram)

    def grams(key, table):
        kinds, n = np.unique(parse(table).gram, return_counts=True)
        return X.ask(key[0].as_py(), kinds, [np.minimum(n, 2).astype(np.uint8)], [np.uint8], plan)

    one, _ = X.exchange(by_block.applyInArrow(grams, X.SENT), plan, count_grams, [np.uint8], [np.uint8])
    one = one.withColumn("kind", F.lit(1))

    def twice(r: Reigns, replies: pa.Table) -> np.ndarray:
        kinds, at = np.unique(r.gram, return_inverse=True)
        return X.heard(told(replies, 1), kinds, [np.uint8])[0][at] > 0 if len(kinds) else np.zeros(0, bool)

    # borders of the (at most FAN) coarse ranges: from a bounded sample; they shift work, never results
    def sample(batches):
        for batch in batches:
            data, every = utf8(batch.column(text))
            raw = data.tobytes()
            got = []
            for i in range(len(every) - 1):
                places, kinds = [], []
                for lo, hi, off in segments(every[i : i + 2], CHUNK, window - 1):
                    _, _, at, g = H.reigns(H.BYTE[data[lo:hi]], off, window, gram)
                    places.append(at + lo)
                    kinds.append(g)
                at = np.unique(np.concatenate(places)[np.argsort(np.concatenate(kinds))[:SAMPLE_EACH]])
                got += [raw[x : x + 2 * gram] for x in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["s"])

    ranges = max(24, plan.coarse // 4) if not plan.two else plan.coarse
    wanted = max(SAMPLE_DOCS, SAMPLE * ranges // SAMPLE_EACH)
    n_docs = lean.count()
    seen = sorted(r["s"] for r in lean.select(text).sample(min(1.0, wanted / max(1, n_docs)), 1).mapInArrow(sample, "s binary").collect())
    seen = [bytes(seen[len(seen) * k // ranges]) for k in range(1, ranges)] if seen else []

    def runs(key, table, replies):
        r = parse(table)
        run, number = r.sorted_run(twice(r, replies))
        n = np.minimum(np.bincount(number, minlength=len(run)), 2) > 1
        shared = [0, *(common(x, y) for x, y in zip(run, run[1:]))]
        cut = [0, *(bisect_left(run, s) for s in seen), len(run)]
        return rows_of([(k, key[0].as_py(), *front_code(run, shared, cut[k], cut[k + 1]), n[cut[k] : cut[k + 1]].astype(np.uint8).tobytes()) for k in range(len(cut) - 1) if cut[k + 1] > cut[k]])

    asked = by_block.cogroup(one.groupBy("__block")).applyInArrow(runs, RUNS)
    if plan.two:
        two, _ = X.two_levels(asked, plan, merge_runs(gram), *relays(gram, plan.spread), RUNS)
    else:
        two = materialize(asked.groupBy("__shard").applyInArrow(merge_runs(gram), X.REPLY))
    two = two.withColumn("kind", F.lit(2))

    def verdicts(r: Reigns, replies: pa.Table):
        """For each reign: all its windows are repeated; and the reigns whose windows are compared."""
        chosen = np.flatnonzero(twice(r, replies))
        mask = np.zeros(len(r.gram), bool)
        mask[chosen] = True
        run, number = r.sorted_run(mask)
        said = X.load([x[0] for x in told(replies, 2).sort_by("shard")["reply"].to_pylist()], np.uint8)
        all_of = np.zeros(len(r.gram), bool)
        look = np.zeros(len(r.gram), bool)
        if len(run):
            all_of[chosen] = (said[number] & REPEATED) > 0
            _, first = np.unique(number, return_index=True)
            look[chosen[first]] = (said & LOOK) > 0
        return all_of, look

    def edges(key, table, replies):
        r = parse(table)
        _, look = verdicts(r, replies)
        _, a, b = r.windows(look)
        return X.ask(key[0].as_py(), a, [b], [np.uint64], plan)

    both = one.unionByName(two)
    asked = by_block.cogroup(both.groupBy("__block")).applyInArrow(edges, X.SENT)
    three, _ = X.exchange(asked, plan, match_windows, [np.uint64], [np.uint8])

    last = T.StructField("kept", T.BinaryType()) if output == "bytes" else T.StructField("kept_sha256", T.StringType())
    schema = T.StructType([*names, *[T.StructField(c, T.LongType()) for c in made[:3]], last])

    def remove(key, table, replies):
        r = parse(table)
        all_of, look = verdicts(r, replies)
        start, a, _ = r.windows(look)
        hit = X.heard(told(replies, 3), a, [np.uint8])[0] > 0 if len(a) else np.zeros(0, bool)
        begin = np.concatenate([r.first[all_of], start[hit]])
        end = np.concatenate([r.last[all_of], start[hit]]) + window
        gone = H.covered(len(r.data), begin, end)
        upto = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
        heads = gone.copy()
        heads[1:] &= ~gone[:-1]
        inner = r.off[:-1][r.off[:-1] < len(gone)]
        heads[inner] = gone[inner]
        spans = np.searchsorted(np.flatnonzero(heads), r.off)
        lo, hi = r.off[:-1], r.off[1:]
        rest = [r.data[x:y][~gone[x:y]].tobytes() for x, y in zip(lo.tolist(), hi.tolist())]
        out = pa.array(rest, pa.binary()) if output == "bytes" else pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())
        cols = [r.table[f.name] for f in names] + [pa.array(hi - lo), pa.array(upto[hi] - upto[lo]), pa.array(np.diff(spans)), out]
        return pa.table(cols, schema.names)

    return placed.groupBy("__block").cogroup(both.unionByName(three.withColumn("kind", F.lit(3))).groupBy("__block")).applyInArrow(remove, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, output="digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
