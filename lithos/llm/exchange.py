"""The exchange between blocks of documents and shards of keys that several operators use.

Documents are dealt into *blocks* of one size, whatever the corpus. Each block sends its keys, sorted
and packed, to *shards*, which are ranges of keys; a shard looks at the keys of all senders together
and answers each with packed arrays in the order of its keys. A key that occurs everywhere therefore
costs one entry for each block, whatever the number of its occurrences, and no row of Spark stands
for a single key.

Rows between blocks and shards would grow with the square of the corpus. So beyond FAN blocks the
exchange has two levels: a block sends to FAN coarse shards, a relay takes what FAN blocks sent to
one coarse shard and deals it to that shard's fine ones, and the answers go the same way back. With
FAN = 4096 and blocks of 4 MB no task holds much more than a few blocks' keys up to 64 TB.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import materialize

#: The most shards that a block sends to, and blocks that a relay serves.
FAN = 4096
#: Blocks' worth of keys in a shard of the second level.
DEEP = 4
SENT = "__shard int, __block int, keys binary, more array<binary>"
REPLY = "__block int, shard int, reply array<binary>, stats array<long>"
#: Numbers that are mostly below 255 travel as a byte each.
COUNT = "count"


class Layout(NamedTuple):
    blocks: int
    coarse: int
    spread: int
    fan: int

    @property
    def shards(self) -> int:
        return self.coarse * self.spread

    @property
    def two(self) -> bool:
        return self.blocks > self.fan


def layout(blocks: int, fan: int = FAN) -> Layout:
    if blocks <= fan:
        return Layout(blocks, blocks, 1, fan)
    shards = max(fan, math.ceil(blocks / DEEP))
    return Layout(blocks, fan, math.ceil(shards / fan), fan)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as many bytes as the largest needs."""
    d = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    body = np.ascontiguousarray(d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + d[:1].tobytes() + body.tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw, np.uint64, 1, 1)
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[1:, :width] = body
    d = d.view("<u8").ravel()
    d[0] = first[0]
    return np.cumsum(d, dtype=np.uint64)


def dump(x: np.ndarray, kind) -> bytes:
    """An array as bytes; counts as a byte each, with the few of 255 and more after them as 64 bits."""
    if kind != COUNT:
        return np.ascontiguousarray(x, kind).tobytes()
    big = np.flatnonzero(x >= 255).astype(np.uint32)
    return len(big).to_bytes(4, "little") + big.tobytes() + x[big].astype(np.uint64).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def load(raw: list[bytes], kind) -> np.ndarray:
    if kind != COUNT:
        return np.frombuffer(b"".join(raw), kind)
    parts = []
    for r in raw:
        n = int.from_bytes(r[:4], "little")
        x = np.frombuffer(r, np.uint8, offset=4 + 12 * n)
        if n:
            x = x.astype(np.uint64)
            x[np.frombuffer(r, np.uint32, n, 4)] = np.frombuffer(r[4 + 4 * n : 4 + 12 * n], np.uint64)
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def cuts(first: int, last: int, shards: int) -> np.ndarray:
    """The first keys of shards first..last - 1 of all."""
    return np.array([2**64 * k // shards for k in range(first, last)], np.uint64)


def messages(sender: int, key: np.ndarray, more: list[np.ndarray], kinds, shards: int, first: int = 0, last: int | None = None) -> pa.Table:
    """A row for each shard that gets some of the sorted keys."""
    last = shards if last is None else last
    cut = np.append(np.searchsorted(key, cuts(first, last, shards)), len(key)).tolist()
    rows = [(k, sender, squeeze(key[a:b]), [dump(x[a:b], t) for x, t in zip(more, kinds)]) for k, a, b in zip(range(first, last), cut, cut[1:]) if b > a]
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())))], ["__shard", "__block", "keys", "more"])


def ask(sender: int, key: np.ndarray, more: list[np.ndarray], kinds, plan: Layout) -> pa.Table:
    """What a block sends: its keys, in any order, and what goes with each."""
    order = np.argsort(key, kind="stable")
    return messages(sender, key[order], [x[order] for x in more], kinds, plan.coarse)


def heard(table: pa.Table, key: np.ndarray, kinds) -> list[np.ndarray]:
    """The answers to a block, in the order of the keys that it asked with."""
    order = np.argsort(key, kind="stable")
    parts = table.sort_by("shard")["reply"].to_pylist()
    out = []
    for k, t in enumerate(kinds):
        got = load([p[k] for p in parts], t)
        x = np.empty(len(key), got.dtype)
        x[order] = got
        out.append(x)
    return out


def received(table: pa.Table, kinds):
    """Keys, sender of each and what goes with them, in order of sender; the senders, and where each begins."""
    table = table.sort_by("__block")
    parts = [unsqueeze(x) for x in table["keys"].to_pylist()]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    more = table["more"].to_pylist()
    blocks = table["__block"].to_numpy()
    return np.concatenate(parts), np.repeat(blocks, np.diff(cut)).astype(np.int32), [load([m[k] for m in more], t) for k, t in enumerate(kinds)], blocks, cut


def answers(shard: int, blocks, cut, replies, kinds, stats=()) -> pa.Table:
    n = len(blocks)
    rows = [[dump(x[cut[i] : cut[i + 1]], t) for x, t in zip(replies, kinds)] for i in range(n)]
    return pa.table({"__block": pa.array(blocks, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "reply": pa.array(rows, pa.list_(pa.binary())), "stats": pa.array([list(map(int, stats))] + [None] * (n - 1), pa.list_(pa.int64()))})


def exchange(sent: DataFrame, plan: Layout, work, kinds, replies) -> tuple[DataFrame, DataFrame]:
    """(answers, answers with stats): REPLY tables of what work made of the keys of each shard.

    work(key, sender, *more) gives the arrays of answers, in order, and a list of numbers for the
    shard; kinds and replies name the types of what goes with the keys and of the answers.
    """
    inner = [*kinds, np.int32] if plan.two else kinds

    def shard(key, table):
        k, sender, more, blocks, cut = received(table, inner)
        if plan.two:
            sender = more.pop()
        out, stats = work(k, sender, *more)
        return answers(key[0].as_py(), blocks, cut, out, replies, stats)

    if not plan.two:
        told = materialize(sent.groupBy("__shard").applyInArrow(shard, REPLY))
        return told, told

    def relay(key, table):
        k, sender, more, _, _ = received(table, kinds)
        order = np.argsort(k, kind="stable")
        first = key[1].as_py() * plan.spread
        return messages(key[0].as_py(), k[order], [x[order] for x in (*more, sender)], inner, plan.shards, first, first + plan.spread)

    def back(key, table, told):
        k, _, _, blocks, cut = received(table, kinds)
        return answers(key[1].as_py(), blocks, cut, heard(told, k, replies), replies)

    return two_levels(sent, plan, shard, relay, back, SENT)


def two_levels(sent: DataFrame, plan: Layout, shard, relay, back, schema: str) -> tuple[DataFrame, DataFrame]:
    """Blocks to coarse shards, relays to fine ones, and the answers back."""
    group = F.floor(F.col("__block") / plan.fan).cast("int").alias("__group")
    sent = materialize(sent)
    low = sent.select(group, "*")
    told = materialize(low.groupBy("__group", "__shard").applyInArrow(relay, schema).groupBy("__shard").applyInArrow(shard, REPLY))
    up = told.select(F.col("__block").alias("__group"), F.floor(F.col("shard") / plan.spread).cast("int").alias("__coarse"), "shard", "reply")
    return materialize(low.groupBy("__group", "__shard").cogroup(up.groupBy("__group", "__coarse")).applyInArrow(back, REPLY)), told
