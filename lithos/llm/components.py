"""Connected components of a table of links, by label propagation with pointer jumping.

Up to FILE_ROWS links are one part, whose components its task gives at once. More are first thinned to
spanning forests of such parts, so a group's edges follow its nodes, not its pairs; what is left then
goes by rounds, unless it fits a part. Every round is two joins and two aggregations with partial sums, whatever the degree of a
node, so a hub's links are never together in one task. Labels fall to the least id that a node can reach
through its neighbours and their labels; the number of rounds grows with the logarithm of a
component's breadth for trees of the kind that the near-duplicate operators give.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import materialize, release

#: Links in a part or a file: rounds write as many files as the links need, whatever the partitions of a shuffle.
FILE_ROWS = 1 << 20


def joined(batches):
    """Of a part's links (a, b): the nodes, the root of each (the least of its component), both ends, and the links of a spanning forest."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, keep = list(range(len(node))), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return node, node[[find(x) for x in range(len(node))]], a, b, keep


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join what the given ones join: a spanning forest of each part of FILE_ROWS links or so.

    A group's links may be many times its nodes; of a part's links at most one fewer than its nodes stay.
    Parts are formed anew while that takes away half of the links, so a large group's parts meet.
    """

    def run(batches):
        _, _, a, b, keep = joined(batches)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    n, made = links.count(), None
    while True:
        out = materialize(links.repartition(max(1, math.ceil(n / FILE_ROWS))).mapInArrow(run, "a long, b long"))
        left = out.count()
        if made is not None:
            release(made)
        links, made = out, out
        if n <= FILE_ROWS or 2 * left > n:
            return out
        n = left


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id reachable, for the nodes that have a link."""

    def whole(batches):
        node, root, *_ = joined(batches)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    n = links.count()
    if n > FILE_ROWS:
        links = forest(links)
        n = links.count()
    if n <= FILE_ROWS:
        out = materialize(links.repartition(1).mapInArrow(whole, "node long, component long"))
        release(links)
        return out
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges = materialize(edges)
    release(links)
    files = max(1, math.ceil(edges.count() / FILE_ROWS))
    labels = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("l")).repartition(files))
    while True:
        # the least label among the neighbours
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("l").alias("ln")), "y").groupBy("x").agg(F.min("ln").alias("ln"))
        new = labels.join(near, "x").select("x", F.col("l").alias("old"), F.least("l", "ln").alias("m"))
        # each old label's node learns the new one, too: whole trees hook on at once
        hook = new.groupBy(F.col("old").alias("x")).agg(F.min("m").alias("h"))
        new = new.join(hook, "x", "left").select("x", "old", F.least("m", F.coalesce("h", "m")).alias("m"))
        new = materialize(new.repartition(files))
        # pointer jumping: the label of the label
        jump = new.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        step = materialize(new.join(jump, "m", "left").select("x", F.least("m", F.coalesce("mm", "m")).alias("l"), "old").repartition(files))
        moved = step.where("l <> old").limit(1).count()
        release(labels, new)
        labels = step
        if not moved:
            release(edges)
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
