"""Connected components of a link table, by union-find in each partition and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: a link from each node to the least of its group."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, r) for x in parent if (r := find(x)) != x]
    for k in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[k : k + 10_000]], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node that can be reached) of each node that has a link to another.

    Each round contracts stars: all larger neighbours of a node, then all smaller ones, are
    linked to its least neighbour.  Links stay distributed; the driver sees a sum of hashes per round.
    """
    start = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialize(start.mapInArrow(_forest, "u long, v long").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.where("u <> v").distinct(), "links")
        discard(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
