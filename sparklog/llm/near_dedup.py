"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find groups.

Documents of equal shingle sets are one class, named by its least doc_id.  Classes that
share a band are candidates.  First every class is held against three classes of its band,
however large the band is: the hub (the one that shares bands with most others, as the
original of many copies does), the least and the greatest; what is confirmed is grouped.

Then classes of bands that still hold different groups are joined by an exact prefix filter,
so that no link is lost, while a large band gives no pair for any two of its classes:
shingles are ordered by how rare they are among these classes (a sketch of counts; any order
gives the same result), similar sets share one among their first ``n - ceil(percent * n /
100) + 1``, and its places tell how many they can have in common at most.  Pairs within a
group would not change the result and are left out.  Every link is confirmed on the full
sets: ``100 * common >= percent * union``.

128 places in 32 bands of 4: two sets of similarity 0.75 share no band with probability 5e-6.

Null texts and texts without words have an empty set and are linked with nothing.  Very long
texts are taken whole, a batch of Arrow rows each.  An empty table gives an empty result, and
columns other than doc_id and text aren't looked at.  Rows that repeat a doc_id are one document, linked when any of its texts is.  Null doc_ids count as one id below all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, discard, materialize
from sparklog.llm.components import components
from sparklog.llm.shingles import shingle_sets
from sparklog.llm.superminhash import band_keys, signatures

BATCH_BYTES = 1 << 20
#: Buckets of the sketch of shingle counts.
BUCKETS = 1 << 18
_NO_ID = -(1 << 63)


def _sketches(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            elements, at = shingle_sets(batch.column(1), words)
            sig = signatures(elements, at, bands * rows)
            keys = band_keys(sig, rows).view(np.int64)
            size = np.diff(at)
            ids = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), pa.array(np.ascontiguousarray(keys).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), lists], names=["doc_id", "n_shingles", "set_id", "bands"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            elements, at = shingle_sets(batch.column(1), words)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "elements"])

    return df.mapInArrow(run, "node long, elements array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    other = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return pairs.join(one, "a").join(other, "b").where(100 * common >= percent * union).select("a", "b").distinct()


def _counts(sets: DataFrame) -> np.ndarray:
    """Per bucket of shingles how many of the sets hold one; BUCKETS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = sets.select("elements").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, i, key: the rarest shingles of each set, and the place of each among all of the set's."""
    level = sets.sparkSession.sparkContext.broadcast(np.log2(_counts(sets) + 1).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "elements", BATCH_BYTES):
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, level.value[flat & (BUCKETS - 1)], owner))
            place = np.arange(len(flat)) - at[owner]
            kept = place < (size + (-percent * size // 100) + 1)[owner]
            columns = [node[owner[kept]], size[owner[kept]], place[kept] + 1, flat[order][kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "i", "key"])

    return sets.select("node", "elements").mapInArrow(run, "node long, n long, i long, key long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    sketches = materialize(_sketches(texts, words, bands, rows), "sketches")
    first = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("bands", "bands"))]
    classes = materialize(sketches.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), *first), "classes")
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).where("least <> most")
    members = shared_bands = materialize(members.join(shared, "band"), "bands")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = members.select("band", "node").join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", F.bitwise_not("node").alias("inverse"))).alias("h"))
    hubs = hubs.select("band", F.bitwise_not("h.inverse").alias("hub"))
    needed = members.select("node").distinct()
    chosen = texts.join(needed.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = materialize(_sets(chosen, words), "sets")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    centres = F.explode(F.array("hub", "least", "most")).alias("centre")
    stars = materialize(members.join(hubs, "band").select("node", centres).where("node <> centre").select(*pair("node", "centre")).distinct(), "stars")
    links = materialize(_confirmed(stars, sets, percent), "confirmed")
    like = f"100 * least(x.n, y.n) >= {int(percent)} * greatest(x.n, y.n)"

    # classes of bands that hold more than one group still
    named = members.join(components(links), "node", "left").select("band", "node", F.coalesce("component", "node").alias("group"))
    mixed = named.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("band")
    groups = materialize(named.join(mixed, "band", "left_semi").select("node", "group").distinct(), "groups")
    left = sets.join(groups, "node", "left_semi")
    postings = materialize(_prefixes(left, percent).join(groups, "node"), "postings")
    least = f"ceil({int(percent)} * (x.n + y.n) / {100 + int(percent)}.0 - 1e-9)"
    rest = postings.alias("x").join(postings.alias("y"), F.expr(f"x.key = y.key and x.group < y.group and {like} and least(x.n - x.i, y.n - y.i) + 1 >= {least}"))
    rest = materialize(rest.select(*pair("x.node", "y.node")).distinct(), "rest")
    more = materialize(_confirmed(rest, sets, percent), "confirmed")
    discard(stars, rest, postings, groups, shared_bands, sets)
    groups = materialize(components(links.union(more)), "groups")
    discard(links, more)

    named = classes.select("set_id", "node").join(groups, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    real = lambda c: F.nullif(c, F.lit(_NO_ID))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("component_id")).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
