"""Byte-level BPE, encoding and decoding, with a rank queue in a hierarchical bitmap.

``merge_all`` keeps the parts of pre-tokens in a linked list, all pre-tokens of a batch in one
array.  Each merge rank has a bucket of list positions where that merge became possible.  A
bitmap of two levels tells which buckets hold something: a root over leaves of ``1 << _SHIFT``
ranks each, and find-first-set (``x & -x``) in both gives the lowest rank.  An entry whose parts
have changed meanwhile is stale and skipped.  Pre-tokens don't touch each other, so the lowest
rank of all is the lowest of its own; large buckets are merged by NumPy at once, small ones one
by one.  Where a merge makes a lower rank possible, the rest of the bucket waits for it, as in
the library.  Work is the number of merges times the depth of the bitmap, so very long
pre-tokens cost no more per byte than short ones.

Null texts count as empty: no ids.  Ids decode to the exact bytes of the text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes
from sparklog.llm.pieces import PieceCache

BATCH_BYTES = 4 << 20
_SHIFT = 8
_LOW = (1 << _SHIFT) - 1
#: Positions of one rank from which NumPy merges them.
_MANY = 24
#: Ids and ranks are below this many bits.
_ID_BITS = 24


class Vocabulary:
    """Ranks of byte strings; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Rank of two parts joined, by ``left << _ID_BITS | right``: of all that can be joined.
        self.pairs: dict[int, int] = {}
        get = ranks.get
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left = get(whole[:cut])
                if left is not None and (right := get(whole[cut:])) is not None:
                    self.pairs[left << _ID_BITS | right] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.key_ranks = np.array([self.pairs[k] for k in self.keys.tolist()] or [-1], np.int32)
        self.of_bytes = np.array([get(bytes([x, y]), -1) for x in range(256) for y in range(256)], np.int32)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each two parts joined, -1 if the vocabulary hasn't it."""
        if not len(self.keys):
            return np.full(len(right), -1, np.int32)
        key = (np.asarray(left, np.int64) << _ID_BITS) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        return tuple(np.frombuffer(self.merge_all([data])[0], np.int32).tolist())

    def merge_all(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as bytes of 32-bit numbers: the lowest rank first, of equal ranks the leftmost."""
        out: list = [self.ranks.get(t) for t in tokens]
        todo = [i for i, x in enumerate(out) if x is None and tokens[i]]
        out = [b"" if x is None else x.to_bytes(4, "little") for x in out]
        if not todo:
            return out
        data = np.frombuffer(b"".join([tokens[i] for i in todo]), np.uint8)
        n, size = len(data), np.array([len(tokens[i]) for i in todo])
        end = np.cumsum(size)
        # position n stands for none
        part = np.append(self.single[data], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[end - 1], before[end - size], after[n], before[n] = n, n, n, n
        rank_at = np.full(n + 1, -1, np.int32)
        rank_at[: n - 1] = self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank_at[end - 1] = -1
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}  # bits of the ranks that have a bucket, by the ranks' upper bits
        root = 0  # bits of the leaves that have a bit
        fresh_at = np.flatnonzero(rank_at >= 0)
        fresh = zip(rank_at[fresh_at].tolist(), fresh_at.tolist(), strict=True)
        one_part, one_after, one_before, one_rank = (memoryview(x) for x in (part, after, before, rank_at))
        pairs = self.pairs
        while True:
            for rank, i in fresh:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    a = rank >> _SHIFT
                    leaves[a] = leaves.get(a, 0) | 1 << (rank & _LOW)
                    root |= 1 << a
            if not root:
                break
            top = root & -root
            a = top.bit_length() - 1
            bits = leaves[a]
            low = bits & -bits
            rank = a << _SHIFT | low.bit_length() - 1
            leaves[a] = bits ^ low
            if bits == low:
                root ^= top
            bucket = buckets.pop(rank)
            if len(bucket) >= _MANY:
                fresh = self._merge_many(rank, np.unique(bucket), part, after, before, rank_at, end)
                continue
            if len(bucket) > 1:
                bucket.sort()
            fresh = []
            for at, i in enumerate(bucket):
                if one_rank[i] != rank:
                    continue  # stale
                j = one_after[i]
                k, h = one_after[j], one_before[i]
                one_part[i], one_part[j], one_after[i], one_rank[j] = rank, -1, k, -1
                least = rank
                new = -1
                if k < n:
                    one_before[k] = i
                    new = pairs.get(rank << _ID_BITS | one_part[k], -1)
                    if new >= 0:
                        fresh.append((new, i))
                        if new < least:
                            least = new
                one_rank[i] = new
                if h < n:
                    one_rank[h] = new = pairs.get(one_part[h] << _ID_BITS | rank, -1)
                    if new >= 0:
                        fresh.append((new, h))
                        if new < least:
                            least = new
                if least < rank:  # it goes before the rest of this one
                    fresh += [(rank, x) for x in bucket[at + 1 :]]
                    break
        alive = part[:n] >= 0
        ids = part[:n][alive].astype("<i4").tobytes()
        stop = (4 * np.cumsum(alive)[end - 1]).tolist()
        begin = 0
        for i, e in zip(todo, stop, strict=True):
            out[i] = ids[begin:e]
            begin = e
        return out

    def _merge_many(self, rank: int, at: np.ndarray, part: np.ndarray, after: np.ndarray, before: np.ndarray, rank_at: np.ndarray, end: np.ndarray):
        """Merge all of a bucket's positions that aren't stale; the (rank, position) that become possible."""
        n = len(part) - 1
        every = at = at[rank_at[at] == rank]
        if not len(at):
            return []
        follows = np.append(False, after[at[:-1]] == at[1:])
        if follows.any():  # of overlapping ones every second, from the left
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
        second = after[at]
        third, left = after[second], before[at]
        # what becomes possible between two merges, if they went from left to right one by one
        left_id = np.where(np.append(False, left[1:] == second[:-1]), rank, part[left])
        waiting = []
        for new in (self._joined(rank, part[third]), self._joined(left_id, rank)):
            if ((new >= 0) & (new < rank)).any():
                own = np.searchsorted(end, every, side="right")
                first = np.append(True, own[1:] != own[:-1])
                waiting = [(rank, i) for i in every[~first].tolist()]
                at = every[first]
                second = after[at]
                third = after[second]
                break
        part[at], part[second], after[at], rank_at[second] = rank, -1, third, -1
        before[third] = at
        left = before[at]
        right_new = np.where(third < n, self._joined(rank, part[third]), -1)
        left_new = np.where(left < n, self._joined(part[left], rank), -1)
        rank_at[at] = right_new
        rank_at[left] = left_new
        rank_at[n] = -1
        r, l = right_new >= 0, left_new >= 0
        made = zip(np.concatenate([right_new[r], left_new[l]]).tolist(), np.concatenate([at[r], left[l]]).tolist(), strict=True)
        return [*made, *waiting]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Table:
    """Byte strings by id, to be gathered for a whole text at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.blob[np.arange(total) + np.repeat(self.at[ids] - (end - size), size)]


@functools.cache
def _tables(path: str) -> tuple[Table, Table]:
    """The bytes of each id, and each id as a decimal and a comma."""
    v = vocabulary(path)
    n = max(v.bytes) + 1
    return Table([v.bytes.get(i, b"") for i in range(n)]), Table([b"%d," % i for i in range(n)])


@functools.cache
def _id_cache(path: str) -> PieceCache:
    v = vocabulary(path)
    return PieceCache(lambda words: v.merge_all([w.encode() for w in words]), b"".join)


def encode_texts(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text."""
    for row in _id_cache(path).batch(texts):
        yield np.frombuffer(b"".join(row), np.int32)


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    return _tables(path)[0].gather(ids).tobytes()


def bpe_round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids if ``keep_ids``) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = _tables(path)[1]
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            n, ids_sha, text_sha, kept = [], [], [], []
            for ids in encode_texts(path, batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.gather(ids)[:-1].tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(path, ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], names=[*names, *(["ids"] if keep_ids else [])])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
