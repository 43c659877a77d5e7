"""Benchmark decontamination: BM25 over the test items with block-max pruning, then overlap of question and answer.

The test items are the index, every passage of every document is a query.  A passage is a
window of ``WINDOW`` words, each half a window after the one before; items longer than half
a window make the window longer, so each item lies whole within some passage.  An item is
retrieved when the passage's BM25 score reaches ``SHARE`` of the score the item has for
itself.  An item's lightest terms, ``COMMON`` of its score, are its common ones; the other,
telling terms have posting lists, cut into blocks of items with the greatest weight in each.
Items are in order of their score, so those of a block want about the same.  First the block
maxima of a passage's terms are added up for many passages at once; those that reach the least
score wanted in no block are done.  For the others block-max WAND walks the posting lists: the
pivot is the first item that the lists' greatest weights can bring to the threshold, its block's
maxima are asked next, and only then is the item scored.  Nothing above the threshold is missed.

A retrieved item counts as leaked when, around the passage, at least ``percent`` of the 5-word
shingles of its question and half of those of its answer appear, or ``percent`` of those of
the whole item.  The answer is the item's last sentence, the question all before; an item of
one sentence is a question alone.

Words are runs of ASCII letters, digits, underscores and whatever is beyond ASCII, lower-cased.  Items of fewer than 5 words can't be told from chance and match
nothing, nor do null or empty texts.  Items are broadcast, about ``SHARD`` at a time; more items
make more passes over the documents, with the same result: document frequencies and the mean
length are those of all items.  Very long documents are taken whole.  Rows that repeat a doc_id
are asked each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, materialize

BATCH_BYTES = 4 << 20
WINDOW, SHARE = 128, 0.6
#: Share of an item's own score that its common terms may hold.
COMMON = 0.3
#: Items of one index, and of one block of it.
SHARD, BLOCK = 2000, 4
_K1, _B = 1.2, 0.75
#: Bytes that words consist of stay, all others become blanks.
_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?:\n])\s*(\S.*?)$")


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    found = _LAST_SENTENCE.match(text.strip())
    question, answer = (words(found[1]), words(found[2])) if found else (words(text), [])
    return (question, answer) if len(question) >= 5 else (question + answer, [])


def _shingles(own: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(5, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


class ItemIndex:
    """Of ``items`` (id, text); ``df``, ``n`` and ``mean`` are of all items, where these are only some."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int] | None = None, n: int | None = None, mean: float | None = None):
        kept = sorted((i, t) for i, t in items if len(words(t)) >= 5)
        parts = [question_and_answer(t) for _, t in kept]
        texts = [q + a for q, a in parts]
        self.longest = max(map(len, texts), default=0)
        if df is None:
            df, n, mean = dict(Counter(w for t in texts for w in set(t))), len(texts), sum(map(len, texts)) / max(1, len(texts))
        number: dict[bytes, int] = {}
        for t in texts:
            for w in t:
                number.setdefault(w, len(number))
        self.number = number
        weights: list[dict[int, float]] = []  # of the terms of each item
        for t in texts:
            own: dict[int, float] = {}
            for w, tf in Counter(t).items():
                idf = math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
                own[number[w]] = idf * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(t) / mean))
            weights.append(own)
        order = sorted(range(len(kept)), key=lambda i: sum(weights[i].values()))
        self.ids, self.weights = [kept[i][0] for i in order], [weights[i] for i in order]
        self.shingles = [(_shingles(q), _shingles(a), _shingles(q + a)) for q, a in (parts[i] for i in order)]
        self.wanted = [SHARE * sum(w.values()) for w in self.weights]
        n_blocks = -(-len(order) // BLOCK)
        self.least = np.array(self.wanted[::BLOCK])
        self.common = np.zeros(n_blocks)
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, own in enumerate(self.weights):
            left, held = COMMON * sum(own.values()), 0.0
            for t, x in sorted(own.items(), key=lambda p: (p[1], p[0])):
                if held + x <= left:
                    held += x
                else:
                    left = -1.0
                    lists.setdefault(t, []).append((i, x))
            self.common[i // BLOCK] = max(self.common[i // BLOCK], held)
        self.telling = np.full(len(number) + 1, -1, np.int64)  # the last is for unknown words
        self.telling[list(lists)] = np.arange(len(lists))
        self.postings: list[list[int]] = []  # items of each telling term
        self.peaks: list[dict[int, float]] = []  # and its greatest weight in each block
        for own in lists.values():
            self.postings.append([i for i, _ in own])
            peak: dict[int, float] = {}
            for i, x in own:
                peak[i // BLOCK] = max(peak.get(i // BLOCK, 0.0), x)
            self.peaks.append(peak)
        self.top = [max(p.values()) for p in self.peaks]
        self.peak_at = np.concatenate([[0], np.cumsum([len(p) for p in self.peaks], dtype=np.int64)])
        self.peak_block = np.array([b for p in self.peaks for b in p], np.int64)
        self.peak_weight = np.array([x for p in self.peaks for x in p.values()])

    def _hopeful(self, window: np.ndarray, rank: np.ndarray) -> set[int]:
        """Windows whose terms' block maxima reach the least score wanted in some block."""
        n = np.diff(self.peak_at)[rank]
        at = np.repeat(self.peak_at[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, inverse = np.unique(np.repeat(window, n) * len(self.least) + self.peak_block[at], return_inverse=True)
        block = key % len(self.least)
        bound = np.bincount(inverse, self.peak_weight[at], len(key)) + self.common[block]
        return set((key[bound >= self.least[block] * (1 - 1e-9)] // len(self.least)).tolist())

    def search(self, terms: set[int]) -> Iterator[tuple[int, float]]:
        """Items whose score for a passage of ``terms`` reaches what they want, and the score: block-max WAND."""
        lists = [(self.postings[r], 0, r) for r in sorted(int(self.telling[t]) for t in terms if t >= 0) if r >= 0]
        spare = float(self.common.max(initial=0.0))
        while lists:
            lists.sort(key=lambda x: x[0][x[1]])
            bound, wanted = spare, self.wanted[lists[0][0][lists[0][1]]] * (1 - 1e-9)
            pivot = -1
            for k, (_, _, r) in enumerate(lists):
                bound += self.top[r]
                if bound >= wanted:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = lists[pivot][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]] == item:
                pivot += 1
            block = item // BLOCK
            bound = float(self.common[block]) + sum(self.peaks[r].get(block, 0.0) for _, _, r in lists[: pivot + 1])
            if bound < self.wanted[block * BLOCK] * (1 - 1e-9):
                onward = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    onward = min(onward, lists[pivot + 1][0][lists[pivot + 1][1]])
            else:
                onward = item
                if lists[0][0][lists[0][1]] == item:
                    score = sum(x for t, x in self.weights[item].items() if t in terms)
                    if score >= self.wanted[item] - 1e-9:
                        yield item, score
                    onward = item + 1
            moved = [(p, bisect_left(p, onward, at), r) for p, at, r in lists[: pivot + 1]]
            lists = [x for x in moved if x[1] < len(x[0])] + lists[pivot + 1 :]

    def retrieve(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, end word, item, share of its own score) of all passages that reach an item's threshold."""
        if not self.ids:
            return
        half = max(WINDOW // 2, self.longest)
        get, missing = self.number.get, repeat(-1)
        terms = [np.fromiter(map(get, t, missing), np.int64, len(t)) for t in texts]
        first, keys, starts = 0, [], []
        n_telling = len(self.postings)
        for own in terms:
            rank = self.telling[own]
            at = np.flatnonzero(rank >= 0)
            if len(at):
                here = at // half
                keys.append((first + here) * n_telling + rank[at])
                keys.append((first + np.maximum(here - 1, 0)) * n_telling + rank[at])
            starts.append(first)
            first += max(1, -(-len(own) // half))
        if not keys:
            return
        pairs = np.unique(np.concatenate(keys))
        for w in sorted(self._hopeful(pairs // n_telling, pairs % n_telling)):
            i = bisect_right(starts, w) - 1
            a = (w - starts[i]) * half
            for item, score in self.search(set(terms[i][a : a + 2 * half].tolist())):
                yield i, a, a + 2 * half, item, score * SHARE / self.wanted[item]

    def leaks(self, texts: list[list[bytes]], percent: int) -> list[dict[int, tuple[float, float, float]]]:
        """For each text its leaked items: share of BM25, of question and of answer, of the best passage."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for i, a, b, item, share in self.retrieve(texts):
            there = _shingles(texts[i][max(0, a - self.longest) : b + self.longest])
            question, answer, whole = self.shingles[item]
            q = len(question & there) / len(question)
            if not answer:
                r = 1.0
            elif len(next(iter(answer))) == 5:
                r = len(answer & there) / len(answer)
            else:  # a short answer is one run of words
                run = next(iter(answer))
                around = texts[i][max(0, a - self.longest) : b + self.longest]
                r = float(any(tuple(around[k : k + len(run)]) == run for k in range(len(around))))
            if 100 * q >= percent and r >= 0.5 or 100 * len(whole & there) >= percent * len(whole):
                found = (round(min(share, 1.0), 6), q, r)
                out[i][self.ids[item]] = max(found, out[i].get(self.ids[item], found))
        return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, w, len(own)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(own := words(t)) >= 5 for w in set(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "word", "n"])


def indexes(items: DataFrame, shard: int = SHARD) -> Iterator[ItemIndex]:
    """Indexes of all items (item_id, text), of about ``shard`` items each; the driver holds one at a time."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = -(-items.count() // shard)
    if n <= 1:
        yield ItemIndex([tuple(r) for r in items.collect()])
        return
    terms = materialize(items.mapInArrow(_terms, "item_id long, word binary, n long"), "terms")
    sizes = terms.groupBy("item_id").agg(F.max("n").alias("n")).agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    df = materialize(terms.groupBy("word").agg(F.count("*").alias("df")), "df")
    part = lambda k: F.pmod(F.xxhash64("item_id"), F.lit(n)) == k
    for k in range(n):
        own = df.join(terms.where(part(k)), "word", "left_semi").collect()
        yield ItemIndex([tuple(r) for r in items.where(part(k)).collect()], {bytes(r.word): r.df for r in own}, sizes["items"], sizes["mean"])


def leaked(docs: DataFrame, items: DataFrame, percent: int = 75, shard: int = SHARD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each item that a document holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, shard):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", BATCH_BYTES):
                found = shared.value.leaks([words(t) for t in batch.column(1).to_pylist()], percent)
                rows = [(d, i, *x) for d, own in zip(batch.column(0).to_pylist(), found, strict=True) for i, x in sorted(own.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=names)

        out = out.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 75, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold none of ``items``, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(items, shard):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", BATCH_BYTES):
                found = shared.value.leaks([words(t) for t in batch.column(at).to_pylist()], percent)
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
