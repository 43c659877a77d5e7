"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors over an inverted index.

``fit`` takes a bounded sample of labelled texts.  Terms are lower-case words and word
beginnings of 4 to 7 letters.  Each example is a vector of ``(1 + log tf) * idf * evidence``
over all of them, of length 1; no term is cut for its count, and there is no greatest number.
The evidence of a term is the square of its chi-square (with half an example less of label 1)
times what its share of label 1 exceeds the sample's by; so a term that doesn't lean to label 1
weighs 0, and needs no place in the index.  A query adds up the postings of its terms, those of
the greatest possible share first, until what is left can't change the ``k`` nearest: what the other terms can add to
the examples of a block is known from their greatest weights in it (block maxima).  What may
still be among the nearest is scored in full.  So they are exact, ties going to the lower id.  Votes weigh
``1 / (distance + 0.1)``.  The share of votes is calibrated by isotonic regression on the
examples themselves, each without its own vote.

A text without any term of weight (an empty or null one, too) has no neighbour: its score is the
share of label 1 among such examples (and one more, of the sample's share), and its evidence is empty.  Null labels teach nothing;
of repeated labels the highest counts.  Without examples every score is 0.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, crc_bucket, materialize

BATCH_BYTES = 1 << 20
#: Labelled rows that ``fit`` reads at most, the first by a hash of the id.
SAMPLE = 12_000
NEIGHBOURS = 15
#: What the terms left may add to a cosine when a query looks whether it can stop; how many examples it then scores in full at most.
_LEFT, _IN_FULL = (0.1, 0.01, 0.001), 100
#: Examples of a block, and postings from which a term has maxima by block beside the one of all.
_BLOCK, _LISTED = 64, 32
#: A document is toxic from this score.
TOXIC = 0.3
_BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in _BEGINNINGS if len(word) > n)]


def term_code(term: str) -> int:
    """Terms are held as 64-bit hashes: a number each, where text would fill the workers."""
    return xxhash.xxh64_intdigest(term.encode())


class TermFinder:
    """Kept terms of texts with their frequency; words met before aren't looked at again."""

    def __init__(self, kept: np.ndarray, limit: int = 100_000):
        """``kept`` has the sorted codes of the terms."""
        self.kept, self.limit = kept, limit
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, new: list[str]) -> None:
        codes, owner, code = [], [], xxhash.xxh64_intdigest
        for i, word in enumerate(new):
            raw, n = word.encode(), len(word)
            codes.append(code(raw))
            owner.append(i)
            plain = word.isascii()
            for m in _BEGINNINGS:
                if n <= m:
                    break
                codes.append(code((raw[:m] if plain else word[:m].encode()) + b"*"))
                owner.append(i)
        codes = np.array(codes, np.uint64)
        at = np.minimum(np.searchsorted(self.kept, codes), max(0, len(self.kept) - 1))
        hit = np.flatnonzero(self.kept[at] == codes) if len(self.kept) else []
        found: dict[int, list[int]] = {}
        for j in hit:
            found.setdefault(owner[j], []).append(int(at[j]))
        self.known.update(dict.fromkeys(new, ()))
        self.known.update({new[i]: tuple(ids) for i, ids in found.items()})

    def find(self, texts: list[str | None]) -> list[dict[int, int]]:
        """Of each text the numbers of its kept terms, and how often they occur."""
        counts = [Counter(words(t)) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set().union(*counts).difference(self.known)
        if new:
            self._learn(list(new))
        out = []
        for own in counts:
            total: dict[int, int] = {}
            for word, n in own.items():
                for t in self.known[word]:
                    total[t] = total.get(t, 0) + n
            out.append(total)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function that fits ``y`` over ``x`` best."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum, size, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][2] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, top = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] = top
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])


class Index:
    """Inverted index of the examples; see the module.  Pickled are term numbers and frequencies only; the rest is built again."""

    def __init__(self, kept: np.ndarray, idf: np.ndarray, ids: list[int], labels: list[int], vectors: list, prior: float, k: int = NEIGHBOURS):
        """``vectors`` are dicts from term number to frequency, or pairs of arrays of these."""
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.kept, self.idf, self.k, self.prior = kept, idf, k, prior
        self.ids = np.array(ids, np.int64)[order]
        self.labels = np.array(labels, np.float64)[order]
        pairs = [(list(v), list(v.values())) if isinstance(v, dict) else v for v in (vectors[i] for i in order)]
        self.sizes = np.array([len(at) for at, _ in pairs], np.int64)
        self.at, self.tf = (np.concatenate([np.zeros(0, np.int32), *[np.array(p[j], np.int32) for p in pairs]]) for j in (0, 1))
        self._build()
        self.steps = (np.zeros(1), np.full(1, prior))
        if len(ids):
            votes = np.array([self.vote(*self.vector(i), skip=i) for i in range(len(ids))])
            self.steps = isotonic(votes, self.labels)

    def _build(self) -> None:
        """Four bytes a weight, and some examples at a time, as each worker holds an index of its own."""
        n = len(self.sizes)
        self.cuts = np.append(0, np.cumsum(self.sizes))
        self.weights = np.zeros(len(self.at), np.float32)
        self.most = np.zeros(len(self.kept))
        for i in range(0, n, 500):
            part = slice(self.cuts[i], self.cuts[min(n, i + 500)])
            at, size = self.at[part], self.sizes[i : i + 500]
            owner = np.repeat(np.arange(len(size)), size)
            w = (1.0 + np.log(self.tf[part])) * self.idf[at]
            w /= np.sqrt(np.bincount(owner, w * w, len(size)))[owner]
            self.weights[part] = w
            np.maximum.at(self.most, at, self.weights[part])
        self.by_term = np.argsort(self.at, kind="stable").astype(np.int32)
        self.docs = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int32), self.sizes)[self.by_term]
        self.start = np.append(0, np.cumsum(np.bincount(self.at, minlength=len(self.kept))))
        self._build_blocks()

    def _build_blocks(self) -> None:
        """Greatest weight of each longer posting list in each block of examples; lists are in order of examples."""
        sizes = np.diff(self.start)
        long = np.flatnonzero(sizes >= _LISTED)
        blocks, most, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], np.zeros(len(sizes), np.int64)
        for i in range(0, len(long), 2000):
            terms = long[i : i + 2000]
            n = sizes[terms]
            place = np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat(np.arange(len(terms)), n) * (len(self.ids) // _BLOCK + 1) + self.docs[place] // _BLOCK
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            blocks.append((self.docs[place] // _BLOCK)[first])
            most.append(np.maximum.reduceat(self.weights[self.by_term[place]], first))
            counts[terms] = np.bincount(key[first] // (len(self.ids) // _BLOCK + 1), minlength=len(terms))
        self.block_at = np.concatenate(blocks).astype(self.docs.dtype)
        self.block_most = np.concatenate(most)
        self.block_start = np.append(0, np.cumsum(counts))

    def _can_add(self, at: np.ndarray, w: np.ndarray, most: float) -> np.ndarray:
        """What terms can add to an example of each block, ``most`` at most."""
        n = self.block_start[at + 1] - self.block_start[at]
        rest = (w * self.most[at])[n == 0].sum()
        place = np.repeat(self.block_start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bound = np.bincount(self.block_at[place], self.block_most[place] * np.repeat(w, n), len(self.ids) // _BLOCK + 1)
        return np.minimum(bound + rest, most)

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[i], self.cuts[i + 1]
        return self.at[a:b], self.weights[a:b]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cuts", "docs", "weights", "by_term", "start", "most", "block_at", "block_most", "block_start")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()
        del self.tf  # a worker that only asks needs it no more

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1.0 + np.log([counts[t] for t in at.tolist()])) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def _add(self, scores: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        n = self.start[at + 1] - self.start[at]
        if len(n):
            place = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            scores += np.bincount(self.docs[place], self.weights[self.by_term[place]] * np.repeat(w, n), len(scores))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples, best first."""
        most = w * self.most[at]
        order = np.argsort(-most, kind="stable")
        at, w, most = at[order], w[order], most[order]
        tail = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0.0)
        # what the terms from a place on can add, at most: vectors have length 1
        left = np.minimum(tail(most), np.sqrt(tail(w * w)))
        scores, done = np.zeros(len(self.ids)), 0
        for bound in (*_LEFT, 0.0):
            stop = int(np.searchsorted(-left, -bound)) if bound else len(at)
            self._add(scores, at[done:stop], w[done:stop])
            done = stop
            held = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
            found = np.flatnonzero(scores >= max(held - left[done] - 1e-12, 1e-12))
            if done < len(at) and held > left[done] + 1e-9 and len(found) > _IN_FULL:
                most_left = self._can_add(at[done:], w[done:], left[done])
                found = found[scores[found] >= held - most_left[found // _BLOCK] - 1e-12]
            if done < len(at) and held > left[done] + 1e-9 and len(found) <= _IN_FULL:
                query = np.zeros(len(self.kept))
                query[at[done:]] = w[done:]
                for i in found.tolist():
                    own, x = self.vector(i)
                    scores[i] += query[own] @ x
                break
        best = found[np.lexsort((found, -np.round(scores[found], 12)))[:k]]
        return best, scores[best]

    def vote(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> float:
        near, cosine = self.nearest(at, w, self.k + (skip >= 0))
        if skip >= 0:
            keep = near != skip
            near, cosine = near[keep], cosine[keep]
        return self._share(near[: self.k], cosine[: self.k])

    def _share(self, near: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1.0 / (1.1 - np.minimum(cosine, 1.0))
        return float((weight @ self.labels[near] + self.prior) / (weight.sum() + 1.0))

    def score(self, counts: dict[int, int], evidence: int = 3) -> tuple[float, list[tuple[int, float, int]]]:
        if not counts or not len(self.ids):
            return self.prior, []
        near, cosine = self.nearest(*self.weigh(counts), max(self.k, evidence))
        knots, values = self.steps
        score = float(values[min(np.searchsorted(knots, self._share(near[: self.k], cosine[: self.k])), len(values) - 1)])
        return score, [(int(self.ids[i]), float(c), int(self.labels[i])) for i, c in zip(near[:evidence], cosine[:evidence], strict=True)]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label have each term, of one partition."""
    count = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            count[label].update({t for w in set(words(text)) for t in map(term_code, terms_of(w))})
    for label in (0, 1):
        made = list(count[label].items())
        for k in range(0, len(made), 50_000):
            some = made[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"term": np.array([t for t, _ in some], np.uint64).view(np.int64), "clean": pa.array([n * (1 - label) for _, n in some], pa.int64()), "toxic": pa.array([n * label for _, n in some], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """The index of at most ``sample`` of the labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` pairs of numbers are broadcast
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text"), "examples")
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n1 or not n0:
        return Index(np.zeros(0, np.uint64), np.zeros(0), [], [], [], float(n1 > 0))
    counts = rows.mapInArrow(_term_counts, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    b, d = F.col("clean").cast("double"), F.col("toxic").cast("double")
    n = n0 + n1
    less = F.greatest(d - 0.5, F.lit(0.0))
    chi2 = n * F.pow(less * (n0 - b) - b * (n1 - less), 2) / ((b + less) * (n - b - less) * float(n0) * float(n1))
    lift = (d + n1 / n) / (b + d + 1.0) - n1 / n
    leans = (less / n1 > b / n0) & (lift > 0)
    top = counts.where(leans).select("term", (F.pow(chi2 / n, 2) * lift * (F.log((1.0 + n) / (1.0 + b + d)) + 1.0)).alias("weight")).where("weight > 0").toArrow()
    kept, weight = top.column("term").to_numpy().view(np.uint64), top.column("weight").to_numpy()
    order = np.argsort(kept)
    kept, weight = kept[order], weight[order]
    terms = docs.sparkSession.sparkContext.broadcast(kept)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(terms.value)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = finder.find(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["doc_id", "label", "at", "tf"])

    found = rows.mapInArrow(vectors, "doc_id long, label int, at array<int>, tf array<int>").toArrow().combine_chunks()
    ids, label = found.column(0).to_numpy(), found.column(1).to_numpy()
    sizes = pc.list_value_length(found.column(2)).to_numpy()
    flat = [pc.list_flatten(found.column(j)).to_numpy() for j in (2, 3)]
    cuts = np.append(0, np.cumsum(sizes))
    held = np.flatnonzero(sizes)
    prior = (label[sizes == 0].sum() + n1 / n) / ((sizes == 0).sum() + 1.0)
    pairs = [(flat[0][cuts[i] : cuts[i + 1]], flat[1][cuts[i] : cuts[i + 1]]) for i in held]
    return Index(kept, weight, ids[held].tolist(), label[held].tolist(), pairs, float(prior))


_finders: dict[str, TermFinder] = {}


def toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (doc_id, cosine, label of the nearest) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    key = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        if key not in _finders:
            _finders.clear()
            _finders[key] = TermFinder(index.kept)
        find = _finders[key].find
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            made = list(map(index.score, find(batch.column(1).to_pylist())))
            evidence = pa.array([[{"doc_id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in made], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in made], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 4) == 2, F.lit(False))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out, score all rows."""
    index = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity(docs, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    index = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    key, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _finders:
            _finders.clear()
            _finders[key] = TermFinder(shared.value.kept)
        find = _finders[key].find
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            clean = [shared.value.score(found, 1)[0] < TOXIC for found in find(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
