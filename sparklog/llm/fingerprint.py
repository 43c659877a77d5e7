"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines that aren't blank.  Each gives a 64-bit digest (of itself and
how often it came before in the text, so that repeated ones count).  A sketch has three
sub-tables of cells (count, xor of digests, xor of checks).  Subtracting the sketch of another
version cancels what they share; peeling cells that hold one digest recovers the digests of
the paragraphs on either side that differ.  When peeling gets stuck, both versions are sketched
again in four times as many cells, or in as many as the counts show to be needed, until it
succeeds.  The clauses of the paragraphs so found are compared by sketches of their own, as large as their number asks for, so
that an edited paragraph isn't wholly another one.

The fingerprint is the number of paragraphs and the first sketch, of ``FIRST_CELLS`` cells, as
text; ``differing`` subtracts two fingerprints and peels.  Likeness is the share of the two
texts' characters that isn't in differing clauses; 1 if both have none.  A clause ends after a
mark or with the word that is ``CLAUSE`` characters on; one rule holds for texts of all lengths.  Null texts count as empty, very long ones are taken whole.  Sketches of a batch of
documents are built and peeled together.

``with_next`` pairs each row with the next in ascending doc_id (after the last: the first),
null ids first; rows that repeat an id follow each other in order of their text.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, shuffle_parts
from sparklog.llm.shingles import mix

BATCH_BYTES = 2 << 20
_NO_ID = -(1 << 63)
CLAUSE = 40
_MARKS = ".,;:!?。、，；：！？"
_CLAUSE = re.compile(rf"[^\s{_MARKS}][^{_MARKS}]{{0,{CLAUSE - 1}}}[^\s{_MARKS}]{{0,24}}[{_MARKS}]*|[{_MARKS}]+")
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_CHECK = np.uint64(0x082EFA98EC4E6C89)
FIRST_CELLS = 24


def numbered(digests: list[int]) -> list[int]:
    """The digests, all different: of equal ones the second and later are digested with their number."""
    if len(set(digests)) == len(digests):
        return digests
    seen: Counter = Counter()
    out = []
    for d in digests:
        n = seen[d]
        seen[d] = n + 1
        out.append(xxhash.xxh64_intdigest(d.to_bytes(8, "little"), n) if n else d)
    return out


def paragraphs(text: str) -> tuple[list[int], list[str]]:
    """Digests of the paragraphs of a text, all different, and the paragraphs."""
    found = [line for line in text.split("\n") if line and not line.isspace()]
    return numbered([xxhash.xxh64_intdigest(line.encode()) for line in found]), found


class Sketches:
    """Sketches of several documents, one after the other in flat arrays."""

    def __init__(self, digests: np.ndarray, owner: np.ndarray, n_docs: int, cells: int):
        self.n_docs, self.cells = n_docs, cells
        self.count = np.zeros(n_docs * cells, np.int32)
        self.key = np.zeros(n_docs * cells, np.uint64)
        self.check = np.zeros(n_docs * cells, np.uint64)
        self._toggle(digests, owner, np.ones(len(digests), np.int32))

    def _toggle(self, digests: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Add digests (sign 1) or take them out (-1); the cells that they are in."""
        checks, third = mix(digests ^ _CHECK), self.cells // 3
        touched = []
        for j, salt in enumerate(_SALTS):
            at = owner * self.cells + j * third + (mix(digests ^ salt ^ np.uint64(self.cells)) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, digests)
            np.bitwise_xor.at(self.check, at, checks)
            touched.append(at)
        return np.concatenate(touched)

    def subtract(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.n_docs, out.cells = self.n_docs, self.cells
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def part(self, begin: int, end: int) -> Sketches:
        """The sketches of some of the documents."""
        out = object.__new__(Sketches)
        out.n_docs, out.cells = end - begin, self.cells
        out.count, out.key, out.check = (x[begin * self.cells : end * self.cells] for x in (self.count, self.key, self.check))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which documents succeeded; owner, digest and side (1 or -1) of what was recovered."""
        owners, digests, signs = [], [], []
        open_ = np.flatnonzero(self.count)
        for _ in range(4 * self.cells):
            at = open_[(np.abs(self.count[open_]) == 1) & (self.check[open_] == mix(self.key[open_] ^ _CHECK))]
            if not len(at):
                break
            o, d, s = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((d, o))
            o, d, s = o[order], d[order], s[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (d[1:] != d[:-1])
            o, d, s = o[new], d[new], s[new]
            open_ = np.unique(self._toggle(d, o, -s))
            owners.append(o)
            digests.append(d)
            signs.append(s)
        empty = (self.count == 0) & (self.key == 0) & (self.check == 0)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return empty.reshape(self.n_docs, self.cells).all(1), join(owners, np.int64), join(digests, np.uint64), join(signs, np.int64)

    def text(self, doc: int, size: int) -> str:
        """The sketch of one document, and how many digests it holds."""
        part = slice(doc * self.cells, (doc + 1) * self.cells)
        raw = b"".join([size.to_bytes(8, "little"), *[x[part].tobytes() for x in (self.count.astype("<i4"), self.key, self.check)]])
        return base64.b64encode(raw).decode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.array([d for x in lists for d in x], np.uint64), np.repeat(np.arange(len(lists)), sizes)


def _read(fingerprint: str) -> tuple[int, Sketches]:
    raw = base64.b64decode(fingerprint)
    out = object.__new__(Sketches)
    out.n_docs, out.cells = 1, (len(raw) - 8) // 20
    out.count = np.frombuffer(raw, "<i4", out.cells, 8).astype(np.int32)
    out.key, out.check = (np.frombuffer(raw, np.uint64, out.cells, 8 + k * out.cells) for k in (4, 12))
    return int.from_bytes(raw[:8], "little"), out


def differing(one: str, other: str) -> tuple[list[int], list[int]] | None:
    """Digests of paragraphs only in the one and only in the other fingerprint's text; None if too many differ for their sketches."""
    (_, a), (_, b) = _read(one), _read(other)
    whole, _, digest, sign = a.subtract(b).peel()
    return ([d for d, s in zip(digest.tolist(), sign.tolist(), strict=True) if s == side] for side in (1, -1)) if whole[0] else None


def _cells(n: int) -> int:
    """Cells in which ``n`` digests can be peeled."""
    cells = FIRST_CELLS
    while 2 * cells < 3 * n:
        cells *= 2
    return cells


def differences(one: list[list[int]], other: list[list[int]], first: tuple[Sketches, Sketches] | None = None) -> list[tuple[list[int], list[int]]]:
    """For each pair of versions the digests only in the one and only in the other, by sketches alone; ``first`` are those of ``FIRST_CELLS``, if there already."""
    out: list = [None] * len(one)
    todo: dict[int, list[int]] = {}  # those to be sketched next, by the number of cells
    for i, (x, y) in enumerate(zip(one, other, strict=True)):
        todo.setdefault(FIRST_CELLS if first else _cells(len(x) + len(y)), []).append(i)
    while todo:
        cells = min(todo)
        left = todo.pop(cells)
        a, b = first or (Sketches(*_flat([x[i] for i in left]), len(left), cells) for x in (one, other))
        first = None
        apart = a.subtract(b)
        # squares of counts add up to about how many differ, in each sub-table
        guess = (apart.count.reshape(len(left), cells).astype(np.int64) ** 2).sum(1) // 3
        whole, owner, digest, sign = apart.peel()
        for i, ok in zip(left, whole.tolist(), strict=True):
            if ok:
                out[i] = ([], [])
        for o, d, s in zip(owner.tolist(), digest.tolist(), sign.tolist(), strict=True):
            if whole[o]:
                out[left[o]][s < 0].append(d)
        for i, ok, n in zip(left, whole.tolist(), guess.tolist(), strict=True):
            if not ok:
                todo.setdefault(max(4 * cells, _cells(n)), []).append(i)
    return out


def likeness(one: list[tuple[list[int], list[str]]], other: list[tuple[list[int], list[str]]], first: tuple[Sketches, Sketches] | None = None) -> list[float]:
    """Of each pair of texts, given as their ``paragraphs``."""
    apart = differences([d for d, _ in one], [d for d, _ in other], first)
    sides: tuple[list, list] = ([], [])
    sizes: list[dict[int, int]] = []
    for (da, ta), (db, tb), (only_a, only_b) in zip(one, other, apart, strict=True):
        size: dict[int, int] = {}
        for side, digests, texts, only in zip(sides, (da, db), (ta, tb), (set(only_a), set(only_b)), strict=True):
            found = [c for d, t in zip(digests, texts, strict=True) if d in only for c in _CLAUSE.findall(t)]
            own = numbered([xxhash.xxh64_intdigest(c.encode()) for c in found])
            size.update(zip(own, map(len, found), strict=True))
            side.append(own)
        sizes.append(size)
    out = []
    for (_, ta), (_, tb), size, (x, y) in zip(one, other, sizes, differences(*sides), strict=True):
        n = sum(map(len, ta)) + sum(map(len, tb))
        out.append(max(0.0, 1.0 - sum(size[d] for d in [*x, *y]) / n) if n else 1.0)
    return out


def _search(bounds: list[int], x) -> F.Column:
    """How many of the sorted ``bounds`` are at most ``x``, in two levels."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at_most = lambda column: F.size(F.filter(column, lambda b: b <= x))
    if not groups:
        return F.lit(0)
    outer = at_most(F.lit([g[0] for g in groups]))
    # the last group that begins at or below x; before the first there is none
    inner = F.element_at(F.array(*[F.lit(g) for g in groups]), F.greatest(outer, F.lit(1)))
    return F.when(outer == 0, 0).otherwise((outer - 1) * width + at_most(inner))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, extra), one part per partition and sorted within it.

    The rows of the next part's first id come after a part's own, marked ``extra``; so each
    partition holds all pairs of its rows.  Bounds and first ids are one number per partition.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] or []))
    part = _search(bounds, F.col("doc_id")).cast("int")
    first = {r.part: r.head for r in docs.groupBy(part.alias("part")).agg(F.min("doc_id").alias("head")).collect()}
    parts = sorted(first)
    before = [(first[p], parts[i - 1]) for i, p in enumerate(parts)]
    heads = spark.createDataFrame(before, "doc_id long, previous int")
    rows = docs.join(F.broadcast(heads), "doc_id", "left").select(
        "doc_id",
        "text",
        F.explode(
            F.when(F.col("previous").isNull(), F.array(F.struct(part.alias("part"), F.lit(0).alias("extra")))).otherwise(
                F.array(F.struct(part.alias("part"), F.lit(0).alias("extra")), F.struct(F.col("previous").alias("part"), F.lit(1).alias("extra")))
            )
        ).alias("to"),
    )
    rows = rows.select("to.part", "doc_id", "text", "to.extra")
    return rows.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions("extra", "doc_id", "text")


def op3(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""

    def work(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        """``texts`` has one more, the next of the last."""
        edited = []
        for own, following in zip(texts[:-1], texts[1:], strict=True):
            q = len(own) // 4
            edited.append(own[: len(own) - q] + following[:q])
        own, changed = [paragraphs(t) for t in texts], [paragraphs(t) for t in edited]
        a, b = (Sketches(*_flat([d for d, _ in x]), len(x), FIRST_CELLS) for x in (own, changed))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([None if i == _NO_ID else i for i in ids], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [a.text(i, len(d)) for i, (d, _) in enumerate(own[:-1])],
                "edited_fingerprint": [b.text(i, len(d)) for i, (d, _) in enumerate(changed)],
                "near_edited": pa.array(likeness(own[:-1], changed, (a.part(0, len(ids)), b)), pa.float64()),
                "near_next": pa.array(likeness(own[:-1], own[1:], (a.part(0, len(ids)), a.part(1, len(ids) + 1))), pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            extra = batch.column(3).to_pylist()
            own = bisect.bisect_left(extra, 1)
            ids += batch.column(1).slice(0, own).to_pylist()
            texts += batch.column(2).slice(0, own + 1).to_pylist()
            if own < batch.num_rows:
                break
            if len(texts) > 1:  # the last one waits for the next batch
                yield work(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]
        for _ in batches:
            pass
        if ids:
            yield work(ids, texts)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
