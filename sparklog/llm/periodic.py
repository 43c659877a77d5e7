"""Runs of words that repeat with a period, by tiles of each octave of periods.

Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with least period q (words q apart
are identical), at least ``max(6, 4 * q)`` words long, that no word beside it extends.

For the periods of an octave, 2^k <= q < 2 * 2^k, anchors lie s = 2^(k+1) words apart and the tile
of anchor m is words m - s to m + 2 * s.  A run of such a period holds an anchor and the period
after it; how far it goes on either side within the tile follows from Z-functions at the anchor,
one of the words after it and one of the words before it backwards.  What a tile sees of a run is at
least s + q words, and what two neighbouring tiles see overlaps by more than a period, so that
intervals of one document and period are stitched wherever they overlap by a period.  Tiles that
can't hold a run don't get Z-functions: one of the two sides must repeat 2^k words, and hashes of
so many words tell that it doesn't.

Documents of at most ``SPAN`` words are solved where they are read.  Longer ones are cut into
overlapping rows for each band of octaves, dealt over all tasks; intervals are shuffled by
document and period.  A document's words leave the first pass only if something in it may repeat.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty
collapsed text; rows are told apart even if they repeat, and each gives one row; where runs tie,
the first start, then the least period counts; other columns are not read; an empty table gives an
empty result.  Texts are read whole; the longest octaves of a very long one need a row of all its words.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, materialize, shuffle_parts

#: Words (a power of two) that one row of the first band holds, margins aside; its octaves have periods under SPAN / 8.
SPAN = 8192
#: Bytes of text that are solved together.
BATCH_BYTES = 2 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STORED = "uid long, doc_id long, n_words long, words string, collapsed_sha256 string, found array<struct<period:long,first:long,last:long>>, low int, high int, base long, codes binary"

Prepare = Callable[[int | None, list[str]], list[str]]


@functools.lru_cache(1 << 16)
def _primes_of(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple(out + [q] * (q > 1))


def z_function(s: list) -> list[int]:
    """For each place of ``s``, how many items from there equal those from the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _tile(w: np.ndarray, low: int, m: int, high: int, s: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """period, start, end of what tile [low, high) sees at anchor m, for those of ``periods`` that are least."""
    after = z_function(w[m:high].tolist())
    reach = min(s - 1, high - m)
    before = w[low:m][::-1].tolist()
    back = z_function([*before, None, *w[low : m + reach][::-1].tolist()]) if before else None
    for q in periods:
        if q > reach or any(after[q // p] >= q - q // p for p in _primes_of(q)):
            continue
        first = m - (back[len(before) + 1 + reach - q] if before else 0)
        yield q, first, m + q + (after[q] if q < len(after) else 0)


def intervals(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, open_left: bool = False, open_right: bool = False, octaves: tuple[int, int] = (0, 62)) -> list[tuple[int, int, int, int]]:
    """segment, period, start, end (within the segment) of the intervals of the segments [start, end) of ``w``.

    Codes between segments occur once.  ``open_left`` and ``open_right``: words of the document
    go on beyond the segments.
    """
    out: list[tuple[int, int, int, int]] = []
    longest = int((ends - starts).max(initial=0))
    grams = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(octaves[1] + 1):
        size = 1 << k
        if longest < max(6, 4 * size):
            break
        s = 2 * size
        if k:  # grams of 2^k words, from those of half as many
            half = size // 2
            grams[:-half] = grams[:-half] * np.uint64(0xC2B2AE3D27D4EB4F) + (grams[half:] ^ (grams[half:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        if k < octaves[0]:
            continue
        table = np.zeros(-(-len(w) // s) * s, np.uint64)
        table[: len(w)] = grams
        table = table.reshape(-1, s)
        hits = table[1:, size:] == table[1:, :1]
        hits |= table[1:, :size] == table[:-1, size : size + 1]
        rows = np.flatnonzero(hits.any(axis=1))
        anchors = (rows + 1) * s
        segments = np.searchsorted(starts, anchors, "right") - 1
        for row, m, x in zip(rows.tolist(), anchors.tolist(), segments.tolist(), strict=True):
            start, end = int(starts[x]), int(ends[x])
            if m >= end or end - start < max(6, 4 * size):
                continue
            low, high = max(start, m - s), min(end, m + 2 * s)
            for q, first, last in _tile(w, low, m, high, s, (np.flatnonzero(hits[row]) + size).tolist()):
                cut_left = first == low and (low > start or open_left)
                cut_right = last == high and (high < end or open_right)
                if last - first >= (s + q if cut_left or cut_right else max(6, 4 * q)):
                    out.append((x, q, first - start, last - start))
    return stitch(out)


def stitch(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Intervals of one segment and period that overlap by a period are one."""
    out: list[tuple[int, int, int, int]] = []
    for x, q, first, last in sorted(found):
        if out and out[-1][:2] == (x, q) and first <= out[-1][3] - q:
            out[-1] = (x, q, out[-1][2], max(out[-1][3], last))
        else:
            out.append((x, q, first, last))
    return out


def _rows_of(codes: np.ndarray, span: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """low, high, base, words: the rows of a long document, with all tiles of their anchors.

    The octaves up to periods of span / 8 share rows of span words; each further octave has rows
    of 8 anchors.
    """
    n, k = len(codes), (span // 8).bit_length() - 2
    bands = [(0, k, span)]
    while 4 << (k + 1) <= n:
        k += 1
        bands.append((k, k, 16 << k))
    for low, high, step in bands:
        margin = 2 << high
        for at in range(0, n, step):
            base = max(0, at - margin)
            yield low, high, base, codes[base : at + step + 2 * margin]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _first_pass(prepare: Prepare | None, span: int):
    """Arrow function: one row per document, and for long ones the rows to solve elsewhere."""
    schema = [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("words", pa.string()), ("collapsed_sha256", pa.string())]
    schema.append(("found", pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))))
    schema = pa.schema([*schema, ("low", pa.int32()), ("high", pa.int32()), ("base", pa.int64()), ("codes", pa.binary())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            codes_of: dict[str, int] = {}
            docs, stream, starts, ends, at = [], [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text or "")
                if prepare:
                    words = prepare(doc_id, words)
                codes = np.array([codes_of.setdefault(x, len(codes_of)) for x in words], np.int64)
                if len(words) <= span:
                    starts.append(at)
                    stream += [codes, np.array([-1 - len(docs)], np.int64)]
                    at += len(words)
                    ends.append(at)
                    at += 1
                docs.append((doc_id, words, codes))
            found: dict[int, list] = {}
            short = [i for i, (_, words, _) in enumerate(docs) if len(words) <= span]
            if short:
                for x, q, first, last in intervals(np.concatenate(stream), np.array(starts), np.array(ends)):
                    found.setdefault(short[x], []).append({"period": q, "first": first, "last": last})
            rows = []
            for i, (doc_id, words, codes) in enumerate(docs):
                uid += 1
                row = {"uid": uid, "doc_id": doc_id, "n_words": len(words)}
                if len(words) <= span and i not in found:
                    rows.append(row | {"collapsed_sha256": _sha(" ".join(words))})
                    continue
                rows.append(row | {"words": " ".join(words), "found": found.get(i)})
                if len(words) > span:
                    codes = codes.astype("<i4")
                    for low, high, base, part in _rows_of(codes, span):
                        rows.append({"uid": uid, "n_words": len(codes), "low": low, "high": high, "base": base, "codes": part.tobytes()})
                        if sum(len(r.get("codes", b"")) for r in rows[-64:]) > BATCH_BYTES or len(rows) > 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return solve


def _solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of the rows of long documents."""
    for batch in batches:
        for uid, n, low, high, base, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = np.frombuffer(codes, "<i4").astype(np.int64)
            found = intervals(w, np.array([0]), np.array([len(w)]), base > 0, base + len(w) < n, (low, high))
            columns = [[uid] * len(found), [q for _, q, _, _ in found], [base + a for _, _, a, _ in found], [base + b for _, _, _, b in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "period", "first", "last"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents with their runs: digests of the runs and of the words that stay."""
    names = ["doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in by_bytes(batches, "words", BATCH_BYTES):
        rows = []
        for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs or [])
            words = text.split(" ") if text else []
            gone = np.zeros(len(words) + 1, np.int64)
            for start, period, length in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            kept = (gone[:-1].cumsum() == 0).tolist()
            start, period, length = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None,) * 3
            listed = "".join(f"{a},{b},{q}\n" for a, q, b in runs)
            rows.append((doc_id, len(runs), start, length, period, _sha(listed), _sha(" ".join(w for w, k in zip(words, kept, strict=True) if k))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _stored(df: DataFrame, doc_id: str, text: str, prepare: Prepare | None, span: int) -> tuple[DataFrame, DataFrame]:
    """The stored first pass, and uid, period, start, length of all runs."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = materialize(docs.mapInArrow(_first_pass(prepare, span), _STORED), "periodic")
    parts = shuffle_parts(df.sparkSession)
    rows = stored.where("codes is not null").select("uid", "n_words", "low", "high", "base", "codes").repartition(parts, "uid", "low", "base")
    found = stored.where("found is not null").select("uid", F.inline("found")).union(rows.mapInArrow(_solve_rows, "uid long, period long, first long, last long"))
    by = Window.partitionBy("uid", "period").orderBy("first", "last")
    reached = found.withColumn("reached", F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    islands = reached.withColumn("island", F.count(F.when(F.col("reached").isNull() | (F.col("first") > F.col("reached") - F.col("period")), 1)).over(by))
    runs = islands.groupBy("uid", "period", "island").agg(F.min("first").alias("start"), (F.max("last") - F.min("first")).alias("length"))
    return stored, runs.where("length >= greatest(6, 4 * period)").select("uid", "start", "length", "period")


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Prepare | None = None, span: int = SPAN) -> DataFrame:
    """doc_id, start, length, period of every run of every text.

    ``prepare`` may change a document's words first; it gets the id and the words.  Documents of
    more than ``span`` words are solved in rows.
    """
    stored, runs = _stored(df, doc_id, text, prepare, span)
    return runs.join(stored.where("codes is null").select("uid", "doc_id"), "uid").select("doc_id", "start", "length", "period")


def collapsed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Prepare | None = None, span: int = SPAN) -> DataFrame:
    """doc_id, n_runs, the longest run, digests of the runs and of the words outside repeats, of each row."""
    stored, runs = _stored(df, doc_id, text, prepare, span)
    listed = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    described = stored.where("words is not null").join(listed, "uid", "left").select("doc_id", "words", "runs")
    described = described.mapInArrow(_describe, "doc_id long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string")
    none = F.lit(None).cast("long")
    plain = stored.where("collapsed_sha256 is not null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), none, none, none, F.lit(_sha("")), "collapsed_sha256")
    both = described.union(plain)
    return both.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """The query's edit: from a place that the id's crc32 gives, words of one in ten documents repeat with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12(df: DataFrame, span: int = SPAN) -> DataFrame:
    return collapsed(df, prepare=repeated_tail, span=span)
