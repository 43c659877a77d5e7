"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and the pairs they link.

A blank and the text are encoded by a ``tokenizers`` file (A), the text by a ``sentencepiece`` file
that puts the blank there itself (B).  Byte offsets where tokens of both end cut them into groups.

Fragments are an associative monoid.  A range of bytes gives the tokens up to its first common end
(open: what came before may belong to them), the groups between common ends, and the tokens after
the last one (open as well); a range without a common end is all open.  Put together, one range's
open end and the next one's open start become a group (``compose``).  Documents of up to
``LONG`` bytes are one fragment.  Longer ones are cut where no token of either side can span,
encoded by several tasks, and their fragments, one for each ``LONG`` bytes, composed eight at a time.

Between a character and a blank no token of either file spans, so a piece (blanks and the word after
them) is encoded and aligned once and kept (``Aligner``).  Pairs are counted per chunk of documents
first; chunks, not documents, meet the counts of the corpus, so that a pair that every document has
is one row per chunk.  Within a group pairs are counted, not listed: distinct ids times distinct ids.

Defined results: null and empty texts, and those whose tokens' bytes differ from blank and text
(U+2581 in the text, characters that B rewrites), have no tokens: zeros, and '' for the digest.
Repeated rows and ids are documents of their own; where pairs of an id tie for its highest count, all
are best; other columns are not read; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, materialize, shuffle_parts
from sparklog.llm.pieces import cut, piece_of
from sparklog.llm.token_counts import splits_at_blanks

#: Bytes of a range of a long document; bytes of text that are encoded at once, and that one chunk of documents holds.
LONG, BATCH_BYTES, CHUNK_BYTES = 1 << 15, 1 << 20, 4 << 20
#: Fragments that one step of the reduction composes.
_FAN = 8
#: A pair of ids as one number: A's id times this, plus B's.
_B_IDS = 1 << 15
#: New pieces that are encoded as one text; pieces that a task keeps; groups with more pairs than this are counted one by one.
_JOINED, _KEPT, _MANY = 64, 100_000, 1 << 12

_SAFE = re.compile(r"(?<=\S)(?= )")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@contextmanager
def _no_collection() -> Iterator[None]:
    """No garbage collection: lists of ids are many, small and without cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if self.b.get_piece_size() > _B_IDS or not self.b.encode("a", out_type=str)[0].startswith("▁"):
            raise ValueError(f"{path_b}: needs at most {_B_IDS} ids, and a blank before the text")
        symbols = _bytes_of_symbols()
        size = self.a.get_vocab_size()
        if size * _B_IDS > 1 << 31:
            raise ValueError(f"{path_a}: pairs of its {size} ids don't fit")
        self.bytes_a = [bytes(symbols[c] for c in t) if t and all(c in symbols for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.blank = [self.b.piece_to_id("▁")]
        #: Whether pieces can be encoded apart: no token of either goes on over a character and a blank.
        self.cuts = splits_at_blanks(path_a) and not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of strings that begin with a blank."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        return a, [self.blank if p == " " else ids for p, ids in zip(pieces, b, strict=True)]

    def same_bytes(self, piece: str, a: Iterable[int], b: Iterable[int]) -> bool:
        data = piece.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data


@functools.cache
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and numbers of the pairs of one group."""
    (a, n), (b, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] * _B_IDS + b).ravel(), (n[:, None] * m).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _links(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, code, number: the linked pairs, given the group (in order) of each token of A and B."""
    n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
    many = n_a * n_b > _MANY
    take = np.where(many[of_a], 0, n_b[of_a])
    first = np.cumsum(n_b) - n_b
    at = np.repeat(first[of_a] - (np.cumsum(take) - take), take) + np.arange(take.sum())
    found = [(np.repeat(of_a, take), np.repeat(a, take) * _B_IDS + b[at], np.ones(len(at), np.int64))]
    start_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(many).tolist():
        codes, counts = _pairs(a[start_a[g] : start_a[g] + n_a[g]], b[first[g] : first[g] + n_b[g]])
        found.append((np.full(len(codes), g), codes, counts))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _listed(a: list, b: list) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def _texts(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, after: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2`` of tokens in groups; ``after[i]`` is what follows group i, 2 for a semicolon, 3 for a line's end."""
    side = np.concatenate([2 * of_a, 2 * of_b + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    last = np.append(side[1:] != side[:-1], True)
    marks = np.where(last, np.where(side % 2, after[side // 2], 1), 0)
    tokens = map(str, np.concatenate([a, b])[order].tolist())
    return "".join(chain.from_iterable(zip(tokens, map(",|;\n".__getitem__, marks.tolist()), strict=True)))


def _flat(rows: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))


class Aligner:
    """Aligns texts by their pieces, each aligned once."""

    def __init__(self, path_a: str, path_b: str):
        self.t = tokenizers_of(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.listed: list[str | None] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.first = np.zeros(1, np.int64)
        self.codes = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int32)

    def _encoded(self, pieces: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Ids by A and by B of all pieces one after the other; pieces that don't have their own bytes become None and have none.

        Several are encoded as one text, but for those that end in white space, as that may go on in the next.
        """
        joined, at = [], []
        for i, p in enumerate(pieces):
            if at and i - at[-1] < _JOINED and not pieces[i - 1][-1].isspace():
                joined[-1].append(p)
            else:
                joined.append([p])
                at.append(i)
        a, b = self.t.encode(["".join(x) for x in joined])
        if self.t.same_bytes("".join(pieces), chain.from_iterable(a), chain.from_iterable(b)):
            return pieces, _flat(a), _flat(b)
        if len(joined) == len(pieces):
            good = [self.t.same_bytes(*x) for x in zip(pieces, a, b, strict=True)]
            return [p if g else None for p, g in zip(pieces, good, strict=True)], _flat([x for x, g in zip(a, good, strict=True) if g]), _flat([x for x, g in zip(b, good, strict=True) if g])
        out: list[tuple[list[str | None], np.ndarray, np.ndarray]] = []
        for text, x, y in zip(joined, a, b, strict=True):
            if self.t.same_bytes("".join(text), x, y):
                out.append((text, _flat([x]), _flat([y])))
            else:
                out += [self._encoded([p]) for p in text]
        return [p for o in out for p in o[0]], np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])

    def _learn(self, keys: list[str]) -> None:
        """Align new pieces, all in one stream: each ends where both sides end."""
        pieces, a, b = self._encoded([piece_of(k) for k in keys])
        ends_a, ends_b = self.t.size_a[a].cumsum(), self.t.size_b[b].cumsum()
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        good = np.array([i for i, p in enumerate(pieces) if p is not None], np.int64)
        ends = np.cumsum([len(p.encode()) for p in pieces if p is not None], dtype=np.int64)
        piece = good[np.searchsorted(ends, common)]  # of each group
        group, codes, counts = _links(a, of_a, b, of_b, len(common))
        n = len(keys)
        links = np.bincount(piece[group], weights=counts, minlength=n).astype(np.int64)
        numbers = np.stack([np.bincount(piece[of_a], minlength=n), np.bincount(piece[of_b], minlength=n), np.bincount(piece, minlength=n), links], axis=1)
        keyed, counts = _summed(piece[group] << 32 | codes, counts)
        listed = _texts(a, of_a, b, of_b, np.where(np.isin(common, ends, assume_unique=True), 3, 2)).split("\n")
        self.index.update(zip(keys, range(len(self.listed), len(self.listed) + n), strict=True))
        lines = iter(listed)
        self.listed += [None if p is None else next(lines) for p in pieces]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(keyed >> 32, minlength=n))])
        self.codes = np.concatenate([self.codes, (keyed & 0xFFFFFFFF).astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])

    @_no_collection()
    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its numbers (tokens of A and B, groups, links) and digest; and document, code, number of its pairs."""
        if len(self.index) > _KEPT:
            self.clear()
        rows, missing, new = [], {}, set()
        for i, t in enumerate(texts):
            keys = (cut(" " + t) if self.t.cuts else ["\0 " + t]) if t else []
            rows.append(list(map(self.index.get, keys)))
            if None in rows[i]:
                missing[i] = keys
                new.update(k for k, at in zip(keys, rows[i], strict=True) if at is None)
        if new:
            self._learn(list(new))
            for i, keys in missing.items():
                rows[i] = list(map(self.index.__getitem__, keys))
        digests = []
        for i, row in enumerate(rows):
            listed = list(map(self.listed.__getitem__, row))
            if None in listed:
                rows[i] = listed = []
            digests.append(hashlib.sha256(";".join(listed).encode()).hexdigest() if listed else "")
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = _flat(rows)
        doc = np.repeat(np.arange(len(rows)), sizes)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[flat], axis=0)])
        ends = np.cumsum(sizes)
        take = self.first[flat + 1] - self.first[flat]
        at = np.repeat(self.first[flat] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        keyed, counts = _summed(np.repeat(doc, take) << 32 | self.codes[at], self.counts[at])
        return sums[ends] - sums[ends - sizes], digests, (keyed >> 32).astype(np.int32), (keyed & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)


@dataclass
class Fragment:
    """Tokens of a range of bytes: ``head`` up to the first common end (all, if there is none), groups, ``tail`` after the last."""

    head: tuple[list[int], list[int]] = ((), ())
    tail: tuple[list[int], list[int]] = ((), ())
    ends: bool = False
    groups: list[str] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
        """From ids and where their bytes end."""
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            return Fragment((a.tolist(), b.tolist()))
        i, j = (np.searchsorted(e, common[0], "right") for e in (ends_a, ends_b))
        k, m = (np.searchsorted(e, common[-1], "right") for e in (ends_a, ends_b))
        inner = (a[i:k], np.searchsorted(common[1:], ends_a[i:k]), b[j:m], np.searchsorted(common[1:], ends_b[j:m]))
        _, codes, counts = _links(*inner, len(common) - 1)
        groups = _texts(*inner, np.full(len(common) - 1, 2)).split(";")[:-1]
        return Fragment((a[:i].tolist(), b[:j].tolist()), (a[k:].tolist(), b[m:].tolist()), True, groups, *_summed(codes, counts))

    def closed(self, tokens: tuple[list[int], list[int]]) -> tuple[str, np.ndarray, np.ndarray]:
        return _listed(*tokens), *_pairs(np.array(tokens[0], np.int64), np.array(tokens[1], np.int64))


def _join(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return [*x[0], *y[0]], [*x[1], *y[1]]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of both ranges, ``y`` right after ``x``."""
    if not x.ends:
        return Fragment(_join(x.head, y.head), y.tail, y.ends, y.groups, y.codes, y.counts)
    if not y.ends:
        return Fragment(x.head, _join(x.tail, y.head), True, x.groups, x.codes, x.counts)
    listed, codes, counts = x.closed(_join(x.tail, y.head))
    pairs = _summed(np.concatenate([x.codes, codes, y.codes]), np.concatenate([x.counts, counts, y.counts]))
    return Fragment(x.head, y.tail, True, [*x.groups, listed, *y.groups], *pairs)


#: Of a document whose first range ends where it begins: what comes next starts a group.
START = Fragment(((), ()), ((), ()), True)

_FRAGMENT = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("good", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("ends", pa.bool_())]
    + [(f"{k}_{s}", pa.list_(pa.int32())) for k in ("head", "tail") for s in "ab"]
    + [("groups", pa.string()), ("n_groups", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())]
)
_FRAGMENT_SQL = "uid long, doc_id long, start long, good boolean, n_a long, n_b long, ends boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, groups string, n_groups long, codes binary, counts binary"


def _row(f: Fragment) -> dict:
    lists = {"head_a": f.head[0], "head_b": f.head[1], "tail_a": f.tail[0], "tail_b": f.tail[1]}
    return lists | {"ends": f.ends, "groups": ";".join(f.groups), "n_groups": len(f.groups), "codes": f.codes.tobytes(), "counts": f.counts.tobytes()}


def _fragment(r: dict) -> Fragment:
    # the groups of a row stay one text: only their order and number count from here on
    return Fragment((r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]), r["ends"], [r["groups"]] if r["groups"] else [], np.frombuffer(r["codes"], np.int64), np.frombuffer(r["counts"], np.int64))


def _encode_parts(path_a: str, path_b: str, long: int):
    """Arrow function: fragments of parts of long documents, one for each ``long`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers_of(path_a, path_b)
        for batch in by_bytes(batches, "part", BATCH_BYTES):
            for uid, doc_id, start, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _no_collection():
                    a, b = (x[0] for x in t.encode([part]))
                key = {"uid": uid, "doc_id": doc_id}
                if not t.same_bytes(part, a, b):
                    yield pa.RecordBatch.from_pylist([key | {"start": start, "good": False, "n_a": 0, "n_b": 0} | _row(Fragment())], _FRAGMENT)
                    continue
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends_a, ends_b = t.size_a[a].cumsum(), t.size_b[b].cumsum()
                rows = []
                for low in range(0, int(ends_a[-1]), long):
                    (i, k), (j, m) = (np.searchsorted(e, [low, low + long], "right") for e in (ends_a, ends_b))
                    made = Fragment.of(a[i:k], ends_a[i:k], b[j:m], ends_b[j:m])
                    rows.append(key | {"start": start + low, "good": True, "n_a": k - i, "n_b": m - j} | _row(made))
                yield pa.RecordBatch.from_pylist(rows, _FRAGMENT)

    return run


def _compose_rows(group: pa.Table) -> pa.Table:
    """One row of the rows of a document that follow each other."""
    rows = sorted(group.drop_columns(["step"]).to_pylist(), key=lambda r: r["start"])
    out = rows[0] | {"good": all(r["good"] for r in rows), "n_a": sum(r["n_a"] for r in rows), "n_b": sum(r["n_b"] for r in rows)}
    if not out["good"]:
        return pa.Table.from_pylist([out | {"n_groups": 0} | {k: v for k, v in _row(Fragment()).items() if k != "n_groups"}], _FRAGMENT)
    n_groups, made = rows[0]["n_groups"], _fragment(rows[0])
    for r in rows[1:]:
        n_groups += r["n_groups"] + (made.ends and r["ends"])
        made = compose(made, _fragment(r))
    return pa.Table.from_pylist([out | _row(made) | {"n_groups": n_groups}], _FRAGMENT)


_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.string())]
    + [("doc_ids", pa.list_(pa.int64()))]
    + [(n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")]
    + [("digests", pa.list_(pa.string())), ("codes", pa.binary()), ("docs", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())]
)
_CHUNK_SQL = "chunk long, uid long, doc_id long, start long, n_bytes long, part string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, digests array<string>, codes binary, docs binary, pairs binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, their first bytes together, then their second ones, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _chunk_row(chunk: int, doc_ids: list, numbers: np.ndarray, digests: list[str], doc: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> dict:
    """Documents of a chunk: their pairs (sorted by document) as places among the chunk's distinct codes."""
    distinct, pairs, docs = np.unique(codes, return_inverse=True, return_counts=True)
    columns = {n: numbers[:, i].tolist() for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    n_pairs = np.bincount(doc, minlength=len(doc_ids)).tolist()
    packed = {"codes": distinct.astype("<i4").tobytes(), "docs": docs.astype("<i4").tobytes(), "pairs": _packed(pairs), "counts": _packed(counts)}
    return {"chunk": chunk, "doc_ids": doc_ids, "n_pairs": n_pairs, "digests": digests} | columns | packed


def _parts(doc_id: int | None, uid: int, text: str, long: int, cuts: bool) -> Iterator[dict]:
    """Parts of a blank and a long text, cut where no token spans."""
    text, at, start = " " + text, 0, 0
    size = len(text.encode())
    while at < len(text):
        end = at + long
        safe = _SAFE.search(text, end) if cuts and end < len(text) else None
        end = safe.start() if safe else len(text)
        part = text[at:end]
        yield {"uid": uid, "doc_id": doc_id, "start": start, "n_bytes": size, "part": part}
        at, start = end, start + len(part.encode())


def _first_pass(path_a: str, path_b: str, long: int):
    """Arrow function: chunks of aligned documents, and the parts of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Aligner(path_a, path_b)
        uid = TaskContext.get().partitionId() << 40
        for outer in by_bytes(batches, "text", CHUNK_BYTES):
            ids, held = [], []
            for batch in by_bytes([outer], "text", BATCH_BYTES):
                short = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if len((text or "").encode()) <= long:
                        short.append((doc_id, text))
                        continue
                    uid += 1
                    yield pa.RecordBatch.from_pylist(list(_parts(doc_id, uid, text, long, made.t.cuts)), _CHUNK)
                numbers, digests, doc, codes, counts = made.align([t for _, t in short])
                held.append((numbers, digests, doc + np.int32(len(ids)), codes, counts))
                ids += [d for d, _ in short]
            numbers, doc, codes, counts = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4))
            uid += 1
            yield pa.RecordBatch.from_pylist([_chunk_row(uid, ids, numbers, [d for h in held for d in h[1]], doc, codes, counts)], _CHUNK)

    return run


def _whole(group: pa.Table) -> pa.Table:
    """The chunk of a document, from all its rows."""
    r = _compose_rows(group).to_pylist()[0]
    numbers, digest, f = np.zeros((1, 4), np.int64), "", Fragment()
    if r["good"]:
        f = compose(START, _fragment(r))
        numbers[0] = r["n_a"], r["n_b"], r["n_groups"] + r["ends"], f.counts.sum()
        digest = hashlib.sha256(";".join(f.groups).encode()).hexdigest()
    row = _chunk_row(r["uid"], [r["doc_id"]], numbers, [digest], np.zeros(len(f.codes), np.int64), f.codes, f.counts)
    return pa.Table.from_pylist([row], _CHUNK)


def composed(fragments: DataFrame, longest: int, long: int) -> DataFrame:
    """One chunk per document: ``_FAN`` ranges at a time, until a step holds the ``longest`` document."""
    step = long * _FAN
    while True:
        steps = fragments.withColumn("step", F.expr(f"start div {step}L")).groupBy("uid", "step")
        if step >= longest:
            return steps.applyInArrow(_whole, _CHUNK_SQL)
        fragments, step = steps.applyInArrow(_compose_rows, _FRAGMENT_SQL), step * _FAN


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, code, docs: in how many documents of the chunk it is."""
    for batch in batches:
        for chunk, codes, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes, docs = np.frombuffer(codes, "<i4"), np.frombuffer(docs, "<i4")
            for k in range(0, len(codes), 100_000):
                part = codes[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(docs[k : k + 100_000])], names=["chunk", "code", "docs"])


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _describe(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a chunk, given how many documents of the corpus have each of its codes."""
    found = found.sort_by("code")
    totals, best = found["total"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
    out = []
    for r in chunks.to_pylist():
        sizes = np.array(r["n_pairs"], np.int64)
        pairs, counts = _unpacked(r["pairs"], sizes.sum()), _unpacked(r["counts"], sizes.sum()).astype(np.int64)
        ends = np.cumsum(sizes)
        sums = [np.concatenate([[0], np.cumsum(counts * x[pairs])]) if len(pairs) else np.zeros(1, np.int64) for x in (best, totals)]
        sums = [s[ends] - s[ends - sizes] for s in sums]
        columns = [r["doc_ids"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], sums[0], sums[1]]
        out.append(pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(r["digests"], pa.string())], names=_NAMES))
    return pa.concat_tables(out)


def pair_counts(codes: DataFrame) -> DataFrame:
    """code, total (documents that hold it), best (no pair of its A id is in more) of chunk rows (code, docs)."""
    totals = codes.groupBy("code").agg(F.sum("docs").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(F.expr(f"code div {_B_IDS}"))))


def aligned(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Chunks of aligned documents (stored), and chunk, code, docs of their pairs."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = materialize(docs.mapInArrow(_first_pass(path_a, path_b, long), _CHUNK_SQL), "aligned")
    chunks = stored.where("part is null")
    longest = stored.agg(F.max("n_bytes")).first()[0]
    if longest:
        parts = stored.where("part is not null").select("uid", "doc_id", "start", "part").repartition(shuffle_parts(df.sparkSession), "uid", "start")
        fragments = parts.mapInArrow(_encode_parts(path_a, path_b, long), _FRAGMENT_SQL)
        whole = materialize(composed(fragments, longest, long), "aligned-long")
        chunks = chunks.union(whole)
    return chunks, chunks.select("chunk", "codes", "docs").mapInArrow(_codes, "chunk long, code int, docs int")


def pair_table(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, documents, best: each pair of ids that some document links."""
    _, codes = aligned(df, path_a, path_b, doc_id, text)
    return pair_counts(codes).select(F.expr(f"code div {_B_IDS}").alias("a"), F.expr(f"cast(code % {_B_IDS} as long)").alias("b"), F.col("total").alias("documents"), "best")


def align_documents(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    chunks, codes = aligned(df, path_a, path_b, doc_id, text, long)
    found = codes.join(pair_counts(codes), "code").select("chunk", "code", "total", "best")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_describe, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
