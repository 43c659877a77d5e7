"""Language of a text: scripts narrow the candidates, then Viterbi over word scores labels its spans.

``fit`` learns, from a bounded sample of labelled texts, the frequencies of character
3-grams (with word edges) and of whole short words per language, and which scripts each
language is written in.  A word scores, for every language, the log-likelihood of its grams
relative to the best language, cut at ``FLOOR``; languages of other scripts get ``FLOOR``.
Viterbi takes the path of languages with the best total, where each switch costs
``SWITCH``; so a few odd words stay in the language around them, and a quoted paragraph
becomes a span of its own.  A text needs no path where no run of its words gains ``SWITCH`` in
other languages over the best one (the greatest sum of a run, for all texts at once); it is one
span then, as the path would be.  The text's language is that of most of its letters.  The score
is their share, times the odds that this language and not the next best one wrote the words.

Null texts and texts without a letter are ``und`` with score 0 and no spans.  Ties go to the
language first in alphabetical order.  Rows without a language, or with null text, teach
nothing; without any labelled row all texts are ``und``.  Rows that repeat an id are labelled each;
very long texts are taken whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, crc_bucket

BATCH_BYTES = 16 << 20
#: Labelled texts of each language that ``fit`` reads, about; chosen by a hash of the id.
SAMPLE = 2000
SWITCH = 8.0
FLOOR = -6.0
_WORDS_KEPT = 400_000
_WORD = re.compile(r"[^\W\d_]+")

#: The first code point of ranges of one script (Unicode blocks), in order.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_FIRST = [a for a, _ in SCRIPTS]


@functools.cache
def script(char: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(char)) - 1][1]


_LATIN = frozenset(["latin"])


def scripts_of(word: str) -> frozenset[str]:
    """The scripts of all characters of a word."""
    return _LATIN if word.isascii() else frozenset(map(script, word))


def grams(word: str) -> list[str]:
    """Character 3-grams of a lower-case word with its edges; a short word counts whole as well."""
    edged = f"<{word}>"
    found = [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [*found, edged] if 3 < len(edged) <= 7 else found


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_WORD.findall(text))
    for lang, counts in words.items():
        made: Counter = Counter()
        for word, n in counts.items():
            for name in scripts_of(word):
                made["\0" + name] += n
            for g in grams(word.lower()):
                made[g] += n
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(made), "gram": list(made), "n": list(made.values())})


class Model:
    """Log-likelihoods of grams, and the scripts, of each language."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray]):
        self.langs = langs
        scripts = {g[1:]: n for g, n in counts.items() if g[0] == "\0"}
        total = np.sum(list(scripts.values()), axis=0) if scripts else np.ones(len(langs))
        self.scripts = {s: n >= 0.01 * total for s, n in scripts.items()}
        kept = {g: n for g, n in counts.items() if g[0] != "\0"}
        seen = np.sum(list(kept.values()), axis=0) if kept else np.ones(len(langs))
        size = len(kept) + 1
        self.number = {g: i for i, g in enumerate(kept)}
        n = np.array(list(kept.values())).reshape(len(kept), len(langs))
        self.scores = np.log((np.vstack([n, np.zeros(len(langs))]) + 0.5) / (seen + 0.5 * size))  # the last is of unseen grams

    def score(self, words: list[str]) -> np.ndarray:
        """One row per word: of each language, relative to the best."""
        get, unseen = self.number.get, len(self.number)
        numbers, at = [], []
        for word in words:
            at.append(len(numbers))
            edged = f"<{word.lower()}>"
            numbers += [get(edged[i : i + 3], unseen) for i in range(len(edged) - 2)]
            if 3 < len(edged) <= 7:
                numbers.append(get(edged, unseen))
        total = np.add.reduceat(self.scores[numbers], at, axis=0)
        barred: dict[frozenset[str], list[int]] = {}
        for i, word in enumerate(words):
            barred.setdefault(scripts_of(word), []).append(i)
        for names, rows in barred.items():
            known = [fits for name in names if (fits := self.scripts.get(name)) is not None]
            fits = np.all(known, axis=0) if known else np.zeros(len(self.langs), bool)
            if fits.any():
                total[np.ix_(rows, ~fits)] = -np.inf
        return np.maximum(total - total.max(1, keepdims=True), FLOOR).astype(np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``labelled`` (doc_id, text, lang), from about ``sample`` texts of each language."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {})
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
    chance = (F.xxhash64("doc_id") % 1_000_000) / 1_000_000.0
    chosen = rows.where(F.abs(chance) < share).select("lang", "text")
    counts = chosen.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    wide = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for i, lang in enumerate(langs)])
    return Model(langs, {r.gram: np.array([r[f"n{i}"] or 0 for i in range(len(langs))], np.float64) for r in wide.collect()})


class _Words:
    """Numbers and scores of words met before in this Python worker."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, 0), np.float32)

    def look_up(self, model: Model, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > _WORDS_KEPT:
            self.__init__()
        number, new, out = self.number, [], []
        for text in texts:
            words = _WORD.findall(text)
            found = list(map(number.get, words))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        word = words[i]
                        x = number.get(word)
                        if x is None:
                            x = number[word] = len(number)
                            new.append(word)
                        found[i] = x
            out.append(np.array(found, np.int32))
        if new:
            made = model.score(new)
            self.scores = np.concatenate([self.scores, made]) if len(self.scores) else made
        return out


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best state of each word; text ``i`` has the words ``at[i]:at[i + 1]``.  All texts advance together."""
    n_words, states = scores.shape
    path = np.zeros(n_words, np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    start, size = at[:-1][order], size[order]
    if not len(order):
        return path
    came = np.zeros((n_words, states), np.uint8)
    best = scores[start].astype(np.float64)
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t words
    own = np.arange(states, dtype=np.uint8)
    for t in range(1, steps):
        n = active[t]
        v = best[:n]
        top = v.argmax(1)
        changed = v[np.arange(n), top] - switch
        turn = changed[:, None] > v
        word = start[:n] + t
        came[word] = np.where(turn, top[:, None].astype(np.uint8), own)
        best[:n] = np.where(turn, changed[:, None], v) + scores[word]
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        word = start[:n] + t
        path[word] = state[:n]
        if t:
            state[:n] = came[word, state[:n]]
    return path


def best_paths(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """``viterbi`` where a switch can pay; and the total of each text's words by language."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    total = np.zeros((len(n), scores.shape[1]))
    path = np.zeros(len(scores), np.uint8)
    if not len(full):
        return path, total
    total[full] = np.add.reduceat(scores, at[full], axis=0, dtype=np.float64)
    own = total.argmax(1)
    path = np.repeat(own, n).astype(np.uint8)
    if scores.shape[1] == 1:
        return path, total
    rows = np.arange(len(scores))
    mine = scores[rows, path].astype(np.float64)
    others = scores.copy()
    others[rows, path] = -np.inf
    # the greatest sum of a run in each text; texts are set apart, so that a minimum is the text's own
    gain = others.max(1) - mine
    apart = (np.abs(gain).sum() + 1) * np.repeat(np.arange(len(n)), n)
    summed = np.cumsum(gain)
    low = np.minimum.accumulate(summed - gain - apart) + apart
    most = np.maximum.reduceat(summed - low, at[full])
    mixed = full[most >= switch - 1e-3]
    if len(mixed):
        words = np.concatenate([np.arange(at[i], at[i + 1]) for i in mixed])
        path[words] = viterbi(scores[words], np.concatenate([[0], np.cumsum(n[mixed])]), switch)
    return path, total


_kept: dict = {}


def _predict(model: Model, key: str, texts: list[str], spans: bool) -> Iterator[tuple[str, float, list | None]]:
    if not model.langs:
        yield from (("und", 0.0, []) for _ in texts)
        return
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Words()
    words = _kept[key]
    numbers = words.look_up(model, texts)
    at = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    path, total = best_paths(words.scores[flat], at) if len(flat) else (np.zeros(0, np.uint8), None)
    turned = np.flatnonzero(np.diff(path)) + 1
    for i, text in enumerate(texts):
        a, b = at[i], at[i + 1]
        if a == b:
            yield "und", 0.0, []
            continue
        turns = turned[np.searchsorted(turned, a, "right") : np.searchsorted(turned, b)] - a
        if not len(turns):
            k, share, found = int(path[a]), 1.0, [(model.langs[path[a]], 0, len(text))]
        else:
            own = path[a:b]
            where = [m.span() for m in _WORD.finditer(text)]
            letters = np.bincount(own, [e - s for s, e in where], len(model.langs))
            begins = [0, *turns.tolist()]
            ends = [where[j][0] for j in begins[1:]] + [len(text)]
            k = int(letters.argmax())
            share = float(letters[k] / letters.sum())
            found = [(model.langs[own[j]], s, e) for j, s, e in zip(begins, [0, *ends[:-1]], ends, strict=True)]
        rest = np.delete(total[i], k)
        odds = 1 / (1 + math.exp(-max(-30.0, min(30.0, total[i, k] - rest.max())))) if len(rest) else 1.0
        yield model.langs[k], share * odds, found if spans else []


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, begin, end in characters) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = list(_predict(shared.value, key, [t or "" for t in batch.column(1).to_pylist()], spans))
            kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            labelled = pa.array([[dict(zip(("lang", "begin", "end"), s, strict=True)) for s in x[2]] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), labelled], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,begin:int,end:int>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 5) == 0, F.lit(False))


def op1(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, label all rows."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
