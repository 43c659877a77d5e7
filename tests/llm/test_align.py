"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparklog.llm import align
from sparklog.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """Lists of A and B ids of each group, by walking both streams; None without tokens."""
    a, b = libraries
    if not text:
        return None
    symbols = align._bytes_of_symbols()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    out, x, y, i, j = [([], [])], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if x == y and out[-1][0]:
            out.append(([], []))
        if x <= y:
            out[-1][0].append(ids_a[i])
            x, i = x + len(bytes_a[i]), i + 1
        else:
            out[-1][1].append(ids_b[j])
            y, j = y + len(bytes_b[j]), j + 1
    return out


def brute(libraries, docs):
    groups = [plain_groups(libraries, t) for _, t in docs]
    links = [Counter(p for g in gs or [] for p in product(*g)) for gs in groups]
    count = Counter(p for c in links for p in c)
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for (doc_id, _), gs, c in zip(docs, groups, links, strict=True):
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs or [])
        best = sum(n for p, n in c.items() if count[p] == highest[p[0]])
        numbers = (sum(len(a) for a, _ in gs or []), sum(len(b) for _, b in gs or []), len(gs or []), c.total(), best, sum(n * count[p] for p, n in c.items()))
        out.append((doc_id, *numbers, hashlib.sha256(listed.encode()).hexdigest() if gs else ""))
    return out, count, highest


TEXTS = [None, "", " ", "  ", "x ", "x  ", "\n", " \n x\n\n  y", "a  b   c \n  d\t e", "<|endoftext|> <s></s><unk> <0x41>", "a▁b", "don't I'll 1234567 <|endoftext|>x", "日本語のテキスト 한국어 😀😀   x", "ﬁne ｆｕｌｌ", "a" * 3000, "ab" * 700 + " " + "=" * 500, "x\0 y \x1c z \x85 \xa0w", "same text", "same text", "é é"]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "tokenizers", "of", "Überraschung", "naïve", "12,345.67", "\n", "", "|", "日本", "😀", "x=y;", "re-encode", "<|endoftext|>", "\t", "ß"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    made += ["".join(rng.choice("ab '\n\t.1é日 ") for _ in range(150)) for _ in range(n // 2)]
    return [(i, t) for i, t in enumerate(TEXTS + made)] + [(None, "no id"), (3, "again an id")]


@pytest.mark.parametrize("long", [40, 1 << 15])
def test_against_whole_texts(spark, libraries, long):
    """Documents of over ``long`` bytes go in parts, their fragments are composed by several tasks."""
    docs = documents()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, chunk string").repartition(3)
    got = sorted((tuple(r) for r in align.align_documents(df, A, B, long=long).collect()), key=str)
    assert got == sorted(brute(libraries, docs)[0], key=str)


def test_empty_table_and_pairs(spark, libraries):
    docs = documents(2, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert align.align_documents(df.limit(0), A, B).count() == 0
    _, count, highest = brute(libraries, docs)
    got = {(r.a, r.b): (r.documents, r.best) for r in align.pair_table(df, A, B).collect()}
    assert got == {p: (n, n == highest[p[0]]) for p, n in count.items()}


def a_fragment(rng, t, text, cuts):
    """Fragments of the byte ranges of ``text`` between ``cuts``."""
    a, b = (np.array(x[0], np.int64) for x in t.encode([text]))
    ends_a, ends_b = t.size_a[a].cumsum(), t.size_b[b].cumsum()
    at = [0, *cuts, len(text.encode())]
    out = []
    for low, high in zip(at, at[1:], strict=False):
        (i, k), (j, m) = (np.searchsorted(e, [low, high], "right") for e in (ends_a, ends_b))
        out.append(align.Fragment.of(a[i:k], ends_a[i:k], b[j:m], ends_b[j:m]))
    return out


def plain(f):
    return (list(f.head[0]), list(f.head[1]), list(f.tail[0]), list(f.tail[1]), f.ends, ";".join(f.groups), f.codes.tolist(), f.counts.tolist())


def test_fragments_are_a_monoid():
    """Any cuts and any order of composing give the fragment of the whole; cuts fall within tokens, too."""
    rng = random.Random(4)
    t = align.tokenizers_of(A, B)
    for _ in range(60):
        text = " " + "".join(rng.choice("internationalisation =日é12") for _ in range(rng.randint(1, 60)))
        size = len(text.encode())
        whole = a_fragment(rng, t, text, [])[0]
        parts = a_fragment(rng, t, text, sorted(rng.sample(range(1, size), min(size - 1, rng.randint(0, 9)))))
        assert plain(align.compose(align.Fragment(), whole)) == plain(whole)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [align.compose(parts[i], parts[i + 1])]
        assert plain(parts[0]) == plain(whole)


def test_groups_with_many_pairs(monkeypatch):
    monkeypatch.setattr(align, "_MANY", 2)
    a, b = np.array([5, 5, 6, 9]), np.array([1, 2, 2, 7])
    group, codes, counts = align._links(a, np.array([0, 0, 0, 1]), b, np.array([0, 0, 0, 1]), 2)
    got = {(g, c // align._B_IDS, c % align._B_IDS): n for g, c, n in zip(group.tolist(), codes.tolist(), counts.tolist(), strict=True)}
    assert got == {(0, 5, 1): 2, (0, 5, 2): 4, (0, 6, 1): 1, (0, 6, 2): 2, (1, 9, 7): 1}
