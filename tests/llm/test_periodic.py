"""Periodic runs against every period tried at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparklog.llm import periodic


def brute(words):
    """start, length, period of the runs, by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, length = i, j + q - i
            least = next(p for p in range(1, q + 1) if all(words[x] == words[x + p] for x in range(a, a + length - p)))
            if length >= max(6, 4 * q) and least == q:
                out.append((a, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def a_text(rng, most=120):
    """Words with repeats of repeats put in."""
    words = [rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
    while len(words) < most and rng.random() < 0.8:
        a = rng.randrange(len(words) + 1)
        unit = [rng.choice("abxyz") for _ in range(rng.randint(1, 9))]
        words[a:a] = (unit * rng.randint(1, 9))[: rng.randint(1, 60)] + words[a : a + 5] * rng.randint(0, 3)
    return words


def test_intervals_of_streams():
    rng = random.Random(1)
    for _ in range(120):
        texts = [a_text(rng) for _ in range(rng.randint(1, 6))]
        stream, starts, ends = [], [], []
        for i, t in enumerate(texts):
            starts.append(len(stream))
            stream += [ord(c) for c in t]
            ends.append(len(stream))
            stream.append(-1 - i)
        found = periodic.intervals(np.array(stream, np.int64), np.array(starts), np.array(ends))
        got = [sorted(((a, b - a, q) for x, q, a, b in found if x == i and b - a >= max(6, 4 * q)), key=lambda r: (r[0], r[2])) for i in range(len(texts))]
        assert got == [brute(t) for t in texts]


def test_z_function():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        z = periodic.z_function(s)
        assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


EDGES = [
    (0, None),
    (1, ""),
    (2, " \t\n\r\x0b\x0c "),
    (3, "a a a a a a"),
    (4, "a a a a a"),
    (5, "a b a b a b a b\n"),
    (5, "a b a b a b a b\n"),
    (6, "a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b \x1c x"),
    (None, "x y x y x y x y x y"),
    (7, "a b c " * 4 + "z " + "b a " * 4),
]


@pytest.mark.parametrize("span", [64, 8192])
def test_query(spark, span):
    """Long documents are cut into rows; ids whose crc32 asks for it are edited."""
    rng = random.Random(span)
    ids = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40] + list(range(100, 160))
    docs = EDGES + [(i, rng.choice(" \n\t").join(a_text(rng, 300))) for i in ids]
    docs.append((11, " ".join(rng.choice("abc") for _ in range(400)) + " " + "p q r " * 200))
    docs.append((12, "same " * 1500))
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_runs string")
    got = sorted(map(tuple, periodic.op12(df.repartition(3), span).collect()), key=str)
    assert got == sorted((described(*d) for d in docs), key=str)
    assert periodic.op12(df.limit(0)).count() == 0


def test_runs_as_rows(spark):
    df = spark.createDataFrame([("k k k k k k k", 9), ("no run", 10)], "body string, id long")
    assert [tuple(r) for r in periodic.periodic_runs(df, "id", "body").collect()] == [(9, 0, 7, 1)]


def test_long_document_is_near_linear():
    w = np.zeros(200_000, np.int64)
    for low, high, base, part in periodic._rows_of(w.astype(np.int32), periodic.SPAN):
        if low > 12:
            continue
        found = periodic.intervals(part.astype(np.int64), np.array([0]), np.array([len(part)]), base > 0, base + len(part) < len(w), (low, high))
        assert [x[1] for x in found] == ([1] if low == 0 else [])
