"""Near-duplicates, line deduplication and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparklog.llm import components, fingerprint, line_dedup, near_dedup, shingles, superminhash
from sparklog.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, band string, node long"


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 30, 80]))))
    return out


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def test_near_duplicates(spark):
    rows = [(i * 7, t) for i, t in enumerate(corpus())] + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "Short one"), (9005, "short ONE"), (9006, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_hub_of_a_large_group(spark):
    """Copies that are like the original, but not like each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(400), 9):
            own[at] = f"c{i}x{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len({c for _, c, _ in got.values()}) < 61


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "u v w x y z")]
    got = sorted(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "None", False), ("3", "None", False), ("4", "4", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_sets_have_the_sizes_of_brute_force():
    texts = corpus(4, 50) + ["", None, "a", "É é E e x", "a\x0bb\x0cc d\te"]
    _, at = shingles.shingle_sets(pa.array(texts))
    assert np.diff(at).tolist() == [len(shingle_set(t)) for t in texts]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    a, b = x[:700], x[200:]
    sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, 700, 1400]), 512)
    assert abs((sig[0] == sig[1]).mean() - 500 / 900) < 0.08
    one = superminhash.signatures(x[:1], np.array([0, 1, 1]), 16)
    assert sorted(np.floor(one[0]).tolist()) == list(range(16)) and np.isinf(one[1]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x} | {x: x for x in linked if x in got and find(x) == x}
    assert all(x in got for x in linked if find(x) != x)


def line_brute(rows):
    seen, out = [], {}
    for d, text in sorted(rows):
        if text is None:
            out[d] = (None, 0, 0)
            continue
        kept = []
        lines = text.split("\n")
        for line in lines:
            s = set(line.translate(LOW).replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")) - {""}
            if s and any(100 * len(s & t) >= 85 * len(s | t) for t in seen):
                pass
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def line_rows(n=40):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(120)]
    lines = ["", "Common line", "common LINE", "a\tb  c"]
    for _ in range(150):
        words = rng.choice(lines).split() if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 8, 20, 60]))]
        if len(words) > 10 and rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(" ".join(words))
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 5, 12])))) for i in range(n)] + [(500, None), (501, ""), (502, "\n\n")]


def test_line_dedup(spark, monkeypatch):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, l int")
    expected = line_brute(rows)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.op2(df).collect()} == expected
    monkeypatch.setattr(line_dedup, "SMALL", 1)  # no table is broadcast
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.op2(df).collect()} == expected
    assert line_dedup.without_repeated_lines(df).columns == ["doc_id", "text", "l"]
    named = df.select("doc_id", "text", *[F.lit(77).alias(c) for c in ("n_lines", "n_removed", "d", "gone", "row", "a.b")])
    kept = line_dedup.without_repeated_lines(named, n_removed="lines gone")
    assert kept.columns == [*named.columns, "lines gone"] and {tuple(r)[2:8] for r in kept.collect()} == {(77,) * 6}
    assert {r[0]: (r[1], r[8]) for r in kept.collect()} == {d: (t, m) for d, (t, _, m) in expected.items()}
    assert line_dedup.op2(df.limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (1, "x y\nz"), (1, "x y\nz")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in line_dedup.op2(df).collect()) == [("1", "z", 1), ("1", "z", 1), ("None", "x y", 0)]


def test_line_dedup_sql(spark, sf_dir, same_rows):
    same_rows(registry.queries()["op2_line_dedup"](spark, sf_dir), registry.oracle_sql()["op2_line_dedup"])


def plain_likeness(a, b):
    """By multisets: characters of clauses of paragraphs that only one of the texts has."""
    lines = [Counter(x for x in t.split("\n") if x.strip()) for t in (a, b)]
    clauses = lambda c: Counter(w for line, n in c.items() for w in fingerprint._CLAUSE.findall(line) * n)
    x, y = clauses(lines[0] - lines[1]), clauses(lines[1] - lines[0])
    n = sum(len(w) * m for c in lines for w, m in c.items())
    return max(0, 1 - sum(len(w) * m for w, m in ((x - y) + (y - x)).items()) / n) if n else 1.0


def test_fingerprints(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma,", "delta.", "eps\n"]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for i in rng.sample(range(10_000), 90)]
    rows += [(20_000, None), (20_001, ""), (20_002, rows[0][1]), (20_003, "same. " * 500), (20_004, "x" * 50_000)]
    got = {r.doc_id: r for r in fingerprint.op3(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int")).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    by_text = {}
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - plain_likeness(t, edited)) < 1e-9 and abs(r.near_next - plain_likeness(t, following)) < 1e-9
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_likeness_across_lengths():
    """Near copies of 295 and 305 characters, and of 200 and 400, are cut by one rule."""
    rng = random.Random(8)
    text = " ".join(str(rng.randrange(1000, 10_000)) for _ in range(80))
    for short, long, least in ((295, 305, 0.8), (200, 400, 0.5)):
        a, b = ([fingerprint.paragraphs(text[:n])] for n in (short, long))
        assert fingerprint.likeness(a, b)[0] >= least


def test_fingerprints_subtract(spark):
    one = "\n".join(f"paragraph {i}" for i in range(300))
    rows = [(1, one), (2, one.replace("paragraph 7\n", "another\n")), (3, "\n".join(f"other {i}" for i in range(90)))]
    got = {r.doc_id: r.fingerprint for r in fingerprint.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    digest = lambda t: fingerprint.paragraphs(t)[0]
    assert [list(x) for x in fingerprint.differing(got[1], got[2])] == [digest("paragraph 7"), digest("another")]
    assert fingerprint.differing(got[1], got[3]) is None and [list(x) for x in fingerprint.differing(got[1], got[1])] == [[], []]


def test_fingerprint_single_and_empty(spark):
    one = fingerprint.op3(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].doc_id is None and one[0].near_next == 1.0
    assert fingerprint.op3(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_recovers_both_sides():
    a, b = list(range(1, 400)), list(range(200, 900))
    (only_a, only_b), = fingerprint.differences([a], [b])
    assert sorted(only_a) == list(range(1, 200)) and sorted(only_b) == list(range(400, 900))
