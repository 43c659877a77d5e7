"""Rolling divergence against each window counted on its own."""

import random
from collections import Counter
from math import log2

import pytest

from sparklog.operators import baseline


def plain(window, share):
    n, out = len(window), 0.0
    counts = Counter(window)
    for p in set(counts) | set(share):
        a, b = counts[p] / n, share.get(p, 0.0)
        out += 0.5 * sum(x * log2(2 * x / (a + b)) for x in (a, b) if x > 0)
    return min(1.0, max(0.0, out))


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_drift(spark, monkeypatch, cells):
    """Two hosts, seconds with many events, windows over the border of a chunk; the same record ids in two files."""
    rng = random.Random(cells)
    rows = [(f"f{h}", i, rng.randrange(200), f"H{h}", rng.choice("abcde")) for h in range(2) for i in range(300)]
    schema = "source_file string, record_id long, sec long, computer string, process string"
    old = [("g", i, 0, "H0", p) for i, p in enumerate("aabbbcx")]
    df = spark.createDataFrame([*rows, ("f0", 900, None, "H0", "a"), ("f0", 901, 5, None, "a")], schema)
    monkeypatch.setattr(baseline, "CELLS", cells)
    got = {(r.source_file, r.record_id): r.drift for r in baseline.drift(df, spark.createDataFrame(old, schema), 10).collect()}
    share = {p: n / 7 for p, n in Counter("aabbbcx").items()}
    want = {(f, i): plain([r[4] for r in rows if r[3] == h and 0 <= s - r[2] <= 10], share) for f, i, s, h, _ in rows}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_drift_of_a_hot_host(spark):
    """Many events of one second: counted once, and no pairs of events."""
    df = spark.range(200_000).selectExpr("'f' as source_file", "id as record_id", "id div 10000 as sec", "'H' as computer", "concat('p', id % 3) as process")
    found = baseline.drift(df, df, 1800)
    assert found.count() == 200_000 and found.where("drift > 0.001").count() == 0
