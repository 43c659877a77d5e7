"""Bursts against a plain walk, with short and long islands."""

import random

import pytest

from sparklog.operators import sequences


def greedy(rows, seconds, least, least_distinct=0):
    """Bursts of one key's rows (sec, id, value) by walking them in order."""
    rows, out, i = sorted(rows), [], 0
    while i < len(rows):
        window = [r for r in rows[i:] if r[0] - rows[i][0] <= seconds]
        if len(window) >= least and len({r[2] for r in window}) >= least_distinct:
            out.append((window[0][0], window[-1][0], len(window), window[0][1], window[-1][1]))
            i += len(window)
        else:
            i += 1
    return out


@pytest.mark.parametrize(("fold", "spread"), [(4096, 64), (2, 2), (0, 3)])
def test_bursts(spark, monkeypatch, fold, spread):
    """One key has one island of all its rows; ``fold`` 0 walks every island by pointers."""
    monkeypatch.setattr(sequences, "SPREAD", spread)
    rng = random.Random(fold)
    rows = [(k, rng.randrange(600 if k else 250), i, rng.choice("abc")) for k in range(4) for i in range(90 if k else 250)]
    df = spark.createDataFrame([(f"k{k}", s, i, v) for k, s, i, v in rows], "k string, sec long, record_id long, v string")
    for least, distinct in ((3, 0), (2, 3)):
        found = sequences.bursts(df, ["k"], 10, least, distinct="v" if distinct else None, least_distinct=distinct, fold=fold)
        got = sorted((r.k, r.start_s, r.end_s, r.n, r.first_id, r.last_id) for r in found.collect())
        assert got == sorted((f"k{k}", *b) for k in range(4) for b in greedy([r[1:] for r in rows if r[0] == k], 10, least, distinct))
        members = sequences.burst_rows(df, found, ["k"], 10)
        assert members.count() == sum(r[3] for r in got)


def test_bursts_of_rows_without_key(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 1, 2), ("a", None, 3), ("a", 5, 4), ("a", 5, 5)], "k string, sec long, record_id long")
    assert [tuple(r) for r in sequences.bursts(df, ["k"], 3, 2).collect()] == [("a", 5, 5, 2, 4, 5)]
    assert sequences.bursts(df.limit(0), ["k"], 3, 2).count() == 0


def test_one_island_of_many_bursts(spark):
    """Each second holds a row: one island, walked in rounds that grow with its logarithm."""
    df = spark.range(200_000).selectExpr("'h' as k", "id as sec", "id as record_id")
    found = sequences.bursts(df, ["k"], 9, 10)
    assert found.count() == 20_000
    assert found.where("start_s % 10 <> 0 or n <> 10").count() == 0


def test_no_window_of_a_burst_is_summed_anew(spark, monkeypatch):
    """Frames have one end, so that they grow row by row; values may be null and don't count then."""
    plans, real = [], sequences.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return real(df, name)

    monkeypatch.setattr(sequences, "stored", stored)
    monkeypatch.setattr(sequences, "SPREAD", 3)
    rng = random.Random(9)
    rows = [(f"k{i % 2}", rng.randrange(300), i, rng.choice(["a", "b", "c", None, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, sec long, record_id long, v string")
    found = sequences.bursts(df, ["k"], 10, 3, distinct="v", least_distinct=3, fold=0)
    expected = []
    for k in ("k0", "k1"):
        own, i = sorted(r[1:] for r in rows if r[0] == k), 0
        while i < len(own):
            window = [r for r in own[i:] if r[0] - own[i][0] <= 10]
            good = len(window) >= 3 and len({r[2] for r in window} - {None}) >= 3
            expected += [(k, window[0][0], window[-1][0], len(window), window[0][1], window[-1][1])] if good else []
            i += len(window) if good else 1
    assert sorted((r.k, r.start_s, r.end_s, r.n, r.first_id, r.last_id) for r in found.collect()) == sorted(expected)
    assert any("RangeFrame" in p for p in plans)
    frames = [f for p in plans for f in p.split("specifiedwindowframe(RangeFrame, ")[1:]]
    assert all(f.startswith("unboundedpreceding$()") for f in frames)
