"""Baseline statistics of process starts, and anomaly scores against them.

Process events have the columns source_file and record_id (together their key), sec, computer, process, parent, command.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of an event: its number, and the file that the number counts in.
EVENT = ["source_file", "record_id"]
#: Counts that are held at once when windows roll.
CELLS = 1 << 20
#: Bits of what was never seen, and the most that any surprise counts.
MOST_BITS = 20.0
WEIGHTS = {"command": 0.35, "lineage": 0.25, "depth": 0.25, "ppid": 0.15, "drift": 0.10, "hash": 0.10}
TIERS = (20.0, 45.0, 70.0)
MILD, STRONG = 0.15, 0.35


def stability(events: DataFrame) -> DataFrame:
    """1 - distinct (process, command) / events, and the gate it falls under."""
    out = events.agg(F.count("*").alias("n"), F.countDistinct("process", "command").alias("kinds"))
    value = F.when(F.col("n") > 0, 1 - F.col("kinds") / F.col("n")).otherwise(0.0)
    gate = F.when(value < 0.3, "abort").when(value < 0.6, "warn").otherwise("pass")
    return out.select("n", "kinds", F.round(value, 6).alias("stability"), gate.alias("gate"))


def frequencies(events: DataFrame, given: str, item: str) -> DataFrame:
    """Counts of (given, item), with the total and the number of items of each ``given``."""
    pairs = events.groupBy(given, item).agg(F.count("*").alias("c"))
    totals = pairs.groupBy(given).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    return pairs.join(totals, given)


def surprisal(events: DataFrame, baseline: DataFrame, given: str, item: str, out: str) -> DataFrame:
    """``events`` with the bits of ``item`` given ``given``, smoothed by one; unseen ``given`` has the most."""
    known = frequencies(baseline, given, item)
    totals = known.select(given, "total", "kinds").distinct()
    pairs = known.select(given, item, "c")
    rows = events.join(totals, given, "left").join(pairs, [given, item], "left")
    bits = -F.log2((F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + F.col("kinds")))
    value = F.when(F.col("total").isNull(), MOST_BITS).otherwise(F.least(F.lit(MOST_BITS), F.greatest(bits, F.lit(0.0))))
    return rows.withColumn(out, value).drop("total", "kinds", "c")


def membership(events: DataFrame, baseline: DataFrame, keys: list[str], out: str = "member") -> DataFrame:
    """Whether the baseline has the row's keys; an exact join."""
    known = baseline.select(*keys).distinct().withColumn(out, F.lit(True))
    return events.join(known, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def chain_prefixes(chains: DataFrame, chain: str = "chain", most: int = 5) -> DataFrame:
    """All prefixes, to ``most``, of ancestry chains as texts with their depth."""
    lengths = F.sequence(F.lit(1), F.least(F.size(chain), F.lit(most)))
    rows = chains.where(F.size(chain) > 0).select("*", F.explode(lengths).alias("depth"))
    return rows.withColumn("prefix", F.concat_ws(">", F.slice(F.col(chain), F.lit(1), F.col("depth"))))


def prefix_depth(events: DataFrame, baseline: DataFrame, chain: str = "chain", most: int = 5) -> DataFrame:
    """Key, depth of the longest known prefix, and the score 1 - depth / min(length, most); 1 for an empty chain."""
    known = chain_prefixes(baseline, chain, most).select("prefix").distinct()
    hits = chain_prefixes(events.select(*EVENT, chain), chain, most).join(known, "prefix", "left_semi")
    depths = hits.groupBy(*EVENT).agg(F.max("depth").alias("depth"))
    size = F.least(F.size(chain), F.lit(most))
    rows = events.select(*EVENT, chain).join(depths, EVENT, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return rows.select(*EVENT, "depth", F.round(F.when(size <= 0, 1.0).otherwise(1 - F.col("depth") / size), 6).alias("depth_score"))


def shares(baseline: DataFrame) -> DataFrame:
    """process and q, its share of the baseline's events."""
    totals = baseline.groupBy("process").agg(F.count("*").alias("c"))
    every = baseline.agg(F.count("*").alias("all"))
    return totals.join(F.broadcast(every)).select("process", (F.col("c") / F.col("all")).alias("q"))


def _divergence(counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row of counts (one per process) from the shares ``q``.

    What the baseline has beyond the row's processes adds half of its share.
    """
    p = counts / counts.sum(axis=1, keepdims=True)
    seen = counts > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(seen, p * np.log2(2 * p / (p + q)), 0)
        other = np.where(seen & (q > 0), q * np.log2(2 * q / (p + q)), 0)
    return np.clip(0.5 * (own + other).sum(axis=1) + 0.5 * (1 - (seen * q).sum(axis=1)), 0, 1)


def _rolling(seconds: int):
    """Arrow function over the counts (sec, process, n, q) of a host's chunk of time and of the window before it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, at, names, n, q, own = (c.to_numpy(zero_copy_only=False) for c in table.select(["computer", "sec", "process", "n", "q", "own"]).columns)
        order = np.argsort(at, kind="stable")
        at, n, q, own = at[order], n[order], q[order], own[order]
        _, first, process = np.unique(names[order].astype(str), return_index=True, return_inverse=True)
        share = q[first]
        moments = np.unique(at[own])
        out = np.zeros(len(moments))
        rows = max(1, CELLS // len(share))
        for k in range(0, len(moments), rows):
            part = moments[k : k + rows]
            # counts of the first moment, then what enters and leaves before each of the others
            change = np.zeros((len(part), len(share)), np.int64)
            inside = (at >= part[0] - seconds) & (at <= part[0])
            np.add.at(change[0], process[inside], n[inside])
            enter = (at > part[0]) & (at <= part[-1])
            np.add.at(change, (np.searchsorted(part, at[enter]), process[enter]), n[enter])
            leave = (at >= part[0] - seconds) & (at < part[-1] - seconds)
            np.add.at(change, (np.searchsorted(part - seconds, at[leave], "right"), process[leave]), -n[leave])
            out[k : k + rows] = _divergence(change.cumsum(axis=0), share)
        host = pa.array([key[0].as_py()] * len(moments), pa.string())
        return pa.Table.from_arrays([host, pa.array(moments, pa.int64()), pa.array(out)], names=["computer", "sec", "drift"])

    return run


def drift(events: DataFrame, baseline: DataFrame, seconds: int) -> DataFrame:
    """Key and the Jensen-Shannon divergence of the host's last ``seconds`` from the baseline's processes.

    All events of a host's second have one window.  Counts per host, second and process are made first; windows roll
    over them within chunks of time, entering and leaving, so that the work of a host grows with its seconds times
    the processes of a window, not with pairs of events, and no task holds more than a chunk and a window of seconds.
    Events without a host, process or time have none.
    """
    rows = events.select(*EVENT, "sec", "computer", "process").where("computer is not null and sec is not null and process is not null")
    counts = rows.groupBy("computer", "sec", "process").agg(F.count("*").alias("n")).join(shares(baseline), "process", "left")
    chunk = lambda c: F.floor(c / (4 * seconds))
    both = counts.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(F.col("sec")), chunk(F.col("sec") + seconds)))))
    both = both.select("computer", "chunk", "sec", "process", "n", F.coalesce("q", F.lit(0.0)).alias("q"), (F.col("chunk") == chunk(F.col("sec"))).alias("own"))
    found = both.groupBy("computer", "chunk").applyInArrow(_rolling(seconds), "computer string, sec long, drift double")
    return rows.join(found, ["computer", "sec"]).select(*EVENT, F.round("drift", 6).alias("drift"))


def composite(command: Column, lineage: Column, depth: Column, ppid: Column, host_drift: Column, new_hash: Column, w: dict = WEIGHTS) -> Column:
    """Score of 0 to 100, one decimal."""
    share = lambda c: F.least(c, F.lit(MOST_BITS)) / MOST_BITS
    raw = w["command"] * share(command) + w["lineage"] * share(lineage) + w["depth"] * depth + w["ppid"] * ppid
    return F.round(F.least(F.lit(1.0), raw + raw * host_drift * w["drift"] + new_hash * w["hash"]) * 100, 1)


def capped(score: Column, member: Column, ppid: Column, host_drift: Column, most: float = 19.0) -> Column:
    """Known triples without other signs count half, and ``most`` at most."""
    calm = member & (ppid == 0) & (host_drift < STRONG)
    return F.when(calm, F.least(score / 2, F.lit(most))).otherwise(score)


def tier(score: Column, bounds: tuple[float, float, float] = TIERS) -> Column:
    a, b, c = bounds
    return F.when(score >= c, 4).when(score >= b, 3).when(score >= a, 2).otherwise(1)


def justification(command: Column, lineage: Column, depth: Column, ppid: Column, host_drift: Column) -> Column:
    """Reasons in order of weight."""
    reasons = [
        F.when(ppid > 0, "parent ended before the start"),
        F.when(depth > 0.5, "ancestry not in the baseline"),
        F.when(command > 10, "rare command"),
        F.when((lineage > 10) & (depth <= 0.5), "rare parent"),
        F.when(host_drift >= STRONG, "host behaves unlike itself").when(host_drift >= MILD, "host drifts"),
    ]
    text = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return F.when(text == "", "small difference").otherwise(text)
