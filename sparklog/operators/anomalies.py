"""Anomaly scores of process starts on their real lineage, against a baseline of earlier starts.

Starts are those of ``lineage.process_events``, with parents by GUID or number, ancestry, and command templates.
Keys are source_file and record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.scalars import masked_command
from sparklog.operators import baseline as B
from sparklog.operators.lineage import ancestry, with_parents


def starts(events: DataFrame) -> DataFrame:
    """Key, sec, computer, process, parent (the one found, else the one that the event names), command (template), chain, ppid_flag and image_hash of each start."""
    found = with_parents(events)
    rows = found.join(ancestry(found), "event")
    return rows.select("event.source_file", "event.record_id", "sec", "computer", F.col("name").alias("process"), F.coalesce("parent", "parent_name").alias("parent"), masked_command(F.col("command")).alias("command"), "chain", F.col("ppid_mismatch").cast("double").alias("ppid_flag"), "image_hash")


def new_hashes(rows: DataFrame) -> DataFrame:
    """Key and new_hash: 1 for the first start with a hash of a process that had another before, else 0."""
    at = F.struct("sec", "record_id", "source_file")
    hashed = rows.where("image_hash <> '' and process <> ''")
    by_hash = hashed.groupBy("process", "image_hash").agg(F.min(at).alias("first"))
    by_process = by_hash.groupBy("process").agg(F.min("first").alias("process_first"))
    fresh = by_hash.join(by_process, "process").where("first > process_first").select("first.source_file", "first.record_id", F.lit(1.0).alias("new_hash"))
    return rows.select(*B.EVENT).join(fresh, B.EVENT, "left").na.fill(0.0, ["new_hash"])


def common_parents(old: DataFrame) -> DataFrame:
    """process and usual_parent, the most frequent one (of equals the first by name)."""
    counts = old.where("parent <> ''").groupBy("process", "parent").agg(F.count("*").alias("n"))
    return counts.groupBy("process").agg(F.min_by("parent", F.struct((-F.col("n")).alias("less"), "parent")).alias("usual_parent"))


def scored(rows: DataFrame, old: DataFrame, seconds: int = 1800, bounds: tuple[float, float, float] = B.TIERS) -> DataFrame:
    """``rows`` of ``starts`` with bits_command, bits_lineage, depth_score, member, drift, new_hash, usual_parent, score and tier, against ``old``.

    Starts without a host have no drift of their own (0).
    """
    out = B.surprisal(rows, old, "process", "command", "bits_command")
    out = B.surprisal(out, old, "parent", "process", "bits_lineage")
    out = B.membership(out, old, ["process", "parent", "command"])
    key = B.EVENT
    out = out.join(B.prefix_depth(rows.select(*key, "chain"), old.select(*key, "chain")).select(*key, "depth_score"), key)
    out = out.join(B.drift(rows, old, seconds), key, "left").na.fill(0.0, ["drift"])
    out = out.join(new_hashes(rows), key).join(common_parents(old), "process", "left")
    c = F.col
    raw = B.composite(c("bits_command"), c("bits_lineage"), c("depth_score"), c("ppid_flag"), c("drift"), c("new_hash"))
    out = out.withColumn("raw", raw).withColumn("score", B.capped(c("raw"), c("member"), c("ppid_flag"), c("drift"), bounds[0] - 1)).drop("raw")
    return out.withColumn("tier", B.tier(c("score"), bounds))


def reasons() -> Column:
    """Why a start of ``scored`` stands out, the weightiest reason first."""
    c, bits = F.col, lambda name: F.round(name, 1).cast("string")
    deep = c("depth_score") > 0.5
    parts = [
        F.when(c("ppid_flag") > 0, "the parent's number had ended before the start"),
        F.when(deep & c("usual_parent").isNull(), "process without an ancestry in the baseline").when(deep & (c("usual_parent") != F.coalesce("parent", F.lit(""))), F.concat(F.lit("parent is "), F.coalesce(F.nullif("parent", F.lit("")), F.lit("unknown")), F.lit(", usually "), "usual_parent")),
        F.when(c("bits_command") > 10, F.concat(F.lit("rare command, "), bits("bits_command"), F.lit(" bits"))),
        F.when((c("bits_lineage") > 10) & ~deep, F.concat(F.lit("rare pair "), "parent", F.lit(" > "), "process", F.lit(", "), bits("bits_lineage"), F.lit(" bits"))),
        F.when(c("drift") >= B.STRONG, F.concat(F.lit("host behaves unlike itself, "), F.round("drift", 3).cast("string"))).when(c("drift") >= B.MILD, F.concat(F.lit("host drifts, "), F.round("drift", 3).cast("string"))),
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return F.when(text == "", "small difference").otherwise(text)


def metrics(found: DataFrame, most: int = 10) -> DataFrame:
    """One row: numbers of each tier, the share that is suppressed (tier 1), the highest and the mean score, and the ``most`` processes suppressed most often."""
    quiet = found.where("tier = 1").groupBy("process").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "process").limit(most)
    top = quiet.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "process"))).alias("top"))
    of = lambda t: F.count_if(F.col("tier") == t).alias(f"tier_{t}")
    one = found.agg(F.count("*").alias("events"), *[of(t) for t in (1, 2, 3, 4)], F.round(F.max("score"), 4).alias("most"), F.round(F.avg("score"), 4).alias("mean"))
    share = F.round(F.when(F.col("events") > 0, 100.0 * F.col("tier_1") / F.col("events")).otherwise(0.0), 2)
    return one.withColumn("suppressed_percent", share).join(F.broadcast(top)).withColumn("suppressed", F.col("top")["process"]).drop("top")
