"""Script blocks from fragments, their contents and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZERO_ID = "00000000-0000-0000-0000-000000000000"
MISSING = "<missing fragment>"

#: Flags of block contents, by pattern, with the technique of each.
FLAGS = {
    "encoded": (r"(?i)(-enc|frombase64string)", "T1027"),
    "download": (r"(?i)(downloadstring|downloadfile|webrequest|webclient|bitstransfer)", "T1105"),
    "reflection": (r"(?i)(reflection\.assembly|assembly\.load)", "T1620"),
    "injection": (r"(?i)(virtualalloc|writeprocessmemory|createthread)", "T1055"),
    "credentials": (r"(?i)(mimikatz|sekurlsa|lsass)", "T1003"),
    "discovery": (r"(?i)(get-aduser|whoami|get-process|net user)", "T1087"),
    "persistence": (r"(?i)(schtasks|new-service|currentversion\\run)", "T1053.005"),
    "invoke": (r"(?i)(invoke-expression|iex[ (])", "T1059.001"),
}


def script_blocks(fragments: DataFrame) -> DataFrame:
    """Blocks of (block_id, record_id, number, total, text): one text per number (the longer, then the first),
    joined in order with a mark for what is missing.  An all-zero id makes a block of each record.
    """
    key = F.when(F.col("block_id") == ZERO_ID, F.concat_ws(":", "block_id", "record_id")).otherwise(F.col("block_id"))
    rows = fragments.withColumn("block", key).withColumn("text", F.replace("text", F.lit("\0"), F.lit("")))
    rank = F.row_number().over(W.partitionBy("block", "number").orderBy(F.desc(F.length("text")), "record_id"))
    best = rows.withColumn("_r", rank)
    parts = best.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_r") == 1, F.struct("number", "text")))).alias("parts"),
        F.max("total").alias("total"),
        F.min("record_id").alias("first_record"),
        F.count("*").alias("fragments"),
    )
    numbers = F.sequence(F.lit(1), F.col("total"))
    text = F.array_join(F.transform(numbers, lambda n: F.coalesce(F.element_at("parts", n), F.lit(MISSING))), "")
    missing = F.size(F.filter(numbers, lambda n: ~F.array_contains(F.map_keys("parts"), n)))
    return parts.select("block", "first_record", "fragments", "total", missing.alias("missing"), (missing == 0).alias("complete"), text.alias("text"))


def block_flags(blocks: DataFrame) -> DataFrame:
    """``blocks`` with a flag per kind of content and the techniques, the interpreter's own always among them."""
    out = blocks.select("*", *[F.col("text").rlike(p).alias(name) for name, (p, _) in FLAGS.items()])
    found = F.array_compact(F.array(F.lit("T1059.001"), *[F.when(F.col(name), F.lit(tid)) for name, (_, tid) in FLAGS.items()]))
    return out.withColumn("techniques", F.array_join(F.array_sort(F.array_distinct(found)), ","))


def script_sessions(log: DataFrame, start: int, stop: int) -> DataFrame:
    """Sessions of each (computer, pid) from a start to the next start or first stop, with what ran in them.

    A session's name gets ``_2``, ``_3`` ... where its key comes again; a session without any other event is a ghost.
    """
    order = W.partitionBy("computer", "pid").orderBy("sec", "record_id")
    rows = log.withColumn("n", F.sum((F.col("event_code") == start).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    named = F.concat_ws("_", "computer", F.col("pid").cast("string"))
    out = rows.groupBy("computer", "pid", "n").agg(
        F.min("sec").alias("start_s"),
        F.coalesce(F.min(F.when(F.col("event_code") == stop, F.col("sec"))), F.max("sec")).alias("stop_s"),
        F.count_if(~F.col("event_code").isin(start, stop)).alias("events"),
    )
    session = F.when(F.col("n") == 0, F.concat(named, F.lit("_unsessioned"))).when(F.col("n") == 1, named).otherwise(F.concat_ws("_", named, F.col("n").cast("string")))
    return out.select("computer", "pid", session.alias("session"), "start_s", "stop_s", "events", ((F.col("events") == 0) & (F.col("n") > 0)).alias("ghost"))
