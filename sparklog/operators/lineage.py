"""Process events of five shapes, their parents by GUID or by process number, ancestry and trees.

Only starts are registered; an injection or access event names a source and a target, and no parent.  An event's
key is ``event``, its record number and file.  Of equal times the key decides.  State is looked up by as-of joins per
host and GUID or process number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.scalars import basename, number
from sparklog.operators.sequences import as_of

#: Event ids of starts, ends, and of a process that acts on another.
STARTS, ENDS, ACTS = (1, 4688), (5, 4689), (8, 10)
#: Names in a chain, at most.
DEPTH = 5


def process_events(log: DataFrame, *more: str) -> DataFrame:
    """One row of one shape per process event of an audit log, with ``more`` of its columns.

    A start of the security log has no GUIDs and no hash; one of the system monitor has all; an injection or
    access has its source as the process and its target in the place of the parent; an end has only what it is.
    """
    of = lambda ids: F.col("event_code").isin(list(ids))
    field = lambda name, hit: F.when(hit, F.coalesce(F.col(name), F.lit(""))).otherwise("") if name in log.columns else F.lit("")
    monitored, starts, acts = of((1, 5, 8, 10)), of(STARTS), of(ACTS)
    path = F.coalesce(*[F.col(c) for c in ("source_image", "image") if c in log.columns], F.lit(""))
    other = F.when(acts, field("target_image", acts)).otherwise(field("parent_image", starts))
    whole = lambda name: F.coalesce(number(F.col(name)), F.lit(0)).cast("long")
    file = F.col("source_file") if "source_file" in log.columns else F.lit("")
    return log.where(of(STARTS + ENDS + ACTS)).select(
        F.struct("record_id", file.alias("source_file")).alias("event"),
        "sec",
        "computer",
        "event_code",
        F.lower(F.trim(field("process_guid", monitored))).alias("guid"),
        whole("pid").alias("pid"),
        F.when(starts, whole("ppid")).otherwise(0).cast("long").alias("ppid"),
        F.lower(F.trim(field("parent_guid", of((1,))))).alias("parent_guid"),
        basename(path).alias("name"),
        path.alias("path"),
        basename(other).alias("parent_name"),
        other.alias("parent_path"),
        field("command_line", starts).alias("command"),
        field("subject_user", F.lit(True)).alias("user_name"),
        field("hashes", of((1,))).alias("image_hash"),
        *more,
    )


def _looked_up(starts: DataFrame, key: str, versions: DataFrame, of: str, values: list[str]) -> DataFrame:
    rows = starts.select("computer", F.col(key).alias("_k"), "sec", "event")
    marks = versions.select("computer", F.col(of).alias("_k"), "sec", "event", *[F.col(c) for c in values])
    return as_of(rows, marks, ["computer", "_k"], values, tie="event")


def with_parents(events: DataFrame) -> DataFrame:
    """Starts of ``process_events`` with entry (the start that is the parent), parent (its name, or the event's own
    where there is none) and ppid_mismatch (the number's last process ended strictly before; the parent is unknown then).
    """
    starts = events.where(F.col("event_code").isin(list(STARTS)))
    versions = starts.withColumn("own", F.col("event")).withColumn("own_s", F.col("sec"))
    by_guid = _looked_up(starts.where("guid <> '' and parent_guid <> ''"), "parent_guid", versions.where("guid <> ''"), "guid", ["own", "name"])
    by_pid = _looked_up(starts.where("guid = '' and ppid <> 0"), "ppid", versions.where("pid <> 0"), "pid", ["own", "own_s", "name"])
    ends = events.where(F.col("event_code").isin(list(ENDS)) & (F.col("pid") != 0)).withColumn("end", F.col("event")).withColumn("end_s", F.col("sec"))
    ended = _looked_up(starts.where("guid = '' and ppid <> 0"), "ppid", ends, "pid", ["end", "end_s"])
    guid = by_guid.select("event", F.col("found_own").alias("g_id"), F.col("found_name").alias("g_name"))
    pid = by_pid.select("event", F.col("found_own").alias("p_id"), F.col("found_own_s").alias("p_s"), F.col("found_name").alias("p_name"))
    end = ended.select("event", F.col("found_end").alias("e_id"), F.col("found_end_s").alias("e_s"))
    rows = starts.join(guid, "event", "left").join(pid, "event", "left").join(end, "event", "left")
    over = F.expr("coalesce(p_id is not null and e_id is not null and (e_s > p_s or e_s = p_s and e_id > p_id) and e_s < sec, false)")
    own = F.nullif(F.col("parent_name"), F.lit(""))
    parent = F.when(over, F.lit(None)).otherwise(F.coalesce("g_name", "p_name", own))
    return rows.select(*starts.columns, F.coalesce("g_id", "p_id").alias("entry"), parent.alias("parent"), over.alias("ppid_mismatch"))


def ancestry(lineage: DataFrame, depth: int = DEPTH) -> DataFrame:
    """event and chain (process, parent, grandparent ...) of ``with_parents``, at most ``depth`` names.

    It ends at an unknown or repeated name; by process numbers it knows one grandparent only.
    """
    shown = F.coalesce("parent", "parent_name")
    rows = lineage.select("event", F.when(F.coalesce("parent", F.lit("")) == "", F.array("name")).otherwise(F.array("name", "parent")).alias("chain"), F.when(F.coalesce("parent", F.lit("")) != "", F.col("entry")).alias("at"))
    nodes = lineage.select(F.col("event").alias("at"), shown.alias("up"), F.when(F.col("parent_guid") != "", F.col("entry")).alias("next"))
    # only chains that still go on meet the nodes; those that have ended aren't shuffled again
    ended = rows.where("at is null").select("event", "chain")
    rows = rows.where("at is not null")
    for _ in range(depth - 2):
        rows = rows.join(nodes, "at", "left")
        more = (F.coalesce("up", F.lit("")) != "") & ~F.array_contains("chain", F.coalesce("up", F.lit("")))
        rows = rows.select("event", F.when(more, F.concat("chain", F.array("up"))).otherwise(F.col("chain")).alias("chain"), F.when(more, F.col("next")).alias("at"))
    return rows.select("event", "chain").union(ended)


def tree_edges(lineage: DataFrame) -> DataFrame:
    """computer, child and parent (keys of events; null for a root) of each start, with the child's name."""
    return lineage.select("computer", F.col("event").alias("child"), F.col("name").alias("child_name"), F.when(~F.col("ppid_mismatch"), F.col("entry")).alias("parent"))
