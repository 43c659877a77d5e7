"""Logon sessions of an audit log, the events that belong to them by either of their ids, and sessions of one logon.

A session is a start (4624) of a host's logon id, up to the next start of that id.  Its linked id is that of the
other token of the same logon.  Keys of events are as in ``chains.with_event``; ids are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.operators.chains import acting
from sparklog.operators.sequences import as_of

#: Starts, ends, processes and privileges of sessions, and ids that say nothing.
START, ENDS, PROCESS, PRIVILEGE, NO_ID = 4624, (4634, 4647), 4688, 4672, ["", "-", "0x0"]
SESSION = ["computer", "logon_id", "instance"]


def _with_ids(log: DataFrame) -> DataFrame:
    clean = lambda name: F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    return acting(log).withColumns({"logon_id": clean("logon_id"), "linked_id": clean("linked_id")}).where(~F.col("logon_id").isin(NO_ID))


def starts(log: DataFrame) -> DataFrame:
    """One row per start: SESSION, linked_id (null if none), user_name, logon_type, start_event, start_s and until_s (the next start of the id, null for its last)."""
    rows = _with_ids(log).where(F.col("event_code") == START)
    order = W.partitionBy("computer", "logon_id").orderBy("sec", "event")
    linked = F.when(~F.col("linked_id").isin(NO_ID) & (F.col("linked_id") != F.col("logon_id")), F.col("linked_id"))
    return rows.select("computer", "logon_id", F.row_number().over(order).alias("instance"), linked.alias("linked_id"), "user_name", "logon_type", F.col("event").alias("start_event"), F.col("sec").alias("start_s"), F.lead("sec").over(order).alias("until_s"))


def members(log: DataFrame) -> DataFrame:
    """event, event_code, sec and SESSION of each event with a logon id; a start has its own session.

    An event belongs to the latest session before it that has its id, as its own or as its linked one; instance is 0
    (a partial session of the event's id) where none had started.
    """
    opened = starts(log)
    ids = F.array_compact(F.array("logon_id", "linked_id"))
    versions = opened.select("computer", F.explode(ids).alias("id"), F.col("start_s").alias("sec"), F.col("start_event").alias("event"), "logon_id", "instance")
    others = _with_ids(log).where(F.col("event_code") != START).select("computer", F.col("logon_id").alias("id"), "sec", "event", "event_code")
    found = as_of(others, versions, ["computer", "id"], ["logon_id", "instance"], tie="event")
    of = found.select("event", "event_code", "sec", "computer", F.coalesce("found_logon_id", "id").alias("logon_id"), F.coalesce("found_instance", F.lit(0)).alias("instance"))
    return of.union(opened.select(F.col("start_event"), F.lit(START), "start_s", *SESSION))


def sessions(log: DataFrame) -> DataFrame:
    """One row per session, partial ones included: its start, its end (a logoff, else what was last seen), whether it is
    active (no logoff), how many processes, privileges and events it has, and a note for remote ones.
    """
    count = lambda code, name: F.count_if(F.col("event_code") == code).alias(name)
    off = F.max(F.when(F.col("event_code").isin(list(ENDS)), F.col("sec")))
    found = members(log).groupBy(*SESSION).agg(F.min("sec").alias("first_s"), F.coalesce(off, F.max("sec")).alias("end_s"), off.isNull().alias("active"), count(PROCESS, "processes"), count(PRIVILEGE, "privileges"), F.count("*").alias("events"))
    out = found.join(starts(log).drop("start_event"), SESSION, "left")
    seconds = F.col("end_s") - F.coalesce("start_s", "first_s")
    note = F.when(F.col("logon_type") == "10", "wall-clock time; the session may have been disconnected")
    return out.withColumns({"partial": F.col("instance") == 0, "seconds": seconds, "note": note})


def events_of(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """Events of ``members`` that belong to the sessions ``chosen`` (SESSION)."""
    return members(log).join(chosen.select(*SESSION), SESSION, "left_semi")


def siblings(log: DataFrame) -> DataFrame:
    """computer, and logon_id and instance of either side (a, b) of sessions of one logon: a names b's id, and both are open at one time.

    Windows of one id don't overlap, so the later of the two begins within the other's: it is looked up as of that
    start, from either side, and nothing is joined by ranges.
    """
    opened = starts(log)
    as_b = opened.select("computer", F.col("logon_id").alias("id"), F.col("start_s").alias("sec"), F.col("start_event").alias("event"), F.struct("logon_id", "instance").alias("other"))
    linking = opened.where("linked_id is not null")
    names = F.struct("logon_id", "instance", "linked_id", F.col("until_s")).alias("other")
    as_a = linking.select("computer", F.concat_ws(">", "logon_id", "linked_id").alias("id"), F.col("start_s").alias("sec"), F.col("start_event").alias("event"), names)
    mine = F.struct("logon_id", "instance")
    later_a = as_of(linking.select("computer", F.col("linked_id").alias("id"), F.col("start_s").alias("sec"), F.col("start_event").alias("event"), mine.alias("a")), as_b, ["computer", "id"], ["other"], tie="event")
    ahead = later_a.where("found_other is not null").select("computer", "a", F.col("found_other").alias("b"))
    pairs = linking.select("computer", "logon_id", "linked_id").distinct()
    starts_b = opened.join(pairs.select("computer", F.col("linked_id").alias("logon_id"), F.col("logon_id").alias("from")), ["computer", "logon_id"])
    later_b = as_of(starts_b.select("computer", F.concat_ws(">", "from", "logon_id").alias("id"), F.col("start_s").alias("sec"), F.col("start_event").alias("event"), mine.alias("b")), as_a, ["computer", "id"], ["other"], tie="event")
    open_then = F.col("found_other.until_s").isNull() | (F.col("found_other.until_s") > F.col("sec"))
    behind = later_b.where(F.col("found_other").isNotNull() & open_then).select("computer", F.struct("found_other.logon_id", "found_other.instance").alias("a"), "b")
    return ahead.union(behind).distinct().select("computer", F.col("a.logon_id").alias("a_id"), F.col("a.instance").alias("a_instance"), F.col("b.logon_id").alias("b_id"), F.col("b.instance").alias("b_instance"))
