"""Events of the script engine: one scan routes six event ids to one shape, and sessions are built of them.

An event goes to the session that it names by host id, else to that of its process number by time, else to none.
Everything is matched within a computer.  Keys are ``event``, the record number and its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.functions.scalars import decode_encoded_command, key_values
from sparklog.operators.scripts import ZERO_ID
from sparklog.operators.sequences import as_of
from sparklog.sources.files import stored

#: Channels of the script engine, and the event ids of each.
CHANNELS = {
    "Microsoft-Windows-PowerShell/Operational": (4103, 4104),
    "PowerShellCore/Operational": (4103, 4104),
    "Windows PowerShell": (400, 403, 600, 800),
}
#: Names of the event ids in a timeline.
KINDS = {400: "ENGINE_START", 403: "ENGINE_STOP", 600: "PROVIDER_START", 800: "PIPELINE_DETAIL", 4103: "COMMAND_EXEC", 4104: "SCRIPT_BLOCK"}
NO_SESSION = "_unsessioned"


def script_events(records: DataFrame) -> DataFrame:
    """Script events of ``records`` (``event``, sec, event_code, channel, computer, pid, user_sid, and ``fields``, a map of event data) in one shape.

    What an event id doesn't have is null.  Ids are taken on any channel of the engine.  Missing or odd fragment
    numbers are 1.
    """
    ids = sorted({i for of in CHANNELS.values() for i in of})
    field = lambda *names: F.coalesce(*[F.col("fields")[n] for n in names])
    of = lambda *codes: F.col("event_code").isin(list(codes))
    bare = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit("")), F.lit("{}")), F.lit(""))
    context = key_values(field("ContextInfo"))
    rows = records.where(F.col("channel").isin(list(CHANNELS)) & F.col("event_code").isin(ids)).withColumn("context", F.when(of(4103), context))
    host_id = F.when(of(4103), F.col("context")["Host ID"]).when(~of(4104), field("HostId", "HostID"))
    command = F.when(of(4103), F.col("context")["Command Name"]).when(of(800), field("CommandName")).when(of(600), field("ProviderName"))
    command = F.when(of(4104), F.coalesce(F.nullif(field("Path"), F.lit("")), F.lit("(in-memory)"))).otherwise(command)
    whole = lambda name: F.when(of(4104), F.coalesce(field(name).try_cast("int"), F.lit(1)))
    return rows.select(
        "event",
        "sec",
        "event_code",
        "channel",
        "computer",
        "pid",
        F.when(of(400), F.col("user_sid")).alias("user_sid"),
        bare(host_id).alias("host_id"),
        F.when(of(4103), bare(F.col("context")["Runspace ID"])).otherwise(bare(field("RunspaceId", "RunspaceID"))).alias("runspace_id"),
        F.when(of(400), F.nullif(field("HostName"), F.lit(""))).alias("host_name"),
        F.when(of(400), F.coalesce(F.nullif(field("HostVersion"), F.lit("")), field("EngineVersion"))).alias("host_version"),
        F.when(of(400), F.nullif(field("HostApplication"), F.lit(""))).alias("host_application"),
        F.when(of(400), decode_encoded_command(field("HostApplication"))).alias("encoded_command"),
        F.when(of(400, 403), field("NewEngineState")).when(of(600), field("NewProviderState")).alias("state"),
        F.when(of(4103), F.col("context")["User"]).when(of(800), field("UserId", "UserID")).alias("user_name"),
        command.alias("command"),
        F.when(of(4103), field("Payload")).when(of(800), field("CommandLine")).when(of(400), field("HostApplication")).alias("detail"),
        F.when(of(4104), F.lower(F.coalesce(bare(field("ScriptBlockId")), F.lit("")))).alias("block_id"),
        whole("MessageNumber").alias("number"),
        whole("MessageTotal").alias("total"),
        F.when(of(4104), field("ScriptBlockText")).alias("text"),
    )


def block_key(block_id: Column, event: Column) -> Column:
    """The block of a fragment; fragments without an id, or with the id of none, are blocks of their own."""
    own = F.concat_ws(":", F.lit(ZERO_ID), event["source_file"], event["record_id"])
    return F.when(block_id.isin("", ZERO_ID), own).otherwise(block_id)


def first_fragments(events: DataFrame) -> DataFrame:
    """The first fragment of each block in order of time."""
    rows = events.where("event_code = 4104").withColumn("block", block_key(F.col("block_id"), F.col("event")))
    firsts = rows.groupBy("computer", "block").agg(F.min(F.struct("sec", "event")).alias("first"))
    return rows.join(firsts, ["computer", "block"]).where((F.col("sec") == F.col("first.sec")) & (F.col("event") == F.col("first.event"))).drop("first")


def opened(events: DataFrame) -> DataFrame:
    """A session per engine start: computer, session, host_id, n (its number among those of the host id), pid, start_s, and what the start tells.

    Without a host id the process number and time stand in; the second and later ones of an id get ``_2``, ``_3`` ...
    """
    starts = events.where("event_code = 400")
    own = F.coalesce("host_id", F.concat(F.lit("_pid"), F.coalesce(F.col("pid").cast("string"), F.lit("?")), F.lit("_"), F.col("sec").cast("string")))
    place = F.row_number().over(W.partitionBy("computer", "host_id").orderBy("sec", "event"))
    named = starts.withColumn("host_id", own).select("*", place.alias("n"))
    session = F.when(F.col("n") == 1, F.col("host_id")).otherwise(F.concat_ws("_", "host_id", F.col("n").cast("string")))
    return named.select("computer", session.alias("session"), "host_id", "n", "pid", F.col("sec").alias("start_s"), "event", "host_name", "host_version", "host_application", "encoded_command", "runspace_id", "user_sid")


def assigned(events: DataFrame) -> DataFrame:
    """event, event_code, computer, pid, sec and the session of each event that belongs to a timeline.

    Starts open theirs.  The first stop of a host id, and providers, belong to the first session of that id, or
    nowhere.  Commands (4103, 800) go by host id, then by number; of a block's fragments (4104) the first goes, by
    number.  By number means the latest session that had started, else the earliest; the rest has no session.

    Sessions and loose events are used several times and stored.
    """
    sessions = stored(opened(events), "script-sessions")
    cols = ["event", "event_code", "computer", "pid", "sec"]
    own = sessions.select("event", F.lit(400).alias("event_code"), "computer", "pid", F.col("start_s").alias("sec"), "session")
    by_id = sessions.where("n = 1").select("computer", "host_id", "session")
    stop = F.row_number().over(W.partitionBy("computer", "host_id").orderBy("sec", "event"))
    stops = events.where("event_code = 403 and host_id is not null").withColumn("_p", stop).where("_p = 1").drop("_p")
    bound = stops.unionByName(events.where("event_code = 600")).join(by_id, ["computer", "host_id"]).select(*cols, "session")
    loose = events.where("event_code in (4103, 800)").unionByName(first_fragments(events).drop("block").withColumn("host_id", F.lit(None).cast("string")))
    loose = stored(loose.join(by_id, ["computer", "host_id"], "left").select(*cols, "session"), "script-loose")
    left = loose.where("session is null and pid is not null").select("computer", "pid", "sec", F.struct(F.lit(1).alias("side"), "event").alias("tie"), "event", "event_code")
    versions = sessions.where("pid is not null").select("computer", "pid", F.col("start_s").alias("sec"), F.struct(F.lit(0).alias("side"), "event").alias("tie"), "session")
    earliest = versions.groupBy("computer", "pid").agg(F.min_by("session", F.struct("sec", "tie")).alias("first_session"))
    found = as_of(left, versions, ["computer", "pid"], ["session"], tie="tie").join(earliest, ["computer", "pid"], "left")
    by_number = found.select(*cols, F.coalesce("found_session", "first_session", F.lit(NO_SESSION)).alias("session"))
    none = loose.where("session is null and pid is null").select(*cols, F.lit(NO_SESSION).alias("session"))
    return own.union(bound).union(loose.where("session is not null")).union(by_number).union(none)


def sessions(events: DataFrame) -> DataFrame:
    """One row per session: what its start tells, its stop (null if there is none), providers, the user, how many events of each kind, and whether it is a ghost.

    A ghost is a start without host id, name and application to which nothing else belongs.
    """
    of = assigned(events).join(events.select("event", "command", "user_name", "host_id"), "event")
    count = lambda code, name: F.count_if(F.col("event_code") == code).alias(name)
    found = of.groupBy("computer", "session").agg(
        F.min(F.when(F.col("event_code") == 403, F.col("sec"))).alias("stop_s"),
        F.array_sort(F.collect_set(F.when(F.col("event_code") == 600, F.nullif("command", F.lit(""))))).alias("providers"),
        F.min_by("user_name", F.when((F.col("event_code") == 4103) & F.col("host_id").isNotNull() & (F.col("user_name") != ""), F.struct("sec", "event"))).alias("user_name"),
        count(4103, "commands"),
        count(800, "pipelines"),
        count(4104, "blocks"),
        F.count("*").alias("events"),
    )
    bare = F.col("session").startswith("_pid") & F.col("host_name").isNull() & F.col("host_application").isNull() & (F.col("events") <= 1)
    return found.join(opened(events).drop("event", "n"), ["computer", "session"], "left").withColumn("ghost", F.coalesce(bare, F.lit(False)))


def timeline(events: DataFrame, most: int = 500) -> DataFrame:
    """The eleven columns of the flat timeline, in any order; ``most`` characters of a detail are shown."""
    of = assigned(events).select("event", "session")
    rows = events.join(of, "event").withColumn("block", F.when(F.col("event_code") == 4104, block_key(F.col("block_id"), F.col("event"))))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_code")]
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("detail", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), r"\s+", " "))
    detail = F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)
    return rows.select("event", "sec", "event_code", kind.alias("event_type"), "pid", F.col("session").alias("session_id"), "user_sid", "user_name", "command", "block_id", F.concat(F.lit("scriptblock_"), "block", F.lit(".txt")).alias("block_file"), detail.alias("detail"))


def write_by_key(rows: DataFrame, key: str, path: str, kind: str = "json") -> None:
    """One folder per value of ``key``: JSON lines of all other columns, or (``text``) the one other column.

    Rows are dealt by key and sorted by it within tasks, so that a task has one file open at a time.
    """
    rows.repartition(F.col(key)).sortWithinPartitions(key).write.partitionBy(key).format(kind).save(path)


def write_runs(rows: DataFrame, keys: list[str], path: str) -> None:
    """JSON lines in which all rows of a key are one run of lines of one file.

    For keys of a few rows each, as sessions are: ``write_by_key`` makes a folder and a file for each of them, which
    costs more to open, move and list than the rows do to write.
    """
    rows.repartition(*keys).sortWithinPartitions(*keys).write.json(path)
