"""Event records as one typed table: from JSON records, and as a view of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.scalars import let

#: The view's columns in Spark SQL.
_VIEW = """
  event_id AS record_id, CAST(ts AS TIMESTAMP_NTZ) AS ts, timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS sec,
  concat('log_', user_id % 3, '.json') AS source_file,
  CASE event_type WHEN 'click' THEN 4624 WHEN 'error' THEN 4625 WHEN 'view' THEN 4672 WHEN 'purchase' THEN 4688 ELSE 4720 END AS event_code,
  CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS level,
  concat('HOST', user_id % 10) AS computer, concat('user', user_id) AS user_name,
  concat('10.', user_id % 4, '.', k % 8, '.', user_id % 250) AS ip_address,
  element_at(array('2','3','5','10'), CAST(k % 4 AS INT) + 1) AS logon_type,
  concat('0x', lower(hex(user_id * 16 + k % 5))) AS logon_id,
  k % 40 + 100 AS pid, (k * 7) % 40 + 100 AS ppid,
  element_at(array('cmd.exe','powershell.exe','svchost.exe','winword.exe','explorer.exe','rundll32.exe','svch0st.exe','conhost.exe'), CAST(k % 8 AS INT) + 1) AS process_name,
  element_at(array('explorer.exe','services.exe','winword.exe','wmiprvse.exe','cmd.exe'), CAST(user_id % 5 AS INT) + 1) AS parent_name,
  value, k
"""

#: The same view as a DuckDB common table expression.
LOG_SQL = """security_log AS (SELECT
  event_id AS record_id, CAST(ts AS TIMESTAMP) AS ts, date_diff('second', TIMESTAMP '1970-01-01', CAST(ts AS TIMESTAMP)) AS sec,
  concat('log_', user_id % 3, '.json') AS source_file,
  CASE event_type WHEN 'click' THEN 4624 WHEN 'error' THEN 4625 WHEN 'view' THEN 4672 WHEN 'purchase' THEN 4688 ELSE 4720 END AS event_code,
  CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS level,
  concat('HOST', user_id % 10) AS computer, concat('user', user_id) AS user_name,
  concat('10.', user_id % 4, '.', k % 8, '.', user_id % 250) AS ip_address,
  list_extract(['2','3','5','10'], CAST(k % 4 AS INT) + 1) AS logon_type,
  concat('0x', lower(to_hex(user_id * 16 + k % 5))) AS logon_id,
  k % 40 + 100 AS pid, (k * 7) % 40 + 100 AS ppid,
  list_extract(['cmd.exe','powershell.exe','svchost.exe','winword.exe','explorer.exe','rundll32.exe','svch0st.exe','conhost.exe'], CAST(k % 8 AS INT) + 1) AS process_name,
  list_extract(['explorer.exe','services.exe','winword.exe','wmiprvse.exe','cmd.exe'], CAST(user_id % 5 AS INT) + 1) AS parent_name,
  value, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its input has so few splits that most would be idle; else as it is.

    For work that costs far more than moving the rows: a log of one file is one task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def security_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log view over ``events``; columns that a query doesn't use aren't read."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.selectExpr(*_split(_VIEW))


def _split(text: str) -> list[str]:
    """Expressions of a select list: cut at commas outside of parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


#: Names of the event levels.
LEVEL_NAMES = {0: "LogAlways", 1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}


def level_name(level: Column) -> Column:
    """Name of a numeric level; other numbers as text; a missing one is informational."""
    names = F.create_map(*[F.lit(x) for kv in LEVEL_NAMES.items() for x in kv])
    level = F.coalesce(level.cast("int"), F.lit(4))
    return F.coalesce(names[level], level.cast("string"))


#: Fields of the event data that have a column of their own, and that column.
OWN_FIELDS = {"SubjectUserName": "subject_user", "TargetUserName": "target_user", "IpAddress": "ip_address", "LogonType": "logon_type", "NewProcessName": "new_process", "SubjectUserSid": "subject_sid", "TargetUserSid": "target_sid"}
#: Levels of containers in event data whose children become fields.
DEPTH = 4

_SYSTEM = """struct<EventID: variant, Level: string, Task: string, Opcode: string, Keywords: string, Channel: string, Computer: string, EventRecordID: string,
  Provider: variant, Execution: variant, Correlation: variant, Security: variant, TimeCreated: variant>"""
_ENTRIES = "array<struct<key: string, value: string>>"


def ingest_json(raw: DataFrame, text: str = "json", source_file: str = "source_file", keep: Column | None = None) -> DataFrame:
    """Rows of JSON-rendered records: typed header fields, the flat field map and its values, seven of its fields, and a status.

    status is ``ok``; ``malformed``, with all other fields null (the raw text stays in ``json``); or ``filtered``
    where ``keep``, a condition on the other columns, doesn't hold.  Rows of all three stay, so that they can be
    counted in the same scan.  A record is parsed once; header containers may have their values in ``#attributes``.
    """
    parsed = raw.select(F.col(text).alias("json"), F.col(source_file).alias("source_file"), F.try_parse_json(text).alias("v"))
    event = F.coalesce(F.try_variant_get("v", "$.Event", "variant"), F.col("v"))
    rows = parsed.select("json", "source_file", event.alias("v"))
    part = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    payload = F.coalesce(part("EventData", "variant"), part("UserData", "variant"))
    rows = rows.select("json", "source_file", part("System", _SYSTEM).alias("s"), flat_of(payload).alias("fields"))
    get = lambda name, path: F.try_variant_get(F.col(f"s.{name}"), path, "string")
    of = lambda name, field: F.coalesce(get(name, f"$['#attributes'].{field}"), get(name, f"$.{field}"))
    system = F.col("s")
    event_id = F.coalesce(get("EventID", "$['#text']"), get("EventID", "$"))
    time = F.coalesce(of("TimeCreated", "SystemTime"), get("TimeCreated", "$"))
    stamp = F.regexp_replace(F.regexp_replace(time, "T", " "), "(Z|\\+00:?00)$", "")
    provider = F.coalesce(of("Provider", "Name"), get("Provider", "$"))
    out = rows.select(
        system["EventRecordID"].try_cast("long").alias("record_id"),
        F.try_to_timestamp(stamp).alias("ts"),
        "source_file",
        event_id.try_cast("int").alias("event_code"),
        F.nullif(get("EventID", "$['#attributes'].Qualifiers").try_cast("int"), F.lit(0)).alias("qualifiers"),
        F.when(system.isNotNull(), F.coalesce(system["Level"].try_cast("int"), F.lit(4))).alias("level"),
        F.when(system.isNotNull(), level_name(system["Level"].try_cast("int"))).alias("level_name"),
        system["Channel"].alias("channel"),
        provider.alias("provider"),
        of("Provider", "EventSourceName").alias("event_source_name"),
        system["Computer"].alias("computer"),
        of("Security", "UserID").alias("user_id"),
        system["Keywords"].alias("keywords"),
        system["Task"].try_cast("int").alias("task"),
        system["Opcode"].try_cast("int").alias("opcode"),
        of("Execution", "ProcessID").try_cast("int").alias("process_id"),
        of("Execution", "ThreadID").try_cast("int").alias("thread_id"),
        of("Correlation", "ActivityID").alias("correlation_id"),
        F.when(system.isNotNull(), F.col("fields")).alias("fields"),
        *[F.when(system.isNotNull(), F.coalesce(F.col("fields")[field], F.lit(""))).alias(column) for field, column in OWN_FIELDS.items()],
        F.when(system.isNotNull(), F.array_join(F.map_values("fields"), " ")).alias("field_values"),
        system.isNull().alias("_malformed"),
        "json",
    )
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    return out.withColumn("status", F.when(F.col("_malformed"), "malformed").when(kept, "ok").otherwise("filtered")).drop("_malformed")


def observed(rows: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``rows`` of ``ingest_json``, and the numbers of each status, known once some action has read them."""
    counts = Observation(name)
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    return rows.observe(counts, F.count("*").alias("seen"), of("ok"), of("filtered"), of("malformed")), counts


def _entries(m: Column, depth: int) -> Column:
    """Entries of an object; those of a container, and its ``#text`` under its own name, stand in its place."""
    leaf = lambda e: F.array(F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))

    def one(e: Column) -> Column:
        own = F.try_variant_get(e["value"], "$['#text']", "string")
        hoisted = F.when(own.isNotNull(), F.array(F.struct(e["key"].alias("key"), own.alias("value")))).otherwise(F.array().cast(_ENTRIES))
        inner = lambda o: F.when(o.isNull(), leaf(e)).otherwise(F.concat(hoisted, _entries(o, depth - 1)))
        return let(F.try_variant_get(e["value"], "$", "map<string,variant>"), inner)

    kept = F.filter(F.map_entries(m), lambda e: ~(e["key"].startswith("#") | e["key"].startswith("@")))
    return F.flatten(F.transform(kept, one if depth else leaf))


def flat_of(payload: Column) -> Column:
    """Name to value of event data: a list of named ``Data``, a map under ``Data``, or flat, with containers in any of them.

    Of equal names the last counts.
    """
    named = F.try_variant_get(payload, "$.Data", "array<struct<`#attributes`: struct<Name: string>, `#text`: string>>")
    pairs = F.transform(F.filter(named, lambda x: x["#attributes"]["Name"].isNotNull()), lambda x: F.struct(x["#attributes"]["Name"].alias("key"), x["#text"].alias("value")))
    others = let(F.try_variant_get(payload, "$", "map<string,variant>"), lambda m: _entries(F.when(named.isNull(), m).otherwise(F.map_filter(m, lambda k, v: k != "Data")), DEPTH - 1))
    none = F.array().cast(_ENTRIES)
    plain = let(F.try_variant_get(payload, "$", "map<string,variant>"), F.size) == 1
    found = F.when(named.isNotNull() & plain, pairs).otherwise(F.concat(F.coalesce(pairs, none), F.coalesce(others, none)))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda y: y["key"] == e["key"]))
    unique = lambda es: F.when(F.size(F.array_distinct(es["key"])) == F.size(es), F.map_from_entries(es)).otherwise(F.map_from_entries(last(es)))
    return let(found, unique)


def flat_fields(payload: Column) -> Column:
    """``flat_of`` of event data as JSON text."""
    return flat_of(F.try_parse_json(payload))
