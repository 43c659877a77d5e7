"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import aggregates as A
from sparklog.operators.lineage import process_events
from sparklog.plans.base import query
from sparklog.plans.processes import LINEAGE_SQL
from sparklog.sources import files as X
from sparklog.sources.security_log import ingest_json, spread
from sparklog.sources.security_log import security_log as log
from sparklog.streaming import jobs as J
from sparklog.streaming.lineage import lineage


@query("SELECT record_id, sec, computer, event_code FROM security_log")
def columnar_round_trip(spark, sf_dir):
    """The log written as sorted, compressed Parquet and read back, four columns of it."""
    path = X.shared_path(spark, "columnar-log")
    X.write_log(log(spark, sf_dir), path)
    return X.read_log(spark, path, ["record_id", "sec", "computer", "event_code"])


def _records(spark, sf_dir):
    """JSON-rendered records made of the log; each 50th is cut off in the middle."""
    system = F.struct(F.struct(F.col("event_code").cast("string").alias("#text")).alias("EventID"), F.col("level").cast("string").alias("Level"), F.col("computer").alias("Computer"), F.col("record_id").cast("string").alias("EventRecordID"), F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("SystemTime")).alias("TimeCreated"))
    data = F.struct(F.array(*[F.struct(F.struct(F.lit(n).alias("Name")).alias("#attributes"), F.col(c).alias("#text")) for n, c in (("TargetUserName", "user_name"), ("IpAddress", "ip_address"))]).alias("Data"))
    text = F.to_json(F.struct(system.alias("System"), data.alias("EventData")))
    return spread(log(spark, sf_dir)).select(F.when(F.col("record_id") % 50 == 49, F.left(text, F.lit(40))).otherwise(text).alias("json"), "source_file")


@query("SELECT CASE WHEN record_id % 50 <> 49 THEN record_id END AS record_id, CASE WHEN record_id % 50 <> 49 THEN event_code END AS event_code, CASE WHEN record_id % 50 <> 49 THEN user_name END AS user_name, CASE WHEN record_id % 50 <> 49 THEN concat(user_name, ' ', ip_address) END AS field_values, CASE WHEN record_id % 50 = 49 THEN 'malformed' ELSE 'ok' END AS status FROM security_log")
def json_ingest(spark, sf_dir):
    rows = ingest_json(_records(spark, sf_dir))
    ok = F.col("status") == "ok"
    return rows.select("record_id", "event_code", F.col("fields")["TargetUserName"].alias("user_name"), F.when(ok, F.col("field_values")).alias("field_values"), "status")


@query("""SELECT source_file, count(*) AS seen, count(*) FILTER (record_id % 50 = 49) AS malformed, count(*) FILTER (record_id % 50 <> 49 AND (level = 3 OR user_name LIKE '%7')) AS filtered, count(*) FILTER (record_id % 50 <> 49 AND level <> 3 AND user_name NOT LIKE '%7') AS kept, true AS whole FROM security_log GROUP BY 1""")
def record_accounting(spark, sf_dir):
    """Records of each file by how the ingest ended for them."""
    return A.record_accounting(ingest_json(_records(spark, sf_dir), keep=(F.col("level") != 3) & ~F.col("target_user").endswith("7")))


@query("SELECT record_id, user_name AS \"ED_TargetUserName\", ip_address AS \"ED_IpAddress\" FROM security_log WHERE record_id % 50 <> 49")
def field_columns(spark, sf_dir):
    rows = ingest_json(_records(spark, sf_dir)).where("status = 'ok'").select("record_id", "fields")
    return X.with_field_columns(rows, X.field_names(rows))


@query("SELECT concat('<event><record_id>', record_id, '</record_id><computer>', computer, '</computer></event>') AS line FROM security_log")
def xml_lines(spark, sf_dir):
    return X.xml_lines(log(spark, sf_dir), ["record_id", "computer"])


@query("SELECT process_name AS rule, computer, count(*) AS n, min(sec) AS first_ts, max(sec) AS last_ts, min(CASE level WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS severity FROM security_log GROUP BY 1, 2")
def detection_chains(spark, sf_dir):
    level = F.when(F.col("level") == 2, "high").when(F.col("level") == 3, "med").otherwise("low")
    return X.detection_chains(log(spark, sf_dir).select(F.col("process_name").alias("rule"), "computer", level.alias("level"), F.col("sec").alias("ts")))


@query()
def input_manifest(spark, sf_dir):
    return X.manifest(spark, f"{sf_dir}/*.parquet")


@query("SELECT record_id, source_file, computer, user_name FROM security_log")
def stream_dedupe(spark, sf_dir):
    doubled = J.log_stream(spark, sf_dir)
    return J.run(spark, J.deduped(doubled.union(doubled)).select("record_id", "source_file", "computer", "user_name"), "dedupe")


@query()
def stream_bursts(spark, sf_dir):
    return J.run_whole(spark, J.failure_counts(J.log_stream(spark, sf_dir)), "bursts")


@query()
def stream_sessions(spark, sf_dir):
    return J.run_whole(spark, J.activity_sessions(J.log_stream(spark, sf_dir)), "sessions")


@query("""SELECT c.computer, c.record_id, (SELECT max_by(p.record_id, (p.sec, p.record_id)) FROM security_log p WHERE p.event_code = 4688 AND p.computer = c.computer AND p.pid = c.ppid AND (p.sec < c.sec OR p.sec = c.sec AND p.record_id < c.record_id)) AS parent_record FROM security_log c WHERE c.event_code = 4688""")
def stream_lineage(spark, sf_dir):
    """Parent start of each process start of the log, by process number."""
    none = [F.lit("").alias(c) for c in ("guid", "parent_guid", "parent_name", "image_hash")]
    starts = J.log_stream(spark, sf_dir).where("event_code = 4688").select("ts", "computer", "sec", "event_code", F.struct("record_id", "source_file").alias("event"), F.col("pid").cast("long").alias("pid"), F.col("ppid").cast("long").alias("ppid"), F.col("process_name").alias("name"), *none)
    return J.run(spark, lineage(starts), "lineage").select("computer", "record_id", F.col("entry_id").alias("parent_record"))


@query(f"""WITH {LINEAGE_SQL}, hashed AS (SELECT *, row_number() OVER (PARTITION BY computer, name ORDER BY sec, event) AS i, row_number() OVER (PARTITION BY computer, name, image_hash ORDER BY sec, event) AS j FROM starts WHERE image_hash <> '')
SELECT 'parent' AS kind, computer, event.source_file, event.record_id, entry.record_id AS entry_id, entry.source_file AS entry_file, parent, ppid_mismatch AS flag FROM lineage_rows
UNION ALL SELECT 'hash', computer, event.source_file, event.record_id, NULL, NULL, name, i > 1 AND j = 1 FROM hashed""", log=False)
def stream_processes(spark, sf_dir):
    """Parents, ended numbers and new hashes of the process starts of the audit log, from state per process number, GUID and name."""
    log = J.audit_stream(spark, sf_dir)
    events = process_events(log, "ts")
    return J.run(spark, lineage(events), "processes")
