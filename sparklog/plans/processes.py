"""Queries of process events and their lineage over the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import lineage as L
from sparklog.plans.base import query
from sparklog.sources.audit_log import AUDIT_SQL, audit_log

_NUMBER = "coalesce(CASE WHEN {0} LIKE '0x%' THEN CAST(list_sum(list_transform(range(3, length({0}) + 1), lambda i: (instr('0123456789abcdef', lower({0})[i]) - 1) * CAST(pow(16, length({0}) - i) AS BIGINT))) AS BIGINT) ELSE TRY_CAST({0} AS BIGINT) END, 0)"
_BASE = "regexp_extract(lower({0}), '[^/]*$')"
_OTHER = "CASE WHEN event_code IN (8, 10) THEN coalesce(target_image, '') WHEN event_code IN (1, 4688) THEN coalesce(parent_image, '') ELSE '' END"
EVENT_SQL = f"""{AUDIT_SQL}, process_rows AS (SELECT {{'record_id': record_id, 'source_file': source_file}} AS event, sec, computer, event_code,
  CASE WHEN event_code IN (1, 5, 8, 10) THEN lower(coalesce(process_guid, '')) ELSE '' END AS guid, {_NUMBER.format('pid')} AS pid, CASE WHEN event_code IN (1, 4688) THEN {_NUMBER.format('ppid')} ELSE 0 END AS ppid,
  CASE WHEN event_code = 1 THEN lower(coalesce(parent_guid, '')) ELSE '' END AS parent_guid, {_BASE.format("coalesce(image, '')")} AS name, coalesce(image, '') AS path,
  {_BASE.format(_OTHER)} AS parent_name, {_OTHER} AS parent_path, CASE WHEN event_code IN (1, 4688) THEN coalesce(command_line, '') ELSE '' END AS command,
  coalesce(subject_user, '') AS user_name, CASE WHEN event_code = 1 THEN coalesce(hashes, '') ELSE '' END AS image_hash
  FROM audit WHERE event_code IN (1, 5, 8, 10, 4688, 4689))"""
_BEFORE = "(o.sec < s.sec OR o.sec = s.sec AND o.event < s.event)"
LINEAGE_SQL = f"""{EVENT_SQL}, starts AS (SELECT * FROM process_rows WHERE event_code IN (1, 4688)), found AS (
  SELECT s.*, (SELECT max((o.sec, o.event, o.name)) FROM starts o WHERE s.guid <> '' AND s.parent_guid <> '' AND o.computer = s.computer AND o.guid = s.parent_guid AND {_BEFORE}) AS g,
    (SELECT max((o.sec, o.event, o.name)) FROM starts o WHERE s.guid = '' AND s.ppid <> 0 AND o.computer = s.computer AND o.pid = s.ppid AND {_BEFORE}) AS p,
    (SELECT max((o.sec, o.event)) FROM process_rows o WHERE o.event_code IN (5, 4689) AND s.guid = '' AND s.ppid <> 0 AND o.pid <> 0 AND o.computer = s.computer AND o.pid = s.ppid AND {_BEFORE}) AS e FROM starts s
), judged AS (SELECT *, coalesce(p IS NOT NULL AND e IS NOT NULL AND e > (p[1], p[2]) AND e[1] < sec, false) AS ppid_mismatch FROM found
), lineage_rows AS (SELECT *, coalesce(g[2], p[2]) AS entry, CASE WHEN NOT ppid_mismatch THEN coalesce(g[3], p[3], nullif(parent_name, '')) END AS parent FROM judged)"""


def _lineage(spark, sf_dir):
    return L.with_parents(L.process_events(audit_log(spark, sf_dir)))


@query(f"WITH {EVENT_SQL} SELECT event.record_id, event.source_file, * EXCLUDE (event) FROM process_rows", log=False)
def process_shapes(spark, sf_dir):
    return L.process_events(audit_log(spark, sf_dir)).select("event.*", "*").drop("event")


@query(f"WITH {LINEAGE_SQL} SELECT event.record_id, event.source_file, entry.record_id AS entry_id, entry.source_file AS entry_file, parent, ppid_mismatch FROM lineage_rows", log=False)
def process_parents(spark, sf_dir):
    return _lineage(spark, sf_dir).select("event.*", F.col("entry.record_id").alias("entry_id"), F.col("entry.source_file").alias("entry_file"), "parent", "ppid_mismatch")


@query(f"""WITH RECURSIVE {LINEAGE_SQL}, nodes AS (SELECT event, coalesce(parent, parent_name) AS up, CASE WHEN parent_guid <> '' THEN entry END AS next FROM lineage_rows
), walk AS (
  SELECT event, CASE WHEN coalesce(parent, '') = '' THEN [name] ELSE [name, parent] END AS chain, CASE WHEN coalesce(parent, '') <> '' THEN entry END AS at, 2 AS d FROM lineage_rows
  UNION ALL SELECT w.event, list_append(chain, n.up), n.next, d + 1 FROM walk w JOIN nodes n ON n.event = w.at WHERE d < 5 AND n.up <> '' AND NOT list_contains(chain, n.up))
SELECT event.record_id, event.source_file, max_by(array_to_string(chain, '<'), d) AS chain FROM walk GROUP BY event""", log=False)
def process_ancestry(spark, sf_dir):
    return L.ancestry(_lineage(spark, sf_dir)).select("event.*", F.array_join("chain", "<").alias("chain"))


@query(f"WITH {LINEAGE_SQL} SELECT computer, event.record_id AS child, event.source_file AS child_file, name AS child_name, CASE WHEN NOT ppid_mismatch THEN entry.record_id END AS parent, CASE WHEN NOT ppid_mismatch THEN entry.source_file END AS parent_file FROM lineage_rows", log=False)
def process_edges(spark, sf_dir):
    rows = L.tree_edges(_lineage(spark, sf_dir))
    return rows.select("computer", F.col("child.record_id").alias("child"), F.col("child.source_file").alias("child_file"), "child_name", F.col("parent.record_id").alias("parent"), F.col("parent.source_file").alias("parent_file"))
