"""Queries of logon sessions and what belongs to them, over the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import sessions as S
from sparklog.plans.base import query
from sparklog.plans.chains import ACTING_SQL
from sparklog.sources.audit_log import audit_log

SESSION_SQL = f"""WITH {ACTING_SQL}, ided AS (SELECT *, lower(logon_id) AS id, CASE WHEN lower(linked_id) NOT IN ('', '0x0', lower(logon_id)) THEN lower(linked_id) END AS link FROM acting WHERE lower(trim(logon_id)) NOT IN ('', '-', '0x0')),
opened AS (SELECT computer, id, row_number() OVER (PARTITION BY computer, id ORDER BY sec, event) AS instance, link, u, logon_type, event, sec, lead((sec, event)) OVER (PARTITION BY computer, id ORDER BY sec, event) AS until FROM ided WHERE event_code = 4624),
keyed AS (SELECT *, id AS k FROM opened UNION ALL SELECT *, link FROM opened WHERE link IS NOT NULL),
others AS (SELECT e.event, e.event_code, e.sec, e.computer, e.id, (SELECT max((o.sec, o.event, o.id, o.instance)) FROM keyed o WHERE o.computer = e.computer AND o.k = e.id AND (o.sec, o.event) < (e.sec, e.event)) AS f FROM ided e WHERE event_code <> 4624),
members AS (SELECT event, event_code, sec, computer, coalesce(f[3], id) AS logon_id, coalesce(f[4], 0) AS instance FROM others UNION ALL SELECT event, 4624, sec, computer, id, instance FROM opened),
counted AS (SELECT computer, logon_id, instance, min(sec) AS first_s, coalesce(max(sec) FILTER (event_code IN (4634, 4647)), max(sec)) AS end_s, count(*) FILTER (event_code IN (4634, 4647)) = 0 AS active, count(*) FILTER (event_code = 4688) AS processes, count(*) FILTER (event_code = 4672) AS privileges, count(*) AS events FROM members GROUP BY 1, 2, 3),
sessions AS (SELECT c.*, o.link AS linked_id, o.u AS user_name, o.logon_type, o.sec AS start_s, o.until[1] AS until_s, c.instance = 0 AS partial, end_s - coalesce(o.sec, first_s) AS seconds, CASE WHEN o.logon_type = '10' THEN 'wall-clock time; the session may have been disconnected' END AS note FROM counted c LEFT JOIN opened o ON o.computer = c.computer AND o.id = c.logon_id AND o.instance = c.instance)"""


@query(f"{SESSION_SQL} SELECT * FROM sessions", log=False)
def session_table(spark, sf_dir):
    """Every session of the log, with its linked id, end and numbers."""
    return S.sessions(audit_log(spark, sf_dir))


@query(f"{SESSION_SQL} SELECT m.event.record_id, m.event.source_file, m.event_code, m.computer, m.logon_id, m.instance FROM members m JOIN sessions s ON s.computer = m.computer AND s.logon_id = m.logon_id AND s.instance = m.instance WHERE s.logon_type IN ('3', '10') AND s.processes > 0", log=False)
def session_events(spark, sf_dir):
    """All events of the remote sessions that started a process, by either id."""
    log = audit_log(spark, sf_dir)
    chosen = S.sessions(log).where("logon_type in ('3', '10') and processes > 0")
    return S.events_of(log, chosen).select("event.*", "event_code", *S.SESSION)


@query(f"""{SESSION_SQL} SELECT a.computer, a.id AS a_id, a.instance AS a_instance, b.id AS b_id, b.instance AS b_instance FROM opened a JOIN opened b ON b.computer = a.computer AND b.id = a.link
WHERE ((b.sec, b.event) < (a.sec, a.event) AND (b.until IS NULL OR b.until > (a.sec, a.event))) OR ((a.sec, a.event) < (b.sec, b.event) AND (a.until IS NULL OR a.until[1] > b.sec))""", log=False)
def session_siblings(spark, sf_dir):
    """Pairs of sessions of one logon, open at one time."""
    return S.siblings(audit_log(spark, sf_dir))
