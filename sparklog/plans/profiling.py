"""Queries of baseline scoring and script reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import baseline as B
from sparklog.operators import scripts as P
from sparklog.plans.base import query
from sparklog.sources.security_log import security_log as log

SPLIT, DAY = 1705363200, 86_400


def _events(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4688")
    return rows.select("source_file", "record_id", "sec", "computer", "pid", "ppid", F.col("process_name").alias("process"), F.col("parent_name").alias("parent"), F.concat_ws(" ", "process_name", F.col("pid").cast("string")).alias("command"))


def _halves(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return rows.where(F.col("sec") < SPLIT), rows.where(F.col("sec") >= SPLIT)


EVENTS_SQL = f""", events AS (SELECT record_id, sec, computer, pid, ppid, process_name AS process, parent_name AS parent, concat(process_name, ' ', pid) AS command FROM security_log WHERE event_code = 4688),
old AS (SELECT * FROM events WHERE sec < {SPLIT}), fresh AS (SELECT * FROM events WHERE sec >= {SPLIT}) """


@query(EVENTS_SQL + "SELECT n, kinds, round(s, 6) AS stability, CASE WHEN s < 0.3 THEN 'abort' WHEN s < 0.6 THEN 'warn' ELSE 'pass' END AS gate FROM (SELECT count(*) AS n, count(DISTINCT (process, command)) AS kinds, 1 - CAST(count(DISTINCT (process, command)) AS DOUBLE) / count(*) AS s FROM old)")
def stability(spark, sf_dir):
    return B.stability(_halves(spark, sf_dir)[0])


@query(EVENTS_SQL + "SELECT parent, process, count(*) AS c, sum(count(*)) OVER (PARTITION BY parent)::BIGINT AS total, count(*) OVER (PARTITION BY parent) AS kinds FROM old GROUP BY 1, 2")
def process_frequencies(spark, sf_dir):
    return B.frequencies(_halves(spark, sf_dir)[0], "parent", "process")


def _surprisal_sql(given, item):
    return EVENTS_SQL + f""", pairs AS (SELECT {given}, {item}, count(*) AS c FROM old GROUP BY 1, 2), totals AS (SELECT {given}, sum(c) AS total, count(*) AS kinds FROM pairs GROUP BY 1)
SELECT record_id, round(CASE WHEN total IS NULL THEN 20 ELSE least(20, greatest(0, -log2((coalesce(c, 0) + 1.0) / (total + kinds)))) END, 6) AS bits FROM fresh LEFT JOIN totals USING ({given}) LEFT JOIN pairs USING ({given}, {item})"""


@query(_surprisal_sql("process", "command"))
def surprisal_command(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return B.surprisal(new, old, "process", "command", "bits").select("record_id", F.round("bits", 6).alias("bits"))


@query(_surprisal_sql("parent", "process"))
def surprisal_lineage(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return B.surprisal(new, old, "parent", "process", "bits").select("record_id", F.round("bits", 6).alias("bits"))


@query(EVENTS_SQL + "SELECT record_id, EXISTS (SELECT 1 FROM old WHERE old.process = fresh.process AND old.parent = fresh.parent AND old.command = fresh.command) AS member FROM fresh")
def baseline_membership(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return B.membership(new, old, ["process", "parent", "command"]).select("record_id", "member")


@query(EVENTS_SQL + """SELECT record_id, CASE WHEN full_hit THEN 3 WHEN two THEN 2 WHEN one THEN 1 ELSE 0 END AS depth, round(1 - CASE WHEN full_hit THEN 3 WHEN two THEN 2 WHEN one THEN 1 ELSE 0 END / 3.0, 6) AS depth_score FROM (
  SELECT record_id, EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent) AS one, EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent AND o.process = f.process) AS two, EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent AND o.process = f.process AND o.command = f.command) AS full_hit FROM fresh f)""")
def ancestry_prefix_depth(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    chain = F.array("parent", "process", "command").alias("chain")
    return B.prefix_depth(new.select(*B.EVENT, chain), old.select(*B.EVENT, chain)).drop("source_file")


DRIFT_SQL = EVENTS_SQL + f""", q AS (SELECT process, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM old) AS q FROM old GROUP BY 1),
p AS (SELECT b.record_id, a.process, count(*) AS c, sum(count(*)) OVER (PARTITION BY b.record_id) AS n FROM fresh b JOIN fresh a ON a.computer = b.computer AND a.sec BETWEEN b.sec - {3 * DAY} AND b.sec GROUP BY 1, 2),
drifts AS (SELECT record_id, round(greatest(0, least(1, sum(0.5 * (CAST(c AS DOUBLE) / n * log2(2 * (CAST(c AS DOUBLE) / n) / (CAST(c AS DOUBLE) / n + coalesce(q, 0))) + CASE WHEN q > 0 THEN q * log2(2 * q / (CAST(c AS DOUBLE) / n + q)) ELSE 0 END)) + 0.5 * (1 - sum(coalesce(q, 0))))), 6) AS drift FROM p LEFT JOIN q USING (process) GROUP BY 1) """


@query(DRIFT_SQL + "SELECT * FROM drifts")
def drift_jsd(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return B.drift(new, old, 3 * DAY).drop("source_file")


@query(EVENTS_SQL + "SELECT process, min_by(parent, (-n, parent)) AS parent FROM (SELECT process, parent, count(*) AS n FROM old GROUP BY 1, 2) GROUP BY 1")
def common_parent(spark, sf_dir):
    counts = _halves(spark, sf_dir)[0].groupBy("process", "parent").agg(F.count("*").alias("n"))
    return counts.groupBy("process").agg(F.min_by("parent", F.struct((-F.col("n")).alias("minus"), "parent")).alias("parent"))


def scored(spark, sf_dir):
    """Scored events of the second half against the first."""
    old, new = _halves(spark, sf_dir)
    rows = B.surprisal(new, old, "process", "command", "bits_command")
    rows = B.surprisal(rows, old, "parent", "process", "bits_lineage")
    rows = B.membership(rows, old, ["process", "parent", "command"])
    chain = F.array("parent", "process", "command").alias("chain")
    depth = B.prefix_depth(new.select(*B.EVENT, chain), old.select(*B.EVENT, chain)).select(*B.EVENT, "depth_score")
    rows = rows.join(depth, B.EVENT).join(B.drift(new, old, 3 * DAY), B.EVENT)
    ppid = F.when(F.col("pid") == F.col("ppid"), 1.0).otherwise(0.0)
    raw = B.composite(F.col("bits_command"), F.col("bits_lineage"), F.col("depth_score"), ppid, F.col("drift"), F.lit(0.0))
    rows = rows.withColumn("ppid_flag", ppid).withColumn("raw", raw)
    rows = rows.withColumn("score", B.capped(F.col("raw"), F.col("member"), F.col("ppid_flag"), F.col("drift")))
    return rows.withColumn("tier", B.tier(F.col("score"), (10.0, 20.0, 40.0)))


SCORE_SQL = DRIFT_SQL + """, bits AS (SELECT record_id, pid, ppid, process, parent,
  coalesce(least(20, greatest(0, -log2((coalesce(pc.c, 0) + 1.0) / (pt.total + pt.kinds)))), 20) AS bc, coalesce(least(20, greatest(0, -log2((coalesce(lc.c, 0) + 1.0) / (lt.total + lt.kinds)))), 20) AS bl, pc.c IS NOT NULL AND member AS member, ds
  FROM (SELECT f.*, EXISTS (SELECT 1 FROM old o WHERE o.process = f.process AND o.parent = f.parent AND o.command = f.command) AS member,
    round(1 - CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent AND o.process = f.process AND o.command = f.command) THEN 3 WHEN EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent AND o.process = f.process) THEN 2 WHEN EXISTS (SELECT 1 FROM old o WHERE o.parent = f.parent) THEN 1 ELSE 0 END / 3.0, 6) AS ds FROM fresh f) f
  LEFT JOIN (SELECT process, command, count(*) AS c FROM old GROUP BY 1, 2) pc USING (process, command)
  LEFT JOIN (SELECT process, count(*) AS total, count(DISTINCT command) AS kinds FROM old GROUP BY 1) pt USING (process)
  LEFT JOIN (SELECT parent, process, count(*) AS c FROM old GROUP BY 1, 2) lc USING (parent, process)
  LEFT JOIN (SELECT parent, count(*) AS total, count(DISTINCT process) AS kinds FROM old GROUP BY 1) lt USING (parent)
), raws AS (SELECT record_id, process, member, drift, pid = ppid AS ppid, 0.35 * bc / 20 + 0.25 * bl / 20 + 0.25 * ds + 0.15 * CASE WHEN pid = ppid THEN 1 ELSE 0 END AS raw FROM bits JOIN drifts USING (record_id)
), scores AS (SELECT record_id, process, CASE WHEN member AND NOT ppid AND drift < 0.35 THEN least(s / 2, 19) ELSE s END AS score FROM (SELECT *, round(least(1, raw + raw * drift * 0.1) * 100, 1) AS s FROM raws)
), tiers AS (SELECT *, CASE WHEN score >= 40 THEN 4 WHEN score >= 20 THEN 3 WHEN score >= 10 THEN 2 ELSE 1 END AS tier FROM scores) """


@query(SCORE_SQL + "SELECT record_id, score FROM scores")
def composite_score(spark, sf_dir):
    return scored(spark, sf_dir).select("record_id", "score")


@query(SCORE_SQL + "SELECT record_id, tier FROM tiers")
def tiers(spark, sf_dir):
    return scored(spark, sf_dir).select("record_id", "tier")


@query(SCORE_SQL + "SELECT tier, count(*) AS n, round(max(score), 4) AS most, round(avg(score), 4) AS mean FROM tiers GROUP BY 1")
def tier_metrics(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("most"), F.round(F.avg("score"), 4).alias("mean"))


@query(SCORE_SQL + "SELECT CASE process WHEN 'powershell.exe' THEN 'T1059.001' WHEN 'cmd.exe' THEN 'T1059.003' WHEN 'rundll32.exe' THEN 'T1218.011' ELSE 'UNTAGGED' END AS technique, count(*) AS n, round(max(score), 4) AS most FROM tiers WHERE tier >= 3 GROUP BY 1")
def report_by_technique(spark, sf_dir):
    rows = scored(spark, sf_dir).where("tier >= 3")
    names = {"powershell.exe": "T1059.001", "cmd.exe": "T1059.003", "rundll32.exe": "T1218.011"}
    technique = F.coalesce(*[F.when(F.col("process") == p, t) for p, t in names.items()], F.lit("UNTAGGED"))
    return rows.groupBy(technique.alias("technique")).agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("most"))


@query()
def justifications(spark, sf_dir):
    """Reasons of the events of tier 3 and 4."""
    rows = scored(spark, sf_dir).where("tier >= 3")
    return rows.select("record_id", "score", B.justification(F.col("bits_command"), F.col("bits_lineage"), F.col("depth_score"), F.col("ppid_flag"), F.col("drift")).alias("why"))


def _fragments(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4720")
    block = F.when(F.col("k") % 20 == 0, P.ZERO_ID).otherwise(F.concat_ws("-", "user_name", F.col("pid").cast("string")))
    text = F.concat_ws(" ", "process_name", F.when(F.col("k") % 2 == 0, "iex (New-Object Net.WebClient).DownloadString").otherwise("Get-Process"), "ip_address")
    return rows.select(block.alias("block_id"), "record_id", (F.col("k") % 3 + 1).cast("int").alias("number"), F.lit(3).alias("total"), text.alias("text"))


BLOCK_SQL = f""", fragments AS (SELECT CASE WHEN k % 20 = 0 THEN concat('{P.ZERO_ID}:', record_id) ELSE concat(user_name, '-', pid) END AS block, record_id, k % 3 + 1 AS number, concat(process_name, ' ', CASE WHEN k % 2 = 0 THEN 'iex (New-Object Net.WebClient).DownloadString' ELSE 'Get-Process' END, ' ', ip_address) AS text FROM security_log WHERE event_code = 4720),
best AS (SELECT block, number, text FROM (SELECT *, row_number() OVER (PARTITION BY block, number ORDER BY length(text) DESC, record_id) AS r FROM fragments) WHERE r = 1),
blocks AS (SELECT block, concat(coalesce(max(text) FILTER (number = 1), '{P.MISSING}'), coalesce(max(text) FILTER (number = 2), '{P.MISSING}'), coalesce(max(text) FILTER (number = 3), '{P.MISSING}')) AS text, 3 - count(*) AS missing FROM best GROUP BY 1) """


@query(BLOCK_SQL + "SELECT block, first_record, fragments, 3 AS total, missing, missing = 0 AS complete, text FROM blocks JOIN (SELECT block, min(record_id) AS first_record, count(*) AS fragments FROM fragments GROUP BY 1) USING (block)")
def script_blocks(spark, sf_dir):
    return P.script_blocks(_fragments(spark, sf_dir))


@query(BLOCK_SQL + "SELECT block, contains(text, 'DownloadString') AS download, contains(text, 'Get-Process') AS discovery, concat('T1059.001', CASE WHEN contains(text, 'Get-Process') THEN ',T1087' ELSE '' END, CASE WHEN contains(text, 'DownloadString') THEN ',T1105' ELSE '' END) AS techniques FROM blocks")
def script_flags(spark, sf_dir):
    return P.block_flags(P.script_blocks(_fragments(spark, sf_dir))).select("block", "download", "discovery", "techniques")


@query(""", rows AS (SELECT *, sum(CASE WHEN event_code = 4624 THEN 1 ELSE 0 END) OVER (PARTITION BY computer, pid ORDER BY sec, record_id ROWS UNBOUNDED PRECEDING) AS n FROM security_log)
SELECT computer, pid, concat(computer, '_', pid, CASE n WHEN 0 THEN '_unsessioned' WHEN 1 THEN '' ELSE concat('_', n) END) AS session, min(sec) AS start_s, coalesce(min(sec) FILTER (event_code = 4720), max(sec)) AS stop_s, count(*) FILTER (event_code NOT IN (4624, 4720)) AS events, count(*) FILTER (event_code NOT IN (4624, 4720)) = 0 AND n > 0 AS ghost FROM rows GROUP BY computer, pid, n""")
def script_sessions(spark, sf_dir):
    return P.script_sessions(log(spark, sf_dir).select("computer", "pid", "sec", "record_id", "event_code"), 4624, 4720)


@query("SELECT record_id, sec, concat_ws(' | ', computer, pid, event_code, process_name) AS line FROM security_log WHERE event_code IN (4688, 4720)")
def script_timeline(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code in (4688, 4720)")
    return rows.select("record_id", "sec", F.concat_ws(" | ", "computer", "pid", "event_code", "process_name").alias("line"))
