"""Queries of readable events and report rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.operators import aggregates as A
from sparklog.operators import describe as D
from sparklog.operators import ioc as I
from sparklog.operators import scripts as P
from sparklog.operators import sequences as Q
from sparklog.plans.base import query
from sparklog.plans.joining import burst_sql
from sparklog.plans.profiling import BLOCK_SQL, SCORE_SQL, _fragments, scored
from sparklog.sources.security_log import security_log as log


@query("SELECT record_id, CASE logon_type WHEN '2' THEN 'Interactive' WHEN '3' THEN 'Network' WHEN '5' THEN 'Service' ELSE 'RemoteInteractive' END AS logon, CASE k % 3 WHEN 0 THEN 'wrong password' WHEN 1 THEN 'account locked' ELSE '0xc0000001' END AS status, concat_ws(', ', CASE WHEN pid & 1 <> 0 THEN 'ReadData' END, CASE WHEN pid & 2 <> 0 THEN 'WriteData' END, CASE WHEN pid & 4 <> 0 THEN 'AppendData' END, CASE WHEN pid & 8 <> 0 THEN 'ReadEA' END, CASE WHEN pid & 16 <> 0 THEN 'WriteEA' END, CASE WHEN pid & 32 <> 0 THEN 'Execute' END, CASE WHEN pid & 64 <> 0 THEN 'DeleteChild' END, CASE WHEN pid & 128 <> 0 THEN 'ReadAttributes' END) AS access FROM security_log")
def semantic_decode(spark, sf_dir):
    status = F.when(F.col("k") % 3 == 0, "0xC000006A").when(F.col("k") % 3 == 1, "0XC0000234").otherwise("0xC0000001")
    return log(spark, sf_dir).select("record_id", D.decoded(F.col("logon_type"), D.LOGON_TYPE).alias("logon"), D.status_text(status).alias("status"), D.access_text(F.col("pid")).alias("access"))


@query("SELECT record_id, CASE event_code WHEN 4624 THEN concat(user_name, ' logged on to ', computer, ' from ', ip_address) WHEN 4625 THEN concat('Logon of ', user_name, ' to ', computer, ' from ', ip_address, ' failed') WHEN 4672 THEN concat(user_name, ' got special rights on ', computer) WHEN 4688 THEN concat(user_name, ' started ', process_name, ' on ', computer) ELSE concat('Account ', user_name, ' was made on ', computer) END AS description FROM security_log")
def event_descriptions(spark, sf_dir):
    rows = log(spark, sf_dir).select("record_id", "event_code", "user_name", "computer", "process_name", "ip_address")
    return D.described(rows, "event_code", F.col("user_name"), F.col("computer"), F.col("process_name"), F.col("ip_address")).select("record_id", "description")


@query("SELECT s.record_id, s.event_code, s.process_name FROM security_log s JOIN (SELECT event_code, process_name FROM (SELECT event_code, process_name, count(*) FILTER (sec < 1705363200) AS b, count(*) FILTER (sec >= 1705363200) AS a FROM security_log GROUP BY 1, 2) WHERE a >= 1.2 * b AND b > 0 OR b = 0) d USING (event_code, process_name) WHERE s.sec >= 1705363200")
def diff_events(spark, sf_dir):
    """The incident's records of keys that are new or spike."""
    rows = log(spark, sf_dir).select("record_id", "event_code", "process_name", "sec")
    new = rows.where("sec >= 1705363200")
    keys = A.capture_diff(rows.where("sec < 1705363200"), new, ["event_code", "process_name"], 1.2).where("kind in ('new', 'spike')")
    return new.join(keys, ["event_code", "process_name"], "left_semi").select("record_id", "event_code", "process_name")


@query(burst_sql(["ip_address"], 5 * 86_400, 3, "event_code = 4625"), recursive=True)
def profile_threshold(spark, sf_dir):
    """A profile's threshold rule: three failures of one address in five days."""
    return Q.bursts(log(spark, sf_dir).where("event_code = 4625").select("ip_address", "sec", "record_id"), ["ip_address"], 5 * 86_400, 3)


@query(BLOCK_SQL + "SELECT count(*) AS blocks, count(*) FILTER (missing > 0) AS partial_blocks, count(*) FILTER (contains(text, 'DownloadString')) AS downloads, max(length(text)) AS longest FROM blocks")
def script_summary(spark, sf_dir):
    blocks = P.block_flags(P.script_blocks(_fragments(spark, sf_dir)))
    return blocks.agg(F.count("*").alias("blocks"), F.count_if(~F.col("complete")).alias("partial_blocks"), F.count_if("download").alias("downloads"), F.max(F.length("text")).cast("long").alias("longest"))


@query(SCORE_SQL + "SELECT record_id, tier, score FROM tiers WHERE tier >= 3")
def anomaly_report(spark, sf_dir):
    """All rows of tier 3 and 4, by tier and falling score."""
    return scored(spark, sf_dir).where("tier >= 3").select("record_id", "tier", "score").orderBy("tier", F.desc("score"), "record_id")


@query("SELECT concat('$', process_name, ' = \"', process_name, '\" nocase') AS line, CASE WHEN process_name = 'svch0st.exe' THEN 75 ELSE 15 END AS score FROM (SELECT DISTINCT process_name FROM security_log) WHERE process_name = 'svch0st.exe'")
def signature_strings(spark, sf_dir):
    """Signature strings of the 50 processes of highest score over 60; the limit is the rule file's."""
    names = log(spark, sf_dir).select("process_name").distinct()
    rated = names.withColumn("score", I.process_score(F.col("process_name"))["score"]).where("score > 60")
    top = rated.orderBy(F.desc("score"), "process_name").limit(50)
    return top.select(F.format_string('$%s = "%s" nocase', "process_name", F.left("process_name", F.lit(80))).alias("line"), "score")


@query("SELECT computer, count(*) AS logons, count(*) FILTER (event_code = 4625) AS failures, round(CAST(count(*) FILTER (event_code = 4625) AS DOUBLE) / count(*), 6) AS share FROM security_log WHERE event_code IN (4624, 4625) GROUP BY 1")
def failure_share(spark, sf_dir):
    grouped = log(spark, sf_dir).where("event_code in (4624, 4625)").groupBy("computer")
    failed = F.count_if(F.col("event_code") == 4625)
    return grouped.agg(F.count("*").alias("logons"), failed.alias("failures"), F.round(failed / F.count("*"), 6).alias("share"))
