"""Queries of joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.operators import aggregates as A
from sparklog.operators import sequences as Q
from sparklog.plans.base import query
from sparklog.sources.security_log import security_log as log
from sparklog.sources.security_log import table

DAY = 86_400


@query("SELECT record_id, source_file, value FROM security_log p WHERE EXISTS (SELECT 1 FROM security_log q WHERE q.event_code = 4625 AND q.user_name IN ('user1', 'user2', 'user3') AND q.record_id = p.record_id AND q.source_file = p.source_file)")
def payload_semi_join(spark, sf_dir):
    keys = log(spark, sf_dir).where("event_code = 4625 and user_name in ('user1', 'user2', 'user3')").select("record_id", "source_file")
    return log(spark, sf_dir).select("record_id", "source_file", "value").join(keys, ["record_id", "source_file"], "left_semi")


@query("SELECT record_id, user_name FROM security_log WHERE (source_file, user_name) IN (SELECT source_file, user_name FROM security_log WHERE event_code = 4720 AND k % 10 = 0)")
def key_pivot(spark, sf_dir):
    marked = log(spark, sf_dir).where("event_code = 4720 and k % 10 = 0").select("source_file", "user_name")
    return log(spark, sf_dir).select("record_id", "source_file", "user_name").join(marked, ["source_file", "user_name"], "left_semi").select("record_id", "user_name")


@query(f"SELECT a.record_id AS logon, b.record_id AS created, b.sec - a.sec AS gap FROM security_log a JOIN security_log b ON a.computer = b.computer AND a.user_name = b.user_name AND b.sec BETWEEN a.sec AND a.sec + {DAY} WHERE a.event_code = 4624 AND b.event_code = 4720")
def interval_join(spark, sf_dir):
    rows = log(spark, sf_dir).select("record_id", "sec", "computer", "user_name", "event_code")
    found = Q.interval_join(rows.where("event_code = 4624"), rows.where("event_code = 4720"), ["computer", "user_name"], DAY)
    return found.select(F.col("l_record_id").alias("logon"), F.col("r_record_id").alias("created"), (F.col("r_sec") - F.col("l_sec")).alias("gap"))


@query("SELECT b.record_id, count(a.record_id) AS n FROM security_log b JOIN security_log a ON a.computer = b.computer AND a.sec BETWEEN b.sec - 1800 AND b.sec AND a.event_code <> 4720 WHERE b.event_code = 4720 GROUP BY 1")
def prior_activity(spark, sf_dir):
    rows = log(spark, sf_dir).select("record_id", "sec", "computer", "event_code")
    found = Q.interval_join(rows.where("event_code <> 4720"), rows.where("event_code = 4720"), ["computer"], 1800)
    return found.groupBy(F.col("r_record_id").alias("record_id")).agg(F.count("*").alias("n"))


@query("""SELECT c.record_id, p.record_id AS parent_record, p.process_name AS parent_process FROM (SELECT * FROM security_log WHERE event_code = 4688) c LEFT JOIN LATERAL
  (SELECT record_id, process_name FROM security_log p WHERE p.event_code = 4688 AND p.computer = c.computer AND p.pid = c.ppid AND (p.sec < c.sec OR p.sec = c.sec AND p.record_id < c.record_id) ORDER BY p.sec DESC, p.record_id DESC LIMIT 1) p ON true""")
def parent_as_of(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4688")
    children = rows.select("computer", F.col("ppid").alias("id"), "sec", "record_id")
    parents = rows.select("computer", F.col("pid").alias("id"), "sec", "record_id", F.col("record_id").alias("own"), "process_name")
    found = Q.as_of(children, parents, ["computer", "id"], ["own", "process_name"])
    return found.select("record_id", F.col("found_own").alias("parent_record"), F.col("found_process_name").alias("parent_process"))


@query("""SELECT e.record_id, coalesce((SELECT max_by(s.record_id, (s.sec, s.record_id)) FROM security_log s WHERE s.event_code = 4624 AND s.pid = e.pid AND s.computer = e.computer AND s.sec <= e.sec),
  (SELECT min_by(s.record_id, (s.sec, s.record_id)) FROM security_log s WHERE s.event_code = 4624 AND s.pid = e.pid AND s.computer = e.computer)) AS session_record FROM security_log e WHERE e.event_code = 4688""")
def best_session(spark, sf_dir):
    """The latest session of the process number that began by then, else the earliest."""
    starts = log(spark, sf_dir).where("event_code = 4624").select("computer", "pid", "sec", "record_id", F.lit(0).alias("side"))
    events = log(spark, sf_dir).where("event_code = 4688").select("computer", "pid", "sec", "record_id", F.lit(1).alias("side"))
    key = W.partitionBy("computer", "pid")
    own = F.when(F.col("side") == 0, F.col("record_id"))
    before = F.last(own, ignorenulls=True).over(key.orderBy("sec", "side", "record_id").rowsBetween(W.unboundedPreceding, 0))
    first = F.first(own, ignorenulls=True).over(key.orderBy("sec", "record_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = starts.unionByName(events).select("record_id", "side", F.coalesce(before, first).alias("session_record"))
    return rows.where("side = 1").select("record_id", "session_record")


@query("SELECT a.record_id, b.record_id AS privilege FROM security_log a JOIN security_log b ON a.computer = b.computer AND a.logon_id = b.logon_id WHERE a.event_code = 4624 AND b.event_code = 4672")
def logon_id_join(spark, sf_dir):
    rows = log(spark, sf_dir).select("record_id", "computer", "logon_id", "event_code")
    return rows.where("event_code = 4624").drop("event_code").join(rows.where("event_code = 4672").select(F.col("record_id").alias("privilege"), "computer", "logon_id"), ["computer", "logon_id"]).select("record_id", "privilege")


@query("SELECT DISTINCT user_name, process_name FROM security_log i WHERE i.sec >= 1705363200 AND i.event_code = 4720 AND NOT EXISTS (SELECT 1 FROM security_log b WHERE b.sec < 1705363200 AND b.event_code = 4720 AND b.user_name = i.user_name AND b.process_name = i.process_name)")
def only_in_incident(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4720").select("user_name", "process_name", "sec")
    keys = ["user_name", "process_name"]
    return rows.where("sec >= 1705363200").select(*keys).join(rows.where("sec < 1705363200"), keys, "left_anti").distinct()


@query("SELECT user_name FROM security_log WHERE event_code = 4720 INTERSECT SELECT user_name FROM security_log WHERE event_code = 4625 AND level = 2 AND sec > 1705363200")
def ids_in_both(spark, sf_dir):
    rows = log(spark, sf_dir)
    return rows.where("event_code = 4720").select("user_name").intersect(rows.where("event_code = 4625 and level = 2 and sec > 1705363200").select("user_name"))


@query("""SELECT name, val, count(*) AS n FROM (SELECT unnest(['event_code', 'level', 'computer', 'user_name', 'source_file', 'process_name']) AS name,
  unnest([CAST(event_code AS VARCHAR), CAST(level AS VARCHAR), computer, user_name, source_file, process_name]) AS val FROM security_log) GROUP BY 1, 2""")
def column_metadata(spark, sf_dir):
    return A.column_metadata(log(spark, sf_dir), ["event_code", "level", "computer", "user_name", "source_file", "process_name"])


@query("SELECT user_name AS val, count(*) AS n FROM security_log WHERE computer IN ('HOST1', 'HOST2') AND contains(user_name, '1') GROUP BY 1 ORDER BY n DESC, val LIMIT 1000")
def column_values(spark, sf_dir):
    return A.column_values(log(spark, sf_dir), "user_name", F.col("computer").isin("HOST1", "HOST2"), "1")


@query("""SELECT event_code, process_name, coalesce(before, 0) AS before, coalesce(after, 0) AS after,
  CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'missing' WHEN after >= 1.2 * before THEN 'spike' WHEN before >= 1.2 * after THEN 'drop' ELSE 'same' END AS kind,
  round(CAST(after AS DOUBLE) / before, 6) AS ratio
FROM (SELECT event_code, process_name, count(*) AS before FROM security_log WHERE sec < 1705363200 GROUP BY 1, 2) FULL JOIN (SELECT event_code, process_name, count(*) AS after FROM security_log WHERE sec >= 1705363200 GROUP BY 1, 2) USING (event_code, process_name)""")
def capture_diff(spark, sf_dir):
    rows = log(spark, sf_dir)
    return A.capture_diff(rows.where("sec < 1705363200"), rows.where("sec >= 1705363200"), ["event_code", "process_name"], 1.2)


@query("""SELECT computer, CAST(count(DISTINCT x) AS BIGINT) AS expected FROM (SELECT computer, unnest(range(lo, hi + 1)) AS x FROM (SELECT computer, CAST(floor(record_id / 50) AS BIGINT) AS b, min(record_id) AS lo, max(record_id) + 30 AS hi FROM security_log GROUP BY 1, 2)) GROUP BY 1""")
def expected_records(spark, sf_dir):
    ranges = log(spark, sf_dir).groupBy("computer", F.floor(F.col("record_id") / 50).alias("b")).agg(F.min("record_id").alias("lo"), (F.max("record_id") + 30).alias("hi"))
    return Q.merged_length(ranges, "computer", "lo", "hi")


@query("SELECT source_file, prev + 1 AS gap_from, record_id - 1 AS gap_to, record_id - prev - 1 AS missing FROM (SELECT source_file, record_id, lag(record_id) OVER (PARTITION BY source_file ORDER BY record_id) AS prev FROM security_log) WHERE record_id > prev + 1")
def record_gaps(spark, sf_dir):
    return Q.record_gaps(log(spark, sf_dir).select("source_file", "record_id"))


BURST_SQL = """, rows AS (
  SELECT {keys}, sec, record_id, {extra}, row_number() OVER (PARTITION BY {keys} ORDER BY sec, record_id) AS i FROM security_log WHERE {where}
), reach AS (
  SELECT a.*, (SELECT max(b.i) FROM rows b WHERE {same} AND b.sec BETWEEN a.sec AND a.sec + {seconds}) AS hi FROM rows a
), good AS (
  SELECT * FROM reach a WHERE hi - i + 1 >= {least} AND {more}
), walk AS (
  SELECT {keys}, min(i) AS i FROM good GROUP BY {keys}
  UNION ALL
  SELECT {wkeys}, (SELECT min(g.i) FROM good g WHERE {wsame} AND g.i > (SELECT h.hi FROM good h WHERE {hsame} AND h.i = w.i)) FROM walk w WHERE w.i IS NOT NULL
)
SELECT {rkeys}, min(r.sec) AS start_s, max(r.sec) AS end_s, count(*) AS n, min_by(r.record_id, r.i) AS first_id, max_by(r.record_id, r.i) AS last_id
FROM walk w JOIN good g ON {gw} AND g.i = w.i JOIN rows r ON {rw} AND r.i BETWEEN g.i AND g.hi GROUP BY {rkeys}, w.i"""


def burst_sql(keys: list[str], seconds: int, least: int, where: str, extra: str = "0 AS x", more: str = "true") -> str:
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    pre = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return BURST_SQL.format(keys=", ".join(keys), seconds=seconds, least=least, where=where, extra=extra, more=more, same=eq("b", "a"), wkeys=pre("w"), wsame=eq("g", "w"), hsame=eq("h", "w"), rkeys=pre("r"), gw=eq("g", "w"), rw=eq("r", "w"))


@query(burst_sql(["computer", "user_name"], DAY, 3, "event_code = 4625"), recursive=True)
def greedy_burst(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4625").select("computer", "user_name", "sec", "record_id")
    return Q.bursts(rows, ["computer", "user_name"], DAY, 3)


@query("SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY process_name, h ORDER BY sec, record_id) AS rn, min((sec, record_id)) OVER (PARTITION BY process_name) AS f, (sec, record_id) AS own FROM (SELECT *, user_name AS h FROM security_log WHERE event_code = 4688)) WHERE rn = 1 AND f < own")
def first_new_hash(spark, sf_dir):
    """First sight of a (process, hash) pair where the process was seen with another before."""
    rows = log(spark, sf_dir).where("event_code = 4688").select("process_name", F.col("user_name").alias("h"), "sec", "record_id")
    firsts = rows.groupBy("process_name", "h").agg(F.min(F.struct("sec", "record_id")).alias("own"))
    first = firsts.groupBy("process_name").agg(F.min("own").alias("f"))
    return firsts.join(first, "process_name").where("f < own").select(F.col("own.record_id").alias("record_id"))


@query("SELECT computer, logon_id, max_by(record_id, (sec, record_id)) AS record_id FROM security_log WHERE event_code = 4624 GROUP BY 1, 2")
def latest_logon(spark, sf_dir):
    return log(spark, sf_dir).where("event_code = 4624").groupBy("computer", "logon_id").agg(F.max_by("record_id", F.struct("sec", "record_id")).alias("record_id"))


SESSION_SQL = """, rows AS (SELECT *, sum(CASE WHEN event_code = 4624 THEN 1 ELSE 0 END) OVER (PARTITION BY computer, logon_id ORDER BY sec, record_id ROWS UNBOUNDED PRECEDING) AS instance FROM security_log)
SELECT computer, logon_id, CAST(instance AS BIGINT) AS instance, min(sec) AS start_s, coalesce(max(sec) FILTER (event_code = 4720), max(sec)) AS end_s,
  count(*) FILTER (event_code = 4688) AS processes, count(*) FILTER (event_code = 4672) AS privileges, count(*) AS events, count(*) FILTER (event_code = 4720) = 0 AS active,
  min_by(logon_type, (sec, record_id)) AS logon_type, instance = 0 AS partial, coalesce(max(sec) FILTER (event_code = 4720), max(sec)) - min(sec) AS seconds
FROM rows GROUP BY computer, logon_id, instance"""


@query(SESSION_SQL)
def logon_sessions(spark, sf_dir):
    return Q.logon_sessions(log(spark, sf_dir), ends=(4720,))


@query("SELECT record_id FROM security_log WHERE computer = 'HOST5' AND logon_id IN ('0x50', '0x51') AND sec >= 1704200000 AND sec < 1705500000")
def session_filter(spark, sf_dir):
    """Records of a session by its own or its linked id, on its host, from start to end."""
    ids = F.col("logon_id").isin("0x50", "0x51")
    return log(spark, sf_dir).where((F.col("computer") == "HOST5") & ids & (F.col("sec") >= 1704200000) & (F.col("sec") < 1705500000)).select("record_id")


@query("SELECT a.computer, a.logon_id, b.logon_id AS linked, count(*) AS n FROM (SELECT computer, logon_id, user_name, min(sec) AS s, max(sec) AS e FROM security_log GROUP BY 1, 2, 3) a JOIN (SELECT computer, logon_id, user_name, min(sec) AS s, max(sec) AS e FROM security_log GROUP BY 1, 2, 3) b ON a.computer = b.computer AND a.user_name = b.user_name AND a.logon_id < b.logon_id AND a.s <= b.e AND b.s <= a.e GROUP BY 1, 2, 3")
def linked_sessions(spark, sf_dir):
    """Sessions of one user and host whose spans overlap."""
    spans = log(spark, sf_dir).groupBy("computer", "logon_id", "user_name").agg(F.min("sec").alias("s"), F.max("sec").alias("e"))
    a, b = spans.alias("a"), spans.alias("b")
    on = F.expr("a.computer = b.computer and a.user_name = b.user_name and a.logon_id < b.logon_id and a.s <= b.e and b.s <= a.e")
    return a.join(b, on).groupBy("a.computer", "a.logon_id", F.col("b.logon_id").alias("linked")).agg(F.count("*").alias("n"))


@query("SELECT computer, name, side FROM (SELECT computer, process_name AS name, 'delete' AS side FROM security_log WHERE event_code = 4688 AND sec < 1705363200 EXCEPT SELECT computer, process_name, 'delete' FROM security_log WHERE event_code = 4688 AND sec >= 1705363200) UNION ALL SELECT computer, name, side FROM (SELECT computer, concat(process_name, user_name) AS name, 'insert' AS side FROM security_log WHERE event_code = 4688 AND sec >= 1705363200 EXCEPT SELECT computer, concat(process_name, user_name), 'insert' FROM security_log WHERE event_code = 4688 AND sec < 1705363200)")
def tree_node_diff(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4688")
    old, new = rows.where("sec < 1705363200"), rows.where("sec >= 1705363200")
    name, own = F.col("process_name").alias("name"), F.concat("process_name", "user_name").alias("name")
    gone = old.select("computer", name).distinct().join(new.select("computer", name), ["computer", "name"], "left_anti").withColumn("side", F.lit("delete"))
    added = new.select("computer", own).distinct().join(old.select("computer", own), ["computer", "name"], "left_anti").withColumn("side", F.lit("insert"))
    return gone.unionByName(added)


@query("SELECT source_file, bool_or(event_code IN (4688, 1)) AS relevant, count(*) AS n FROM security_log GROUP BY 1")
def relevant_files(spark, sf_dir):
    return log(spark, sf_dir).groupBy("source_file").agg(F.bool_or(F.col("event_code").isin(4688, 1)).alias("relevant"), F.count("*").alias("n"))


@query("SELECT event_code, level, computer, count(*) AS n FROM security_log GROUP BY GROUPING SETS ((event_code), (level), (computer))")
def quick_stats(spark, sf_dir):
    return log(spark, sf_dir).groupingSets([["event_code"], ["level"], ["computer"]], "event_code", "level", "computer").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", log=False)
def dimension_lookup(spark, sf_dir):
    """A fact table against two dimensions; the 25-row one is broadcast."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
