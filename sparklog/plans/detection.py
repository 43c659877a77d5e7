"""Queries of tags and attack chains."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.operators import sequences as Q
from sparklog.operators import tags as T
from sparklog.plans.base import query
from sparklog.plans.joining import burst_sql
from sparklog.sources.audit_log import AUDIT_SQL, audit_log
from sparklog.sources.security_log import security_log as log
from sparklog.sources.security_log import spread

HOUR, DAY = 3600, 86_400


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


STATIC_SQL = f"static_map(code, tactic, tid) AS (VALUES {_values(T.static_map())})"
LINEAGE_SQL = f"lineage(parent, child, tactic, tid, confidence) AS (VALUES {_values(T.lineage_pairs())})"
BENIGN_SQL = f"benign(parent, child) AS (VALUES {_values(T.benign_pairs())})"
RULE_SQL = """ruled AS (
  SELECT record_id, event_code, process_name, parent_name, unnest(CASE
    WHEN event_code = 4624 AND logon_type IN ('5', '7') THEN []
    WHEN event_code = 4624 AND logon_type = '10' THEN [{'a': 'Initial Access', 'b': 'T1078', 'c': 'medium'}, {'a': 'Lateral Movement', 'b': 'T1021.001', 'c': 'medium'}]
    WHEN event_code = 4624 AND logon_type = '3' THEN [{'a': 'Initial Access', 'b': 'T1078', 'c': 'medium'}, {'a': 'Lateral Movement', 'b': 'T1021', 'c': 'medium'}]
    WHEN event_code = 4624 THEN [{'a': 'Initial Access', 'b': 'T1078', 'c': 'low'}]
    WHEN event_code = 4625 THEN [{'a': 'Credential Access', 'b': 'T1110', 'c': 'low'}]
    WHEN event_code = 4672 THEN [{'a': 'Privilege Escalation', 'b': 'T1134', 'c': 'medium'}]
    WHEN event_code = 4688 AND process_name = 'powershell.exe' THEN [{'a': 'Execution', 'b': 'T1059.001', 'c': 'medium'}]
    WHEN event_code = 4688 AND process_name = 'cmd.exe' AND parent_name = 'explorer.exe' THEN [{'a': 'Execution', 'b': 'T1059.003', 'c': 'low'}]
    WHEN event_code = 4688 AND process_name = 'cmd.exe' THEN [{'a': 'Execution', 'b': 'T1059.003', 'c': 'medium'}]
    WHEN event_code = 4688 AND process_name NOT IN ('conhost.exe', 'svchost.exe') THEN [{'a': 'Execution', 'b': 'T1059', 'c': 'low'}]
    ELSE [] END) AS t FROM security_log)"""
TAGGED_SQL = f"""{STATIC_SQL}, {LINEAGE_SQL}, {BENIGN_SQL}, {RULE_SQL}, own AS (
  SELECT record_id, event_code, process_name, parent_name, t.a AS tactic, t.b AS tid, t.c AS confidence FROM ruled
  UNION ALL SELECT record_id, event_code, process_name, parent_name, tactic, tid, CASE WHEN event_code IN (4624, 4672, 4663, 4656, 5140, 7036) THEN 'low' ELSE 'medium' END FROM security_log JOIN static_map ON code = event_code
    WHERE event_code NOT IN (4624, 4625, 4672, 4688)
), every AS (
  SELECT record_id, tactic, tid, confidence FROM own o WHERE NOT (event_code = 4688 AND tactic = 'Execution' AND EXISTS (SELECT 1 FROM benign WHERE parent = parent_name AND child = process_name))
  UNION ALL SELECT record_id, tactic, tid, confidence FROM security_log JOIN lineage ON parent = parent_name AND child = process_name WHERE event_code = 4688
), tagged AS (
  SELECT record_id, tactic, tid, min_by(confidence, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS confidence FROM every GROUP BY 1, 2, 3)"""


def _exploded(df, column, *key):
    key = key or ("record_id",)
    return df.select(*key, F.explode(column).alias("t")).select(*key, "t.tactic", "t.tid", "t.confidence")


@query(f", {STATIC_SQL} SELECT record_id, tactic, tid, CASE WHEN event_code IN (4624, 4672, 4663, 4656, 5140, 7036) THEN 'low' ELSE 'medium' END AS confidence FROM security_log JOIN static_map ON code = event_code")
def tags_static(spark, sf_dir):
    return _exploded(T.static_tags(log(spark, sf_dir).select("record_id", "event_code")), "static")


@query(f", {RULE_SQL} SELECT record_id, t.a AS tactic, t.b AS tid, t.c AS confidence FROM ruled")
def tags_rules(spark, sf_dir):
    return _exploded(T.with_rule_columns(spread(log(spark, sf_dir))).select("record_id", T.best_of(T.rule_tags()).alias("tags")), "tags")


@query(f", {TAGGED_SQL} SELECT * FROM tagged")
def tags_context(spark, sf_dir):
    return _exploded(T.tagged(spread(log(spark, sf_dir))), "tags")


@query(f", {TAGGED_SQL} SELECT tactic, tid, count(*) AS n FROM tagged GROUP BY ROLLUP (tactic, tid)")
def tag_summary(spark, sf_dir):
    rows = spread(log(spark, sf_dir)).select("record_id", "event_code", "logon_type", "user_name", "process_name", "parent_name")
    return _exploded(T.tagged(rows), "tags").rollup("tactic", "tid").agg(F.count("*").alias("n"))


@query(f", {TAGGED_SQL} SELECT DISTINCT record_id FROM tagged WHERE tid = 'T1566' OR tactic = 'Lateral Movement'")
def tag_filter(spark, sf_dir):
    hit = F.exists("tags", lambda t: (t["tid"] == "T1566") | (t["tactic"] == "Lateral Movement"))
    return T.tagged(spread(log(spark, sf_dir))).where(hit).select("record_id")


@query("SELECT source_file, record_id, tid FROM security_log JOIN (VALUES ('T1059.001', ['powershell', 'host']), ('T1218.011', ['rundll32'])) r(tid, words) ON len([w FOR w IN words IF list_contains(regexp_split_to_array(lower(concat(process_name, ' ', computer, ' host')), '[^a-z0-9]+'), w)]) >= least(2, len(words)) WHERE event_code = 4688")
def keyword_tags(spark, sf_dir):
    rules = spark.createDataFrame([("T1059.001", ["powershell", "host"]), ("T1218.011", ["rundll32"])], "tid string, keywords array<string>")
    rows = log(spark, sf_dir).where("event_code = 4688").select("source_file", "record_id", F.concat_ws(" ", "process_name", "computer", F.lit("host")).alias("command"))
    return T.keyword_tags(rows, "command", rules)


CHAIN = ["record_id", "sec", "computer", "user_name"]


def _pairs(spark, sf_dir, first, then, keys, seconds, condition=None):
    cols = [*CHAIN, "ip_address", "logon_type", "process_name", "parent_name", "event_code"]
    rows = log(spark, sf_dir).select(*cols)
    return Q.interval_join(rows.where(first), rows.where(then), keys, seconds, condition=condition)


def _best(found, by, most):
    """The ``most`` earliest first events per later event: the chain's shown members."""
    rank = F.row_number().over(W.partitionBy("r_record_id").orderBy(*by))
    return found.withColumn("place", rank).where(F.col("place") <= most)


@query(f"""SELECT f.computer, f.user_name, f.record_id AS first_id, min(s.record_id) AS success_id FROM (
  SELECT a.*, (SELECT max_by(b.sec, b.sec) FROM security_log b WHERE b.event_code = 4625 AND b.computer = a.computer AND b.user_name = a.user_name AND b.sec BETWEEN a.sec AND a.sec + {DAY}) AS last_s,
    (SELECT count(*) FROM security_log b WHERE b.event_code = 4625 AND b.computer = a.computer AND b.user_name = a.user_name AND b.sec BETWEEN a.sec AND a.sec + {DAY} AND (b.sec > a.sec OR b.record_id >= a.record_id)) AS n
  FROM security_log a WHERE a.event_code = 4625) f JOIN security_log s ON s.event_code = 4624 AND s.computer = f.computer AND s.user_name = f.user_name AND s.sec BETWEEN f.last_s AND f.last_s + {DAY // 2}
  WHERE f.n >= 3 GROUP BY ALL""")
def chain_brute_force(spark, sf_dir):
    """Starts of three failures within a day, with a success of the user within half a day after the last."""
    rows = log(spark, sf_dir).where("event_code in (4624, 4625)").select("event_code", *CHAIN)
    failed = rows.where("event_code = 4625")
    key = W.partitionBy("computer", "user_name")
    ahead = key.orderBy("sec").rangeBetween(0, DAY)
    i = F.row_number().over(key.orderBy("sec", "record_id"))
    starts = failed.withColumn("i", i).withColumn("n", F.max("i").over(ahead) - F.col("i") + 1).withColumn("last_s", F.max("sec").over(ahead)).where("n >= 3")
    found = Q.interval_join(starts.select("computer", "user_name", "record_id", F.col("last_s").alias("sec")), rows.where("event_code = 4624"), ["computer", "user_name"], DAY // 2)
    return found.groupBy(F.col("l_computer").alias("computer"), F.col("l_user_name").alias("user_name"), F.col("l_record_id").alias("first_id")).agg(F.min("r_record_id").alias("success_id"))


def _chain(name, first, then, keys, seconds, first_sql, then_sql, most=3, shown=2, clearing=False):
    """Registers ``name``, the pairs with at most ``most`` first events per later one, and ``name_whole``, every chain."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)

    def run(spark, sf_dir):
        found = _best(_pairs(spark, sf_dir, first, then, keys, seconds), ["l_sec", "l_record_id"], most)
        return found.select(F.col("l_record_id").alias("first_id"), F.col("r_record_id").alias("then_id"), F.col("r_computer").alias("computer"), F.col("place").cast("long").alias("place"))

    run.__name__ = name
    run.__doc__ = f"{then} within {seconds} s after {first} of the same {', '.join(keys)}; the {most} first per later event."
    query(f"SELECT * FROM (SELECT a.record_id AS first_id, b.record_id AS then_id, b.computer, row_number() OVER (PARTITION BY b.record_id ORDER BY a.sec, a.record_id) AS place FROM security_log a JOIN security_log b ON {on} AND b.sec BETWEEN a.sec AND a.sec + {seconds} WHERE {first_sql} AND {then_sql}) WHERE place <= {most}")(run)

    by, other, way, before = ("b", "a", "DESC", " AND a.sec < b.sec") if clearing else ("a", "b", "ASC", "")

    def whole(spark, sf_dir):
        strictly = F.col("l_sec") < F.col("r_sec") if clearing else None
        pairs = _pairs(spark, sf_dir, first, then, keys, seconds, strictly)
        return Q.chains(pairs, "r", "l", shown, last=True) if clearing else Q.chains(pairs, "l", "r", shown)

    whole.__name__ = f"{name}_whole"
    whole.__doc__ = f"Every {'clearing' if clearing else 'first'} event of {name} with the number of all its matches; {shown} of them shown."
    query(f"SELECT first_id, computer, count(*) AS matches, list(id ORDER BY sec, id) FILTER (place <= {shown}) AS shown FROM (SELECT {by}.record_id AS first_id, {by}.computer, {other}.sec, {other}.record_id AS id, row_number() OVER (PARTITION BY {by}.record_id ORDER BY {other}.sec {way}, {other}.record_id {way}) AS place FROM security_log a JOIN security_log b ON {on} AND b.sec BETWEEN a.sec AND a.sec + {seconds}{before} WHERE {first_sql} AND {then_sql}) GROUP BY ALL")(whole)


_chain("chain_service_install", "event_code = 4624 and logon_type = '3' and ip_address <> '127.0.0.1'", "event_code = 4720 and process_name in ('svch0st.exe', 'rundll32.exe')", ["computer"], HOUR, "a.event_code = 4624 AND a.logon_type = '3' AND a.ip_address <> '127.0.0.1'", "b.event_code = 4720 AND b.process_name IN ('svch0st.exe', 'rundll32.exe')", shown=3)
_chain("chain_privilege_after_logon", "event_code = 4624", "event_code = 4672", ["computer", "user_name"], HOUR, "a.event_code = 4624", "b.event_code = 4672")
_chain("chain_log_clearing", "event_code = 4672", "event_code = 4720 and level = 4", ["computer"], 1800, "a.event_code = 4672", "b.event_code = 4720 AND b.level = 4", 5, shown=5, clearing=True)
_chain("chain_task_after_logon", "event_code = 4624 and logon_type not in ('4', '5')", "event_code = 4720", ["computer", "user_name"], 6 * HOUR, "a.event_code = 4624 AND a.logon_type NOT IN ('4', '5')", "b.event_code = 4720")
_chain("chain_account_after_recon", "event_code = 4672", "event_code = 4720", ["computer", "user_name"], DAY, "a.event_code = 4672", "b.event_code = 4720")
_chain("chain_shell_to_script", "event_code = 4688 and parent_name in ('winword.exe', 'wmiprvse.exe')", "event_code = 4720 and process_name = 'powershell.exe'", ["computer"], 2 * HOUR, "a.event_code = 4688 AND a.parent_name IN ('winword.exe', 'wmiprvse.exe')", "b.event_code = 4720 AND b.process_name = 'powershell.exe'")


@query(burst_sql(["computer"], DAY, 12, "event_code = 4720"), recursive=True)
def chain_weak_cipher(spark, sf_dir):
    return Q.bursts(log(spark, sf_dir).where("event_code = 4720").select(*CHAIN), ["computer"], DAY, 12)


@query("SELECT record_id, computer, user_name, ip_address FROM security_log WHERE event_code = 4624 AND logon_type = '3' AND NOT starts_with(ip_address, '127.')")
def chain_pass_the_hash(spark, sf_dir):
    return log(spark, sf_dir).where("event_code = 4624 and logon_type = '3' and not startswith(ip_address, '127.')").select("record_id", "computer", "user_name", "ip_address")


_SPREAD = "(SELECT count(DISTINCT b.x) FROM rows b WHERE {same} AND b.sec BETWEEN a.sec AND a.sec + {seconds}) >= {least}"


@query(burst_sql(["computer"], DAY // 2, 6, "event_code = 4625", "user_name AS x", _SPREAD.format(same="b.computer = a.computer", seconds=DAY // 2, least=4)), recursive=True)
def chain_spray(spark, sf_dir):
    return Q.bursts(log(spark, sf_dir).where("event_code = 4625").select(*CHAIN), ["computer"], DAY // 2, 6, distinct="user_name", least_distinct=4)


@query(burst_sql(["user_name"], 7 * DAY, 3, "event_code = 4624 AND logon_type IN ('3', '10')", "ip_address AS x", _SPREAD.format(same="b.user_name = a.user_name", seconds=7 * DAY, least=3)), recursive=True)
def chain_multi_host(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4624 and logon_type in ('3', '10')").select(*CHAIN, "ip_address")
    return Q.bursts(rows, ["user_name"], 7 * DAY, 3, distinct="ip_address", least_distinct=3)


@query("SELECT computer, logon_id, count(*) FILTER (event_code = 4624) AS logons, count(*) FILTER (event_code = 4672) AS privileges, min(sec) AS start_s FROM security_log WHERE event_code IN (4624, 4672) GROUP BY 1, 2 HAVING count(*) FILTER (event_code = 4624) > 0 AND count(*) FILTER (event_code = 4672) > 0")
def chain_session_privilege(spark, sf_dir):
    count = lambda code: F.count_if(F.col("event_code") == code)
    grouped = log(spark, sf_dir).where("event_code in (4624, 4672)").groupBy("computer", "logon_id")
    return grouped.agg(count(4624).alias("logons"), count(4672).alias("privileges"), F.min("sec").alias("start_s")).where("logons > 0 and privileges > 0")


@query("SELECT computer, logon_id, count(*) FILTER (event_code = 4688 AND process_name <> 'conhost.exe') AS processes, string_agg(DISTINCT process_name, ',' ORDER BY process_name) FILTER (event_code = 4688 AND process_name <> 'conhost.exe') AS names FROM security_log GROUP BY 1, 2 HAVING bool_or(event_code = 4624 AND logon_type = '3') AND count(*) FILTER (event_code = 4688 AND process_name <> 'conhost.exe') > 0")
def chain_session_process(spark, sf_dir):
    odd = (F.col("event_code") == 4688) & (F.col("process_name") != "conhost.exe")
    grouped = log(spark, sf_dir).groupBy("computer", "logon_id").agg(F.count_if(odd).alias("processes"), F.array_join(F.array_sort(F.collect_set(F.when(odd, F.col("process_name")))), ",").alias("names"), F.bool_or((F.col("event_code") == 4624) & (F.col("logon_type") == "3")).alias("remote"))
    return grouped.where("remote and processes > 0").drop("remote")


TREE_SQL = """, starts AS (
  SELECT record_id, computer, process_name, parent_name, row_number() OVER (PARTITION BY computer, pid ORDER BY sec, record_id) AS v, pid, ppid, sec FROM security_log WHERE event_code = 4688
), edges AS (
  SELECT c.record_id AS child, (SELECT max_by(p.record_id, (p.sec, p.record_id)) FROM starts p WHERE p.computer = c.computer AND p.pid = c.ppid AND (p.sec < c.sec OR p.sec = c.sec AND p.record_id < c.record_id)) AS parent FROM starts c
), tree AS (
  SELECT e.parent AS root, e.child, 1 AS depth FROM edges e JOIN starts s ON s.record_id = e.parent WHERE s.process_name = 'winword.exe'
  UNION ALL SELECT t.root, e.child, t.depth + 1 FROM tree t JOIN edges e ON e.parent = t.child WHERE t.depth < 5
)
SELECT root, count(*) AS descendants, max(depth) AS depth, max(CASE WHEN process_name IN ('cmd.exe', 'powershell.exe') THEN 'critical' ELSE 'high' END = 'critical') AS shell FROM tree JOIN starts ON record_id = child GROUP BY root"""


@query(TREE_SQL, recursive=True)
def chain_process_tree(spark, sf_dir):
    """Descendants to depth 5 of each word-processor start, by five equi joins on the parent edge."""
    rows = log(spark, sf_dir).where("event_code = 4688")
    children = rows.select("computer", F.col("ppid").alias("id"), "sec", "record_id")
    parents = rows.select("computer", F.col("pid").alias("id"), "sec", "record_id", F.col("record_id").alias("own"), F.col("process_name").alias("parent_process"))
    edges = Q.as_of(children, parents, ["computer", "id"], ["own", "parent_process"]).where("found_own is not null")
    edges = edges.select(F.col("record_id").alias("child"), F.col("found_own").alias("parent"), F.col("found_parent_process").alias("of"))
    level = edges.where("of = 'winword.exe'").select(F.col("parent").alias("root"), "child", F.lit(1).alias("depth"))
    tree, step = level, edges.select("child", "parent")
    for depth in range(2, 6):
        level = level.select("root", F.col("child").alias("parent")).join(step, "parent").select("root", "child", F.lit(depth).alias("depth"))
        tree = tree.unionByName(level)
    named = tree.join(rows.select(F.col("record_id").alias("child"), "process_name"), "child")
    shell = F.col("process_name").isin("cmd.exe", "powershell.exe")
    return named.groupBy("root").agg(F.count("*").alias("descendants"), F.max("depth").alias("depth"), F.bool_or(shell).alias("shell"))


@query(f"""SELECT rule, computer, minute, min(record_id) AS record_id FROM (
  SELECT 'privilege' AS rule, b.computer, b.sec // 60 AS minute, b.record_id FROM security_log a JOIN security_log b ON a.computer = b.computer AND a.user_name = b.user_name AND b.sec BETWEEN a.sec AND a.sec + {HOUR} WHERE a.event_code = 4624 AND b.event_code = 4672
  UNION ALL SELECT 'hash', computer, sec // 60, record_id FROM security_log WHERE event_code = 4624 AND logon_type = '3') GROUP BY 1, 2, 3""")
def chain_dedupe(spark, sf_dir):
    """Chains of two rules, one per rule, host and minute."""
    minute = F.floor(F.col("sec") / 60).alias("minute")
    a = _pairs(spark, sf_dir, "event_code = 4624", "event_code = 4672", ["computer", "user_name"], HOUR).select(F.lit("privilege").alias("rule"), F.col("r_computer").alias("computer"), F.floor(F.col("r_sec") / 60).alias("minute"), F.col("r_record_id").alias("record_id"))
    b = log(spark, sf_dir).where("event_code = 4624 and logon_type = '3'").select(F.lit("hash").alias("rule"), "computer", minute, "record_id")
    return a.unionByName(b).groupBy("rule", "computer", "minute").agg(F.min("record_id").alias("record_id"))


@query("""SELECT rule, severity, count(*) AS chains, count(DISTINCT computer) AS hosts FROM (
  SELECT 'spray' AS rule, 'high' AS severity, computer FROM security_log WHERE event_code = 4625 UNION ALL SELECT 'hash', 'critical', computer FROM security_log WHERE event_code = 4624 AND logon_type = '3') GROUP BY 1, 2""")
def chains_all(spark, sf_dir):
    """Candidate events of two detections united, by severity."""
    rows = log(spark, sf_dir)
    spray = rows.where("event_code = 4625").select(F.lit("spray").alias("rule"), F.lit("high").alias("severity"), "computer")
    hashes = rows.where("event_code = 4624 and logon_type = '3'").select(F.lit("hash").alias("rule"), F.lit("critical").alias("severity"), "computer")
    return spray.unionByName(hashes).groupBy("rule", "severity").agg(F.count("*").alias("chains"), F.countDistinct("computer").alias("hosts"))


_AUDIT_RULES = """ruled AS (SELECT *, CASE
  WHEN event_code = 4624 AND logon_type = '5' THEN []
  WHEN event_code = 4624 AND logon_type IN ('3', '10') THEN [('Initial Access', 'T1078', 'medium'), ('Lateral Movement', CASE logon_type WHEN '3' THEN 'T1021' ELSE 'T1021.001' END, 'medium')]
  WHEN event_code = 4624 AND logon_type = '4' THEN [('Persistence', 'T1053.005', 'low')]
  WHEN event_code = 4624 THEN [('Initial Access', 'T1078', 'low')]
  WHEN event_code = 4625 THEN [('Credential Access', 'T1110', CASE WHEN lower(sub_status) IN ('0xc000006a', '0xc000006d') THEN 'medium' ELSE 'low' END)]
  WHEN event_code = 4672 THEN CASE WHEN lower(subject_user) = 'system' OR subject_user LIKE '%$' THEN [] ELSE [('Privilege Escalation', 'T1134', 'medium')] END
  WHEN event_code = 4688 THEN CASE WHEN child IN ('conhost.exe', 'svchost.exe') THEN [] WHEN child = 'powershell.exe' THEN [('Execution', 'T1059.001', 'medium')]
    WHEN child = 'cmd.exe' THEN [('Execution', 'T1059.003', CASE WHEN parent = 'explorer.exe' THEN 'low' ELSE 'medium' END)] ELSE [('Execution', 'T1059', 'low')] END
  WHEN event_code = 1 AND child = 'powershell.exe' THEN list_concat(
    CASE WHEN lower(command_line) LIKE '%-enc %' THEN [('Execution', 'T1059.001', 'high')] ELSE [] END,
    list_concat(CASE WHEN lower(command_line) LIKE '%-nop %' THEN [('Defense Evasion', 'T1059.001', 'medium')] ELSE [] END,
    CASE WHEN lower(command_line) NOT LIKE '%-enc %' AND lower(command_line) NOT LIKE '%-nop %' THEN [('Execution', 'T1059.001', 'medium')] ELSE [] END))
  WHEN event_code = 1 AND child = 'cmd.exe' THEN [('Execution', 'T1059.003', 'medium')]
  WHEN event_code = 1 AND child IN ('conhost.exe', 'svchost.exe') THEN []
  WHEN event_code = 1 THEN [('Execution', 'T1059', 'low')]
  WHEN event_code = 4663 THEN []
  WHEN event_code = 7045 THEN [('Persistence', 'T1543.003', CASE WHEN regexp_matches(lower(service_path), '^(c:/windows/|%systemroot%/)') THEN 'low' ELSE 'high' END)]
  WHEN event_code = 5140 THEN CASE WHEN lower(share_name) LIKE '%/admin$' THEN [('Lateral Movement', 'T1021.002', 'medium')] ELSE [('Lateral Movement', 'T1039', 'low')] END
  WHEN event_code = 4769 THEN CASE WHEN ticket_service LIKE '%$' THEN [] WHEN ticket_cipher IN ('0x17', '23') THEN [('Credential Access', 'T1558.003', 'high')] ELSE [('Credential Access', 'T1558.003', 'medium')] END
  END AS own FROM (SELECT *, CASE WHEN image LIKE '%/%' THEN regexp_extract(lower(image), '[^/]*$') ELSE concat('no path ', image) END AS child, regexp_extract(lower(image), '[^/]*$') AS short, regexp_extract(lower(parent_image), '[^/]*$') AS parent FROM audit))"""
AUDIT_TAGS_SQL = f"""WITH {AUDIT_SQL}, {_AUDIT_RULES}, {STATIC_SQL}, {LINEAGE_SQL}, {BENIGN_SQL}, first AS (
  SELECT source_file, record_id, event_code, short, parent, unnest(own) AS t FROM ruled WHERE own IS NOT NULL
  UNION ALL SELECT source_file, record_id, event_code, short, parent, (tactic, tid, CASE WHEN event_code IN (4624, 4672, 4663, 4656, 5140, 7036) THEN 'low' ELSE 'medium' END) FROM ruled JOIN static_map ON code = event_code WHERE own IS NULL AND (code > 25 OR lower(provider) LIKE '%sysmon%')
), every AS (
  SELECT source_file, record_id, t[1] AS tactic, t[2] AS tid, t[3] AS confidence FROM first WHERE NOT (event_code IN (1, 4688) AND t[1] = 'Execution' AND EXISTS (SELECT 1 FROM benign b WHERE b.parent = first.parent AND child = short))
  UNION ALL SELECT source_file, record_id, tactic, tid, confidence FROM ruled r JOIN lineage l ON l.parent = r.parent AND l.child = r.short WHERE event_code IN (1, 4688)
) SELECT source_file, record_id, tactic, tid, min_by(confidence, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS confidence FROM every GROUP BY 1, 2, 3, 4"""


@query(AUDIT_TAGS_SQL, log=False)
def audit_tags(spark, sf_dir):
    """Tags of the audit log by all conditional rules, the static map and the context (no command there is random enough for a tag)."""
    return _exploded(T.tagged(spread(audit_log(spark, sf_dir))), "tags", "source_file", "record_id")
