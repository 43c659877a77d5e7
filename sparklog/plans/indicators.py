"""Queries of indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import aggregates as A
from sparklog.operators import ioc as I
from sparklog.plans.base import query
from sparklog.sources.audit_log import AUDIT_SQL, audit_log
from sparklog.sources.security_log import security_log as log
from sparklog.sources.security_log import spread, table

IOC_SQL = f"""occurrences AS (
  SELECT doc_id, source, 'ipv4' AS ioc_type, unnest(regexp_extract_all(text, '{I.IPV4}')) AS val FROM documents
  UNION ALL SELECT doc_id, source, CASE length(v) WHEN 64 THEN 'sha256' WHEN 40 THEN 'sha1' ELSE 'md5' END, lower(v) FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '{I.HASHES}')) AS v FROM documents)
  UNION ALL SELECT page_id, 'page', 'url', lower(u) FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(url, 'https?://[^\\s"''<>]+')), '[.,;:)\\]]+$', '') AS u FROM pages) WHERE length(u) >= 10
  UNION ALL SELECT page_id, 'page', 'domain', lower(unnest(regexp_extract_all(url, '{I.DOMAIN}'))) FROM pages
  UNION ALL SELECT doc_id, source, 'domain', lower(unnest(regexp_extract_all(text, '{I.DOMAIN}'))) FROM documents
  UNION ALL SELECT page_id, 'page', 'ipv4', unnest(regexp_extract_all(url, '{I.IPV4}')) FROM pages
), kept AS (SELECT * FROM occurrences WHERE NOT (ioc_type = 'ipv4' AND (val IN ('127.0.0.1', '255.255.255.255', '169.254.169.254') OR starts_with(val, '0.'))))"""


def _occurrences(spark, sf_dir):
    docs = I.text_indicators(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "text", "doc_id", "source")
    pages = I.text_indicators(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("source"), "url"), "url", "doc_id", "source")
    return docs.unionByName(pages)


@query(f"WITH {IOC_SQL} SELECT ioc_type, val, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(source))), 1, 5), ',') AS source_set FROM kept GROUP BY 1, 2", log=False)
def ioc_table(spark, sf_dir):
    return I.ioc_table(_occurrences(spark, sf_dir), {"source": 5})


@query(f"WITH {IOC_SQL} SELECT ioc_type, count(*) AS occurrences, count(DISTINCT val) AS vals FROM kept GROUP BY 1", log=False)
def ioc_summary(spark, sf_dir):
    return _occurrences(spark, sf_dir).groupBy("ioc_type").agg(F.count("*").alias("occurrences"), F.countDistinct("val").alias("vals"))


@query(f"WITH {IOC_SQL} SELECT DISTINCT val, CASE WHEN regexp_matches(val, '{I.PRIVATE}') THEN 0 ELSE 30 END AS score FROM kept WHERE ioc_type = 'ipv4'", log=False)
def ioc_score_ip(spark, sf_dir):
    return _occurrences(spark, sf_dir).where("ioc_type = 'ipv4'").select("val").distinct().select("val", I.ip_score(F.col("val"))["score"].alias("score"))


@query("""SELECT process_name, CASE WHEN process_name = 'svch0st.exe' THEN 75 ELSE 15 END AS score FROM (SELECT DISTINCT process_name FROM security_log)""")
def ioc_score_process(spark, sf_dir):
    names = log(spark, sf_dir).select("process_name").distinct()
    return names.select("process_name", I.process_score(F.col("process_name"))["score"].alias("score"))


_CMD = "concat(process_name, CASE k % 4 WHEN 0 THEN ' -nop -w hidden -enc ' WHEN 1 THEN ' /c net user x /add ' WHEN 2 THEN ' iex (New-Object Net.WebClient).DownloadString ' ELSE ' schtasks /create ' END, user_name)"


@query("SELECT record_id, CASE k % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 85 ELSE 35 END AS score FROM security_log")
def ioc_score_command(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", I.command_score(F.expr(_CMD))["score"].alias("score"))


_KEY = "concat('HKLM\\\\Software\\\\', CASE k % 5 WHEN 0 THEN 'Windows\\\\Run\\\\' WHEN 1 THEN 'AppInit_DLLs' WHEN 2 THEN 'Winlogon\\\\Shell' WHEN 3 THEN 'CLSID\\\\x' ELSE 'Other' END)"


@query("SELECT record_id, CASE k % 5 WHEN 0 THEN 40 WHEN 1 THEN 60 WHEN 2 THEN 50 WHEN 3 THEN 30 ELSE 0 END AS score FROM security_log")
def ioc_score_registry(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", I.registry_score(F.expr(_KEY))["score"].alias("score"))


@query("""SELECT page_id, least(100, CASE WHEN starts_with(lower(url), 'http://') AND NOT regexp_matches(lower(url), '127\\.0\\.0\\.1|localhost|192\\.168\\.|10\\.|172\\.') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '/te?mp/') THEN 25 ELSE 0 END + CASE WHEN length(url) > 300 THEN 15 ELSE 0 END) AS score FROM pages""", log=False)
def ioc_score_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.url_score(F.col("url"))["score"].alias("score"))


@query("""SELECT page_id, name, least(100, CASE WHEN regexp_matches(name, '\\.(xyz|top|tk|ml|ga|cf|gq|pw|cc|ru|cn|su)$') THEN 30 ELSE 0 END + CASE WHEN length(second) >= 6 AND CAST(length(regexp_replace(second, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) AS DOUBLE) / length(regexp_replace(second, '[^a-z]', '', 'g')) > 0.72 THEN 50 ELSE 0 END + CASE WHEN length(second) > 22 THEN 20 ELSE 0 END) AS score
FROM (SELECT page_id, name, string_split(name, '.')[-2] AS second FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:?]+)', 1)) AS name FROM pages))""", log=False)
def ioc_score_domain(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/:?]+)", 1)).alias("name"))
    return pages.select("page_id", "name", I.domain_score(F.col("name"))["score"].alias("score"))


_LIST = "SELECT DISTINCT 'ipv4' AS ioc_type, ip_address AS val, CASE WHEN k % 8 = 3 THEN 'bad' ELSE 'known' END AS verdict FROM security_log WHERE k % 8 IN (3, 5)"


@query(f"SELECT i.val, i.n, CASE WHEN verdict = 'bad' THEN 95 ELSE 0 END AS score, verdict FROM (SELECT ip_address AS val, count(*) AS n FROM security_log GROUP BY 1) i LEFT JOIN ({_LIST}) t ON t.val = i.val")
def threat_match(spark, sf_dir):
    rows = log(spark, sf_dir)
    seen = rows.groupBy(F.lit("ipv4").alias("ioc_type"), F.col("ip_address").alias("val")).agg(F.count("*").alias("n"))
    threats = rows.where("k % 8 in (3, 5)").select(F.lit("ipv4").alias("ioc_type"), F.col("ip_address").alias("val"), F.when(F.expr("k % 8 = 3"), "bad").otherwise("known").alias("verdict")).distinct()
    return I.threat_match(seen.withColumn("score", I.ip_score(F.col("val"))["score"]), threats).select("val", "n", "score", "verdict")


@query("""SELECT a, b, together, CASE WHEN together > 10 THEN 'high' WHEN together >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT x.i AS a, y.i AS b, count(*) AS together FROM ctx x JOIN ctx y ON x.context = y.context AND x.i < y.i GROUP BY 1, 2) ORDER BY together DESC, a, b LIMIT 100""".replace("SELECT a, b, together", ", ctx AS (SELECT DISTINCT concat('processes:', process_name) AS i, concat(computer, user_name) AS context FROM security_log) SELECT a, b, together", 1))
def indicator_cooccurrence(spark, sf_dir):
    rows = log(spark, sf_dir).select(F.lit("processes").alias("ioc_type"), F.col("process_name").alias("val"), F.concat("computer", "user_name").alias("context"))
    return A.cooccurrence(rows)


@query(f"WITH {IOC_SQL} SELECT DISTINCT ioc_type, val, concat('[', CASE ioc_type WHEN 'ipv4' THEN 'ipv4-addr:value' WHEN 'url' THEN 'url:value' WHEN 'domain' THEN 'domain-name:value' WHEN 'md5' THEN 'file:hashes.MD5' WHEN 'sha1' THEN 'file:hashes.''SHA-1''' ELSE 'file:hashes.''SHA-256''' END, ' = ''', val, ''']') AS pattern, 'anomalous-activity' AS indicator_type, 30 AS confidence FROM kept", log=False)
def stix_rows(spark, sf_dir):
    return I.stix_rows(_occurrences(spark, sf_dir).select("ioc_type", "val").distinct().withColumn("score", F.lit(30)))


@query(f"WITH {IOC_SQL} SELECT DISTINCT CASE WHEN ioc_type IN ('ipv4', 'url', 'domain') THEN 'Network activity' ELSE 'Payload delivery' END AS category, CASE ioc_type WHEN 'ipv4' THEN 'ip-dst' ELSE ioc_type END AS attribute, val, length(val) >= 40 AS to_ids FROM kept", log=False)
def misp_rows(spark, sf_dir):
    rows = _occurrences(spark, sf_dir).select("ioc_type", "val").distinct()
    return I.misp_rows(rows.withColumn("score", F.when(F.length("val") >= 40, 80).otherwise(10)))


@query(f"WITH {IOC_SQL} SELECT DISTINCT concat(ioc_type, ':', val) AS line FROM kept", log=False)
def bulk_list(spark, sf_dir):
    return I.bulk_list(_occurrences(spark, sf_dir).select("ioc_type", "val").distinct())


def _branch(kind: str, value: str, where: str) -> str:
    return f"SELECT '{kind}' AS ioc_type, {value} AS val, * EXCLUDE (k) FROM audit WHERE {where}"


def _found(kind: str, found: str, where: str = "true") -> str:
    return f"SELECT '{kind}' AS ioc_type, unnest({found}) AS val, * EXCLUDE (k) FROM audit WHERE {where}"


_NOISE_USER = "('-', '', 'n/a', 'anonymous logon', 'local service', 'network service', 'system', 'window manager', 'font driver host', 'dwm-1', 'dwm-2', 'umfd-0', 'umfd-1')"
_FREE = "left(concat_ws(' ', nullif(subject_user, ''), nullif(target_user, ''), nullif(ip_address, ''), nullif(command_line, ''), nullif(image, ''), nullif(parent_image, ''), nullif(share_name, '')), 4000)"
#: Dotted numbers of four parts up to 255, of the pieces between other characters.
_ADDRESSES = "list_filter(regexp_split_to_array({0}, '[^0-9.]+'), lambda t: len(string_split(t, '.')) = 4 AND len(list_filter(string_split(t, '.'), lambda p: TRY_CAST(p AS INT) BETWEEN 0 AND 255)) = 4)"
_NET = "event_code IN (1, 3, 4624, 4625, 4648, 4688, 4776, 5140, 5145)"
LOG_IOC_SQL = f"""WITH {AUDIT_SQL}, raw AS (
  {_branch("computers", "computer", "lower(computer) NOT IN ('-', '', 'n/a')")}
  UNION ALL {_branch("users", "subject_user", f"lower(subject_user) NOT IN {_NOISE_USER} AND subject_user NOT LIKE '%$'")}
  UNION ALL {_branch("users", "target_user", f"lower(target_user) NOT IN {_NOISE_USER} AND target_user NOT LIKE '%$'")}
  UNION ALL {_found("ipv4", _ADDRESSES.format("ip_address"), "ip_address IS NOT NULL")}
  UNION ALL {_found("ipv4", _ADDRESSES.format(_FREE), _NET)}
  UNION ALL {_branch("ipv6", "ip_address", "ip_address LIKE '%::%'")}
  UNION ALL {_branch("commandlines", "command_line", "event_code IN (1, 4688)")}
  UNION ALL {_branch("processes", "image", "event_code IN (1, 4688)")}
  UNION ALL {_branch("processes", "service_path", "event_code = 7045 AND service_path <> ''")}
  UNION ALL {_branch("filepaths", "target_file", "event_code IN (11, 4663) AND target_file LIKE '%/%'")}
  UNION ALL {_branch("filepaths", "target_object", "event_code = 4663 AND target_object LIKE '%/%'")}
  UNION ALL {_branch("registry", "target_object", "event_code IN (13, 4657, 4663) AND (upper(target_object) LIKE '%HKEY%' OR upper(target_object) LIKE '%/SOFTWARE/%' OR upper(target_object) LIKE '%/SYSTEM/%')")}
  UNION ALL {_branch("md5", "lower(hashes[5:36])", "hashes IS NOT NULL")}
  UNION ALL SELECT 'domains', lower(unnest(regexp_extract_all({_FREE}, '(?i)\\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+(?:com|net|org|io|info|in|top|date)\\b'))), * EXCLUDE (k) FROM audit WHERE {_NET}
  UNION ALL SELECT 'urls', rtrim(unnest(list_filter(regexp_split_to_array(concat_ws(' ', command_line, script_text), '[ ()"]+'), lambda t: starts_with(t, 'http'))), '.,;:)''"'), * EXCLUDE (k) FROM audit WHERE event_code IN (1, 4688, 4104)
  UNION ALL {_branch("named_pipes", "pipe_name", "event_code = 17 AND pipe_name NOT IN ('/lsass', '/wkssvc')")}
  UNION ALL {_branch("services", "service_name", "event_code = 7045")}
  UNION ALL {_branch("tasks", "task_name", "event_code IN (4698, 4702)")}
  UNION ALL {_branch("shares", "share_name", "event_code = 5140 AND lower(share_name) NOT IN ('ipc$', 'admin$', 'sysvol', 'netlogon', 'print$', 'c$', 'd$')")}
  UNION ALL {_branch("dlls", "loaded_image", "event_code = 7 AND lower(loaded_image) LIKE '%.dll' AND lower(loaded_image) NOT LIKE '%/system32/%'")}
), occurrences AS (
  SELECT *, CASE WHEN lower(trim(subject_user)) NOT IN {_NOISE_USER} AND subject_user NOT LIKE '%$' THEN subject_user WHEN lower(trim(target_user)) NOT IN {_NOISE_USER} AND target_user NOT LIKE '%$' THEN target_user ELSE '' END AS user_name,
    regexp_extract(source_file, '[^/]*$') AS source FROM raw WHERE ioc_type <> 'ipv4' OR val NOT IN ('0.0.0.0', '127.0.0.1', '255.255.255.255', '169.254.169.254') AND val NOT LIKE '0.%'
)"""


def _set(column: str, limit: int) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {column}) FILTER (CAST({column} AS VARCHAR) <> ''))[1:{limit}], ',') AS {column}s"


@query(f"{LOG_IOC_SQL} SELECT ioc_type, val, count(*) AS n, min(sec) AS first_s, max(sec) AS last_s, {_set('event_code', 20)}, {_set('record_id', 50000)}, coalesce({_set('user_name', 10).removesuffix(' AS user_names')}, '') AS user_names, {_set('computer', 10)}, {_set('source', 5)} FROM occurrences GROUP BY 1, 2", log=False)
def log_ioc_table(spark, sf_dir):
    """All 18 types of indicators of the audit log, with counts, times and sets."""
    out = I.log_ioc_table(I.log_indicators(spread(audit_log(spark, sf_dir))))
    return out.select(*[F.array_join(c, ",").alias(c) if c.endswith("s") and c[:-1] in I.SET_LIMITS else F.col(c) for c in out.columns])


@query(f"{LOG_IOC_SQL} SELECT ioc_type, count(DISTINCT val) AS vals, count(*) AS n FROM occurrences GROUP BY 1", log=False)
def log_ioc_summary(spark, sf_dir):
    return I.log_indicators(spread(audit_log(spark, sf_dir))).groupBy("ioc_type").agg(F.countDistinct("val").alias("vals"), F.count("*").alias("n"))


@query(f"""{LOG_IOC_SQL}, scored AS (SELECT DISTINCT ioc_type, val, CASE WHEN ioc_type = 'ipv4' THEN CASE WHEN val LIKE '10.%' THEN 0 ELSE 30 END END AS score FROM occurrences WHERE ioc_type IN ('ipv4', 'tasks'))
SELECT ioc_type, val, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY ioc_type ORDER BY coalesce(score, 0) DESC, val) AS place FROM scored""", log=False)
def log_ioc_by_score(spark, sf_dir):
    """Addresses and tasks of the log in order of their score within the type."""
    rows = I.log_indicators(spread(audit_log(spark, sf_dir))).where("ioc_type in ('ipv4', 'tasks')").select("ioc_type", "val").distinct()
    return I.best_per_type(I.scored_indicators(rows)).select("ioc_type", "val", "score", F.col("place").cast("long").alias("place"))
