"""Queries of the attack chains over the audit log, with the thresholds that detections use by default."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import chains as C
from sparklog.operators.ordering import placed
from sparklog.plans.base import ORACLES, QUERIES, query
from sparklog.sources.audit_log import AUDIT_SQL, audit_log, audit_view
from sparklog.sources.files import stored
from sparklog.sources.security_log import spread, table

_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
BUILTIN_SQL = "(u IN ('system', 'local service', 'network service', 'anonymous logon', 'iusr', 'network', 'local system', 'defaultaccount', 'wdagutilityaccount') OR u LIKE 'nt authority\\%' OR u LIKE 'nt service\\%' OR u LIKE '%$')"
#: The audit log with the acting user u and whether it is a person.
ACTING_SQL = f"""{AUDIT_SQL}, named AS (SELECT *, {{'record_id': record_id, 'source_file': source_file}} AS event, lower(coalesce(CASE WHEN trim(subject_user) NOT IN ('', '-') THEN trim(subject_user) END, CASE WHEN trim(target_user) NOT IN ('', '-') THEN trim(target_user) END, '')) AS u FROM audit),
acting AS (SELECT *, u <> '' AND NOT {BUILTIN_SQL} AS person, {BUILTIN_SQL} AS builtin FROM named)"""


def _label(event: str) -> str:
    return f"concat({event}.source_file, '#', {event}.record_id)"


def _summary(ctes: str, rule: str, severity: str, most: int, last: bool = False) -> str:
    """Chains of ``members`` (chain, computer, u, event, sec, host, lead, listed, and severity where that is null)."""
    way, ids = ("DESC" if last else "ASC"), f"string_agg({_label('event')}, ',' ORDER BY sec, event) FILTER (listed AND NOT lead AND place <= {most})"
    shown = f"concat_ws(',', {ids}, {_label('chain')})" if last else f"concat_ws(',', {_label('chain')}, {ids})"
    return f"""WITH RECURSIVE {ACTING_SQL}, {ctes},
placed AS (SELECT *, row_number() OVER (PARTITION BY chain, lead OR NOT listed ORDER BY sec {way}, event {way}) AS place FROM members)
SELECT '{rule}' AS rule, {severity} AS severity, computer, u AS user_name, chain.record_id AS first_id, chain.source_file AS first_file, coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (host <> ''), '') AS hosts,
  min(sec) AS first_s, max(sec) AS last_s, count(*) AS n, {shown} AS shown FROM placed GROUP BY chain, {'severity, ' if severity == 'severity' else ''}computer, u"""


def _burst(rows: str, keys: list[str], seconds: int, least: int, good: str, rule: str, severity: str, computer: str, user: str, most: int, success: str = "") -> str:
    """Greedy bursts by a walk from one good start to the next beyond its window; ``success`` ends a chain."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    names = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    end = f" UNION ALL SELECT g.event, {computer}, {user}, g.win.e, g.win.s, g.computer, false, true FROM walk w JOIN good g ON {same('g', 'w')} AND g.i = w.i" if success else ""
    end = end.replace(f"{computer}, {user}", names("g")) if success else end
    return _summary(f"""own AS ({rows}), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY sec, event) AS i FROM own
), reach AS (
  SELECT a.*, (SELECT max(b.i) FROM numbered b WHERE {same('b', 'a')} AND b.sec BETWEEN a.sec AND a.sec + {seconds}) AS hi,
    (SELECT max(b.sec) FROM numbered b WHERE {same('b', 'a')} AND b.sec BETWEEN a.sec AND a.sec + {seconds}) AS last_s FROM numbered a
), won AS (SELECT a.*, {success or 'NULL'} AS win FROM reach a
), good AS (SELECT * FROM won a WHERE hi - i + 1 >= {least} AND {good}
), walk AS (
  SELECT {', '.join(keys)}, min(i) AS i FROM good GROUP BY ALL
  UNION ALL
  SELECT {names('w')}, (SELECT min(g.i) FROM good g WHERE {same('g', 'w')} AND g.i > (SELECT h.hi FROM good h WHERE {same('h', 'w')} AND h.i = w.i)) FROM walk w WHERE w.i IS NOT NULL
), members AS (SELECT g.event AS chain, {computer} AS computer, {user} AS u, r.event, r.sec, r.host, r.i = g.i AS lead, true AS listed
  FROM walk w JOIN good g ON {same('g', 'w')} AND g.i = w.i JOIN numbered r ON {same('r', 'w')} AND r.i BETWEEN g.i AND g.hi{end})""", rule, f"'{severity}'", most)


def _pairs(first: str, then: str, on: str, rule: str, severity: str, most: int, back: bool = False, odd: str | None = None) -> str:
    lead, other = ("b", "a") if back else ("a", "b")
    kept = "WHERE odd OR NOT any_odd" if odd else ""
    return _summary(f"""a AS (SELECT * FROM acting WHERE {first}), b AS (SELECT * FROM acting WHERE {then}),
pairs AS (SELECT {lead}.event AS chain, {lead}.computer, {lead}.u, {lead}.sec AS chain_s, {other}.event, {other}.sec, {other}.computer AS host, {odd or 'true'} AS odd, bool_or({odd or 'true'}) OVER (PARTITION BY {lead}.event) AS any_odd FROM a JOIN b ON {on}),
members AS (SELECT chain, computer, u, event, sec, host, false AS lead, true AS listed FROM pairs {kept} UNION ALL SELECT DISTINCT chain, computer, u, chain, chain_s, computer, true, true FROM pairs)""", rule, f"'{severity}'", most, back)


def _session(logon: str, counts: str, others: str, rule: str, severity: str, most: int) -> str:
    return _summary(f"""last_logon AS (
  SELECT computer, lower(logon_id) AS l, max_by(event, (sec, event)) AS id FROM acting WHERE event_code = 4624 GROUP BY ALL
), own AS (SELECT a.*, l FROM acting a JOIN last_logon o ON a.event = o.id WHERE {logon}),
others AS (SELECT o.event AS chain, o.computer, o.u, o.sec AS chain_s, a.event, a.sec, a.computer AS host, {counts} AS listed, bool_or({counts}) OVER (PARTITION BY o.event) AS any_hit FROM own o JOIN acting a ON a.computer = o.computer AND lower(a.logon_id) = o.l AND {others}),
members AS (SELECT chain, computer, u, event, sec, host, false AS lead, listed FROM others WHERE any_hit UNION ALL SELECT DISTINCT chain, computer, u, chain, chain_s, computer, true, true FROM others WHERE any_hit)""", rule, f"'{severity}'", most)


_REMOTE = "coalesce(trim(ip_address), '') NOT IN ('', '-', '127.0.0.1', '::1', '::ffff:127.0.0.1')"
_HOST = "a.computer = b.computer AND b.sec BETWEEN a.sec AND a.sec + "
_DANGER = "regexp_matches(coalesce({0}privileges, ''), 'SeTcbPrivilege|SeDebugPrivilege|SeImpersonatePrivilege|SeAssignPrimaryTokenPrivilege|SeLoadDriverPrivilege|SeRestorePrivilege|SeTakeOwnershipPrivilege')"
_ODD_SERVICE = "coalesce(regexp_matches(p, '/(temp|tmp|appdata|programdata|users|desktop|downloads)/|/recycle') AND NOT regexp_matches(p, '^c:/(windows|program files|program files \\(x86\\))/'), false)".replace("p,", "replace(replace(replace(lower(b.service_path), '%systemroot%', 'c:/windows'), '%windir%', 'c:/windows'), '%programfiles%', 'c:/program files'),")

SQL = {
    "brute_force": _burst("SELECT computer, u, sec, event, computer AS host FROM acting WHERE event_code = 4625 AND person AND lower(coalesce(sub_status, '')) IN ('', '0xc000006a', '0xc000006d', '0xc0000022')", ["computer", "u"], 300, 5, "win IS NOT NULL", "brute_force", "high", "r.computer", "r.u", 10, success="(SELECT min({'s': s.sec, 'e': s.event}) FROM acting s WHERE s.event_code = 4624 AND s.person AND s.computer = a.computer AND s.u = a.u AND s.sec BETWEEN a.last_s AND a.last_s + 120)"),
    "service_after_logon": _pairs(f"event_code = 4624 AND logon_type = '3' AND {_REMOTE}", "event_code IN (7045, 4697)", _HOST + "120", "service_after_logon", "high", 3, odd=_ODD_SERVICE),
    "privilege_after_logon": _pairs("event_code = 4624 AND person AND logon_type NOT IN ('4', '5')", f"event_code = 4672 AND person AND {_DANGER.format('')}", _HOST + "30 AND a.u = b.u", "privilege_after_logon", "high", 2),
    "weak_tickets": _burst("SELECT computer, sec, event, computer AS host FROM acting WHERE event_code = 4769 AND NOT builtin AND lower(ticket_cipher) IN ('0x17', '23', 'rc4') AND ticket_service NOT LIKE '%$' AND lower(ticket_service) NOT IN ('', 'krbtgt', 'krbtgt/', 'kadmin/changepw')", ["computer"], 300, 3, "true", "weak_tickets", "high", "r.computer", "''", 10),
    "pass_the_hash": _summary(f"members AS (SELECT event AS chain, computer, u, event, sec, computer AS host, true AS lead, true AS listed FROM acting WHERE event_code = 4624 AND logon_type = '3' AND lower(auth_package) LIKE '%ntlm%' AND person AND {_REMOTE} AND coalesce(key_length, '') IN ('', '0') AND (coalesce(lm_package, '') = '' OR lower(lm_package) LIKE '%ntlm%'))", "pass_the_hash", "'high'", 0),
    "log_clearing": _pairs("lower(channel) = 'security' AND event_code NOT IN (1102, 517, 4719)", "lower(channel) = 'security' AND event_code IN (1102, 517, 4719)", _HOST + "1800 AND a.sec < b.sec", "log_clearing", "critical", 5, back=True),
    "task_after_logon": _pairs("event_code = 4624 AND person AND logon_type NOT IN ('4', '5')", "event_code IN (4698, 4702)", _HOST + "300", "task_after_logon", "medium", 2),
    "account_after_recon": _pairs("event_code IN (4798, 4799)", "event_code = 4720", _HOST + "600 AND (a.u = '' OR a.u = b.u)", "account_after_recon", "medium", 2),
    "password_spray": _burst("SELECT computer, sec, event, u, computer AS host FROM acting WHERE event_code = 4625 AND logon_type <> '2' AND NOT builtin", ["computer"], 300, 8, "(SELECT count(DISTINCT d.u) FROM numbered d WHERE d.computer = a.computer AND d.sec BETWEEN a.sec AND a.sec + 300) >= 4", "password_spray", "high", "r.computer", "''", 9),
    "script_after_shell": _pairs("event_code = 4688 AND regexp_matches(lower(image), 'powershell|cmd') AND regexp_matches(lower(parent_image), 'wmiprvse|wscript|mshta|svchost|dllhost|winword|excel|outlook|msiexec')", "event_code = 4104", _HOST + "60", "script_after_shell", "high", 2),
    "session_privileges": _session("person AND logon_type NOT IN ('4', '5')", "true", f"a.event_code = 4672 AND {_DANGER.format('a.')}", "session_privileges", "high", 2),
    "session_processes": _session("person AND logon_type = '3'", "regexp_extract(lower(a.image), '[^/]*$') NOT IN ('conhost.exe', 'dllhost.exe', 'svchost.exe', 'msiexec.exe', 'winlogon.exe')", "a.event_code = 4688", "session_processes", "medium", 3),
    "many_hosts": _burst("SELECT u, sec, event, computer AS host FROM acting WHERE event_code = 4624 AND logon_type IN ('3', '8', '9', '10') AND person", ["u"], 1800, 1, "(SELECT count(DISTINCT d.host) FROM numbered d WHERE d.u = a.u AND d.sec BETWEEN a.sec AND a.sec + 1800) >= 3", "many_hosts", "high", "''", "r.u", 9),
}

_SPAWNS = ", ".join(f"('{r}', '{k}')" for r, kids in C.ODD_SPAWNS.items() for k in kids)
SQL["process_trees"] = _summary(f"""rows AS (
  SELECT *, lower(process_guid) AS g, lower(parent_guid) AS p, lower(image) AS path, regexp_extract(lower(image), '[^/]*$') AS base FROM acting WHERE event_code IN (1, 4688) AND process_guid NOT IN ('', '{C.NO_GUID}')
), starts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY computer, g ORDER BY sec, event) AS v FROM rows) WHERE v = 1
), edges AS (SELECT * FROM rows WHERE p NOT IN ('', '{C.NO_GUID}') AND p <> g
), tree AS (
  SELECT r.computer, r.g AS root, c.g AS child, c.event, 1 AS d FROM starts r JOIN edges c ON c.computer = r.computer AND c.p = r.g
  UNION SELECT t.computer, t.root, c.g, c.event, t.d + 1 FROM tree t JOIN edges c ON c.computer = t.computer AND c.p = t.child AND c.g <> t.root WHERE t.d < 5
), below AS (SELECT DISTINCT computer, root, child, event FROM tree), weighed AS (
  SELECT r.computer, r.g, r.event AS chain, r.sec AS chain_s, r.u, c.g AS cg, c.event, c.sec,
    CASE WHEN (r.base, c.base) IN (VALUES {_SPAWNS}) THEN 4 WHEN c.base IN ('certutil.exe', 'mshta.exe') THEN 3 WHEN regexp_matches(c.path, '/users/public/|/programdata/|/windows/temp/|/appdata/local/temp') THEN 2 ELSE 0 END AS w
  FROM below b JOIN starts r ON r.computer = b.computer AND r.g = b.root JOIN rows c ON c.event = b.event
), found AS (SELECT *, max(w) OVER (PARTITION BY computer, g) AS top FROM weighed
), outer_trees AS (SELECT *, CASE top WHEN 4 THEN 'critical' WHEN 3 THEN 'high' ELSE 'medium' END AS severity FROM found f WHERE top > 0 AND NOT EXISTS (SELECT 1 FROM found o WHERE o.top > 0 AND o.computer = f.computer AND o.cg = f.g)
), members AS (SELECT chain, severity, computer, u, event, sec, computer AS host, false AS lead, true AS listed FROM outer_trees UNION ALL SELECT DISTINCT chain, severity, computer, u, chain, chain_s, computer, true, true FROM outer_trees)""", "process_trees", "severity", 19)


def _flat(chains):
    """Keys of events as columns and texts."""
    label = lambda e: F.concat_ws("#", e["source_file"], e["record_id"])
    out = chains.withColumns({"first_id": F.col("first_event.record_id"), "first_file": F.col("first_event.source_file"), "hosts": F.array_join("hosts", ",")})
    return out.withColumn("shown", F.array_join(F.transform("shown", label), ",")).drop("first_event")


def _register(name: str, rule) -> None:
    def run(spark, sf_dir):
        parameters = {"least": 8, "seconds": 300, "users": 4} if name == "password_spray" else {}
        return _flat(rule(audit_log(spark, sf_dir), **parameters))

    run.__name__ = f"rule_{name}"
    run.__doc__ = rule.__doc__
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = SQL[name]


for _rule in [*C.RULES, C.privilege_after_logon]:
    _register(_rule.__name__, _rule)


_COLUMNS = "rule, severity, computer, user_name, first_id, first_file, hosts, first_s, last_s, n, shown"


def _inner(sql: str, name: str) -> str:
    """A rule's SQL as a table expression of its own; the spray with its default thresholds."""
    if name == "password_spray":
        sql = sql.replace("+ 300", "+ 60").replace(">= 8", ">= 20").replace(">= 4", ">= 5")
    return f"SELECT {_COLUMNS} FROM ({sql})"


_DETECTED = "SELECT 'detected ' || event_code AS rule, 'low' AS severity, computer, '' AS user_name, record_id AS first_id, source_file AS first_file, computer AS hosts, sec AS first_s, sec AS last_s, CAST(1 AS BIGINT) AS n, concat(source_file, '#', record_id) AS shown"
_ALL = f"""WITH every_chain AS ({' UNION ALL '.join(_inner(SQL[r.__name__], r.__name__) for r in C.RULES)}
  UNION ALL SELECT * FROM (WITH {AUDIT_SQL} {_DETECTED} FROM audit WHERE event_code = 17)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, hosts, first_s // 60 ORDER BY first_s, first_id, first_file) AS p FROM every_chain) WHERE p = 1)"""


def _all(spark, sf_dir):
    """Chains of all rules by default thresholds, and detections of another tool (here: named pipes).

    The log is read dozens of times, and stored, as the view's fields cost more to make than to read.
    """
    log = stored(audit_view(spread(table(spark, sf_dir, "events"))), "audit-log")
    pipes = C.with_event(log.where("event_code = 17")).select(F.concat(F.lit("detected "), "event_code").alias("rule"), F.lit("low").alias("severity"), "computer", F.lit("").alias("user_name"), F.col("event").alias("first_event"), F.array("computer").alias("hosts"), F.col("sec").alias("first_s"), F.col("sec").alias("last_s"), F.lit(1).cast("long").alias("n"), F.array("event").alias("shown"))
    return C.all_chains(log, pipes)


@query(f"{_ALL} SELECT {_COLUMNS} FROM kept", log=False)
def rule_chains(spark, sf_dir):
    """Chains of all sources, one per rule, hosts and minute."""
    return _flat(_all(spark, sf_dir))


@query(f"""{_ALL} SELECT rule, first_id, first_file, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, first_s, rule, first_id, first_file) AS place FROM kept""", log=False)
def chains_ranked(spark, sf_dir):
    """The same with their place: the worst first, then the earliest."""
    order = [C.severity_rank(F.col("severity")).desc(), F.col("first_s"), F.col("rule"), F.col("first_event")]
    return _flat(placed(_all(spark, sf_dir), order)).select("rule", "first_id", "first_file", "severity", "place")


def _members_sql(name: str) -> str:
    return f"{SQL[name].partition('placed AS (')[0].rstrip().removesuffix(',')} SELECT chain.record_id AS first_id, chain.source_file AS first_file, event.record_id, event.source_file, sec, host, lead FROM members"


def _register_members(name: str) -> None:
    def run(spark, sf_dir):
        out = getattr(C, name).members(audit_log(spark, sf_dir))
        return out.select(F.col("chain.record_id").alias("first_id"), F.col("chain.source_file").alias("first_file"), "event.record_id", "event.source_file", "sec", "host", "lead")

    run.__name__ = f"members_{name}"
    run.__doc__ = f"Every event of every chain of {name}."
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = _members_sql(name)


for _name in ("brute_force", "log_clearing", "many_hosts", "session_processes", "process_trees"):
    _register_members(_name)
