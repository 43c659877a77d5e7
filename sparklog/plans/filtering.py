"""Queries of projections, filters, sorts and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparklog.functions import scalars as S
from sparklog.operators import predicates as P
from sparklog.operators.ordering import SORTABLE, mixed_order, placed, sort_order
from sparklog.plans.base import query
from sparklog.sources.security_log import security_log as log
from sparklog.sources.security_log import table


@query("SELECT record_id, sec, source_file, event_code, level, computer, user_name, ip_address, logon_type, logon_id, pid, ppid, process_name, parent_name FROM security_log")
def security_log(spark, sf_dir):
    return log(spark, sf_dir).drop("ts", "value", "k")


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS val FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL", log=False)
def json_flat_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return events.select("event_id", F.explode("m").alias("name", "val"))


@query("SELECT record_id, lower(concat_ws(' ', record_id, event_code, source_file, computer, user_name, ip_address, process_name, parent_name)) AS blob FROM security_log")
def search_blob(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", F.lower(P.search_blob(P.COLUMNS["search"])).alias("blob"))


@query("SELECT record_id, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') AS local_day, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%H') AS local_hour FROM security_log")
def local_day(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("string"), "Europe/Berlin")
    return log(spark, sf_dir).select("record_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), F.date_format(local, "HH").alias("local_hour"))


_COMMAND = "concat(process_name, ' /c C:\\\\Users\\\\', user_name, '\\\\run.bat --host ', ip_address, ' -v 1.', logon_type, ' {0f3c', right(concat('0000', pid), 4), '-1111-2222-3333-444455556666}')"


@query(f"""SELECT record_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cmd, '\\{{?[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\\}}?', '<GUID>', 'g'),
  '([a-zA-Z]:\\\\[Uu]sers\\\\)[^\\\\ ]+', '\\1<USER>', 'g'), '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b', '<IP>', 'g'), '\\b\\d+(\\.\\d+){{1,3}}\\b', '<VER>', 'g')) AS template
FROM (SELECT record_id, {_COMMAND.replace(chr(92) * 2, chr(92))} AS cmd FROM security_log WHERE event_code = 4688)""")
def command_template(spark, sf_dir):
    rows = log(spark, sf_dir).where("event_code = 4688").select("record_id", F.expr(_COMMAND).alias("cmd"))
    return rows.select("record_id", S.masked_command(F.col("cmd")).alias("template"))


@query("SELECT record_id, sec, computer, pid, ppid, lower(process_name) AS process, lower(parent_name) AS parent, lower(user_name) AS actor FROM security_log WHERE event_code = 4688")
def process_event(spark, sf_dir):
    return log(spark, sf_dir).where("event_code = 4688").select("record_id", "sec", "computer", "pid", "ppid", S.basename(F.col("process_name")).alias("process"), S.basename(F.col("parent_name")).alias("parent"), S.picked_user(F.col("user_name")).alias("actor"))


@query("SELECT level, CASE level WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' ELSE 'Information' END AS name, count(*) AS n FROM security_log GROUP BY 1, 2")
def level_names(spark, sf_dir):
    from sparklog.sources.security_log import level_name

    return log(spark, sf_dir).groupBy("level", level_name(F.col("level")).alias("name")).agg(F.count("*").alias("n"))


def _filter(name: str, settings: dict, where: str):
    def run(spark, sf_dir):
        return log(spark, sf_dir).where(P.filter_predicate(settings)).select("record_id", "event_code", "computer", "user_name")

    run.__name__ = name
    run.__doc__ = f"Records that pass {settings}."
    query(f"SELECT record_id, event_code, computer, user_name FROM security_log WHERE {where}")(run)


_BLOB = "lower(concat_ws(' ', record_id, event_code, source_file, computer, user_name, ip_address, process_name, parent_name))"
_filter("filter_ids", {"ids": [4624, 4688], "exclude_ids": [4688]}, "event_code IN (4624, 4688) AND event_code <> 4688")
_filter("filter_id_ranges", {"id_expression": "4620-4690,4720!4625,4680-4689"}, "(event_code BETWEEN 4620 AND 4690 OR event_code = 4720) AND event_code <> 4625 AND event_code NOT BETWEEN 4680 AND 4689")
_filter("filter_id_ranges_inverted", {"id_expression": "4620-4690!4625", "id_invert": True}, "NOT (event_code BETWEEN 4620 AND 4690 AND event_code <> 4625)")
_filter("filter_levels", {"levels": ["error", "3"]}, "level IN (2, 3)")
_filter("filter_substring", {"users": ["user1"], "computers": ["host1", "host2"]}, "contains(lower(user_name), 'user1') AND (contains(lower(computer), 'host1') OR contains(lower(computer), 'host2'))")
_filter("filter_substring_exclude", {"users": ["user1"], "exclude_users": True}, "NOT contains(lower(coalesce(user_name, '')), 'user1')")
_filter("filter_sources", {"sources": ["log_1"], "exclude_sources": False}, "contains(lower(source_file), 'log_1')")
_filter("filter_window_range", {"window": {"from": "2024-01-05 06:00:00", "to": "2024-01-09 18:30:00"}}, "date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'")
_filter("filter_window_date_only", {"window": {"mode": "date", "from": "2024-01-05", "to": "2024-01-06"}}, "CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
_filter("filter_window_time_only", {"window": {"mode": "time", "from": "22:00:00", "to": "03:59:59"}}, "(strftime(ts, '%H:%M:%S') >= '22:00:00' OR strftime(ts, '%H:%M:%S') <= '03:59:59')")
_filter("filter_window_separate", {"window": {"mode": "separate", "date_from": "2024-01-03", "date_to": "2024-01-20", "time_from": "08:00:00", "time_to": "17:00:00"}}, "CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '17:00:00'")
_filter("filter_window_exclude", {"window": {"from": "2024-01-05 06:00:00", "to": "2024-01-09 18:30:00", "exclude": True}}, "NOT (date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00')")
_filter("filter_relative", {"relative": {"hours": 48, "as_of": datetime(2024, 1, 20)}}, "ts >= TIMESTAMP '2024-01-18 00:00:00'")
_filter("filter_text_and", {"search": {"terms": ["HOST1", "powershell"], "mode": "AND"}}, f"contains({_BLOB}, 'host1') AND contains({_BLOB}, 'powershell')")
_filter("filter_text_or", {"search": {"terms": ["host3", "rundll32"], "mode": "OR"}}, f"(contains({_BLOB}, 'host3') OR contains({_BLOB}, 'rundll32'))")
_filter("filter_text_not", {"search": {"terms": ["host3", "cmd.exe"], "mode": "NOT"}}, f"NOT (contains({_BLOB}, 'host3') OR contains({_BLOB}, 'cmd.exe'))")
_filter("filter_text_regex", {"search": {"terms": ["host[1-3] user\\d+1\\b"], "regex": True}}, f"regexp_matches({_BLOB}, 'host[1-3] user\\d+1\\b')")
_filter("filter_conditions", {"conditions": [{"field": "process_name", "operator": "starts with", "value": "SVCH"}, {"field": "user_name", "operator": "not equals", "value": "user5"}, {"field": "pid", "operator": "greater than", "value": "110"}]}, "starts_with(process_name, 'svch') AND user_name <> 'user5' AND pid > 110")
_filter("filter_condition_regex", {"conditions": [{"field": "ip_address", "operator": "regex", "value": "^10\\.[01]\\.\\d\\."}, {"field": "process_name", "operator": "ends with", "value": "L.EXE"}]}, "regexp_matches(ip_address, '^10\\.[01]\\.\\d\\.') AND ends_with(process_name, 'l.exe')")
_filter("filter_hex_decimal", {"conditions": [{"field": "logon_id", "operator": "equals", "value": "513", "expand": True}, {"field": "logon_type", "operator": "equals", "value": "network", "expand": True}]}, "logon_id = '0x201' AND logon_type = '3'")
_filter("filter_layers", {"ids": [4624, 4625, 4688], "levels": ["information", "error"], "computers": ["host"], "window": {"mode": "date", "from": "2024-01-02", "to": "2024-01-25"}, "conditions": [{"field": "logon_type", "operator": "not equals", "value": "5"}], "search": {"terms": ["exe"], "mode": "AND"}}, f"event_code IN (4624, 4625, 4688) AND level IN (2, 4) AND contains(lower(computer), 'host') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-25' AND logon_type <> '5' AND contains({_BLOB}, 'exe')")
_filter("filter_profiles", P.profile_filter({"ids": [4624, 4625]}, [{"event_ids": [4625, 4688]}, {"event_ids": [4624], "users": ["user2"]}]), "event_code IN (4624, 4625) AND contains(lower(user_name), 'user2')")
_filter("filter_preset_failed_logons", P.PRESETS["failed_logons"], "event_code = 4625")


@query("SELECT record_id FROM security_log WHERE (CAST(concat('0x8', CASE event_code WHEN 4625 THEN '010' ELSE '020' END, '000000000000') AS UHUGEINT) >> 52) & 1 = 1")
def filter_audit_bits(spark, sf_dir):
    keywords = F.concat(F.lit("0x8"), F.when(F.col("event_code") == 4625, "010").otherwise("020"), F.lit("000000000000"))
    return log(spark, sf_dir).where(P.audit(keywords, "audit failure")).select("record_id")


@query("SELECT record_id FROM security_log WHERE (contains(CAST(pid AS VARCHAR), '11') OR contains(CAST(ppid AS VARCHAR), '11'))")
def filter_dual_source(spark, sf_dir):
    return log(spark, sf_dir).where(P.dual_condition([F.col("pid"), F.col("ppid")], "contains", "11")).select("record_id")


@query("SELECT record_id FROM security_log WHERE computer IN ('HOST1', 'HOST2') AND (process_name IS NULL OR process_name NOT IN ('cmd.exe', 'conhost.exe'))")
def quick_filter(spark, sf_dir):
    return log(spark, sf_dir).where(P.quick_filter({"computer": ["HOST1", "HOST2"]}, {"process_name": ["cmd.exe", "conhost.exe"]})).select("record_id")


@query("SELECT record_id, user_name FROM security_log WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 90 MINUTE AND TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 30 MINUTE")
def timeline_window(spark, sf_dir):
    span = F.col("ts").between(F.lit(datetime(2024, 1, 10, 10, 30)).cast("timestamp_ntz"), F.lit(datetime(2024, 1, 10, 12, 30)).cast("timestamp_ntz"))
    return log(spark, sf_dir).where(span).select("record_id", "user_name")


@query("SELECT record_id FROM security_log WHERE event_code = 4688 AND (ends_with(process_name, 'shell.exe') OR ends_with(process_name, 'cmd.exe')) AND contains(parent_name, 'winword') AND NOT (computer = 'HOST1' AND starts_with(user_name, 'user1'))")
def rule_predicate(spark, sf_dir):
    hit = P.rule({"event_code": 4688, "process_name|endswith_any": ["shell.exe", "CMD.exe"], "parent_name|contains": "winword"}, [{"computer": "HOST1", "user_name|startswith": "user1"}])
    return log(spark, sf_dir).where(hit).select("record_id")


@query("SELECT row_number() OVER (ORDER BY ts DESC, record_id DESC) AS place, record_id FROM security_log ORDER BY ts DESC, record_id DESC LIMIT 200")
def timeline_sort(spark, sf_dir):
    """The 200 latest records in order; the limit is the report's."""
    from pyspark.sql import Window as W

    top = log(spark, sf_dir).select("ts", "record_id").orderBy(F.desc("ts"), F.desc("record_id")).limit(200)
    return top.select(F.row_number().over(W.orderBy(F.desc("ts"), F.desc("record_id"))).cast("long").alias("place"), "record_id")


@query("SELECT v, CAST(dense_rank() OVER (ORDER BY TRY_CAST(v AS DOUBLE) NULLS LAST, lower(v), v) AS BIGINT) AS place FROM (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN process_name ELSE CAST(pid AS VARCHAR) END AS v FROM security_log)")
def mixed_sort(spark, sf_dir):
    """Distinct values of a mixed column, numbers first; as many as there are values of it."""
    v = log(spark, sf_dir).select(F.when(F.col("k") % 3 == 0, F.col("process_name")).otherwise(F.col("pid").cast("string")).alias("v")).distinct()
    return placed(v, mixed_order(F.col("v")))


def _sorted_query(name: str, descending: bool) -> None:
    column, way = SORTABLE[name], "DESC" if descending else "ASC"

    def run(spark, sf_dir):
        rows = log(spark, sf_dir).select("ts", "record_id", "source_file", *{column} - {"ts", "record_id", "source_file"})
        return placed(rows, sort_order(rows, name, descending)).select("place", "record_id")

    run.__name__ = f"sort_{name}"
    run.__doc__ = f"The place of every record by {name}."
    query(f"SELECT row_number() OVER (ORDER BY {column} {way} NULLS LAST, ts, record_id, source_file) AS place, record_id FROM security_log")(run)


for _name, _descending in (("timestamp", True), ("event_id", False), ("computer", True), ("user", False), ("process_id", True)):
    _sorted_query(_name, _descending)


@query("""SELECT process_name, round(coalesce(-list_sum([x.c / n * log2(x.c / n) FOR x IN hist]), 0), 6) AS bits FROM (
  SELECT process_name, CAST(length(process_name) AS DOUBLE) AS n, [{'c': CAST(length(process_name) - length(replace(process_name, ch, '')) AS DOUBLE)} FOR ch IN list_distinct(string_split(process_name, ''))] AS hist
  FROM (SELECT DISTINCT process_name FROM security_log))""")
def entropy(spark, sf_dir):
    return log(spark, sf_dir).select("process_name").distinct().select("process_name", F.round(S.entropy(F.col("process_name")), 6).alias("bits"))


@query("SELECT DISTINCT process_name, 'svchost.exe' AS like_name FROM security_log WHERE process_name <> 'svchost.exe' AND levenshtein(process_name, 'svchost.exe') <= 2")
def edit_distance(spark, sf_dir):
    names = log(spark, sf_dir).select("process_name").distinct()
    return names.select("process_name", S.near_name(F.col("process_name"), ["svchost.exe", "lsass.exe", "services.exe"]).alias("like_name")).where("like_name is not null")


@query("SELECT record_id, concat_ws(',', CASE WHEN pid & 1 <> 0 THEN 'read' END, CASE WHEN pid & 4 <> 0 THEN 'write' END, CASE WHEN pid & 32 <> 0 THEN 'delete' END) AS rights FROM security_log")
def bit_flags(spark, sf_dir):
    labels = {1: "read", 4: "write", 32: "delete"}
    return log(spark, sf_dir).select("record_id", F.array_join(S.bit_labels(F.col("pid"), labels), ",").alias("rights"))


@query("SELECT record_id, concat('0x', lower(to_hex(pid))) AS pid_hex, logon_id AS id_hex FROM security_log")
def hex_normalise(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", S.hex_normal(F.col("pid").cast("string")).alias("pid_hex"), S.hex_normal(F.concat(F.lit("0X00"), F.substring("logon_id", 3, 20))).alias("id_hex"))


@query("""SELECT record_id, CASE WHEN s < 0 THEN '00:00:00' ELSE printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) END AS took FROM (SELECT record_id, CAST(pid * 97 - 11000 AS BIGINT) AS s FROM security_log)""")
def duration_text(spark, sf_dir):
    return log(spark, sf_dir).select("record_id", S.duration(F.col("pid") * 97 - 11000).alias("took"))


@query("SELECT process_name, round(CAST(length(regexp_replace(process_name, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) AS DOUBLE) / length(regexp_replace(process_name, '[^a-z]', '', 'g')), 6) AS consonants, round(CAST(length(regexp_replace(process_name, '[^0-9]', '', 'g')) AS DOUBLE) / length(process_name), 6) AS digits FROM (SELECT DISTINCT process_name FROM security_log)")
def letter_ratios(spark, sf_dir):
    names = log(spark, sf_dir).select("process_name").distinct()
    return names.select("process_name", F.round(S.consonant_ratio(F.col("process_name")), 6).alias("consonants"), F.round(S.digit_ratio(F.col("process_name")), 6).alias("digits"))


@query()
def decode_encoded_command(spark, sf_dir):
    """Encoded commands made of the log's own names, decoded again; ``same`` tells whether the text came back."""
    plain = F.concat_ws(" ", "process_name", "user_name")
    command = F.concat(F.lit("powershell -enc "), F.base64(F.encode(plain, "UTF-16LE")))
    return log(spark, sf_dir).select("record_id", S.decode_encoded_command(command).alias("decoded"), (S.decode_encoded_command(command) == plain).alias("same"))


@query("SELECT record_id, concat(computer, ';', user_name) AS fields FROM security_log")
def key_value_lines(spark, sf_dir):
    lines = F.concat(F.lit("Host = "), F.col("computer"), F.lit("\nnoise\n User= "), F.col("user_name"))
    m = S.key_values(lines)
    return log(spark, sf_dir).select("record_id", F.concat_ws(";", m["Host"], m["User"]).alias("fields"))


@query("SELECT record_id, lower(user_name) AS actor, (ends_with(user_name, '7$')) AS machine FROM (SELECT record_id, CASE WHEN k % 4 = 0 THEN concat(user_name, '7$') ELSE user_name END AS user_name FROM security_log)")
def user_pick(spark, sf_dir):
    user = F.when(F.col("k") % 4 == 0, F.concat("user_name", F.lit("7$"))).otherwise(F.col("user_name"))
    return log(spark, sf_dir).select("record_id", S.picked_user(F.lit("-"), user).alias("actor"), S.system_account(user).alias("machine"))


@query("SELECT record_id, concat('<u>', replace(replace(concat('a&', user_name, '<x>'), '&', '&amp;'), '<', '&lt;')) AS xml FROM (SELECT record_id, user_name FROM security_log WHERE level = 2)")
def xml_escape(spark, sf_dir):
    escaped = F.replace(S.xml_text(F.concat(F.lit("a&"), F.col("user_name"), F.lit("<x>"))), F.lit("&gt;"), F.lit(">"))
    return log(spark, sf_dir).where("level = 2").select("record_id", F.concat(F.lit("<u>"), escaped).alias("xml"))
