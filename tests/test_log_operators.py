"""Hand-made cases of the log operators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparklog import registry
from sparklog.functions import scalars as S
from sparklog.operators import baseline as B
from sparklog.operators import predicates as P
from sparklog.operators import scripts, sequences
from sparklog.sources import files
from sparklog.sources.security_log import flat_fields, ingest_json, observed, security_log
from sparklog.streaming import jobs


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_three_payload_shapes(spark):
    shapes = [
        json.dumps({"Data": [{"#attributes": {"Name": "A"}, "#text": "1"}, {"#attributes": {"Name": "B"}, "#text": "2"}, {"#attributes": {"Name": "A"}, "#text": "3"}]}),
        json.dumps({"Data": {"A": "3", "B": "2", "#attributes": "x"}}),
        json.dumps({"A": "3", "B": "2", "@x": "y"}),
    ]
    df = rows(spark, [(s,) for s in shapes], "p string").select(flat_fields(F.col("p")).alias("m"))
    assert [r.m for r in df.collect()] == [{"A": "3", "B": "2"}] * 3


def test_ingest_keeps_malformed_and_big_numbers(spark):
    good = json.dumps({"System": {"EventID": {"#text": 4624}, "EventRecordID": 7, "TimeCreated": {"SystemTime": "2024-01-01T10:00:00.123Z"}}, "EventData": {"Big": 18446744073709551615}})
    got = {r.status: r for r in ingest_json(rows(spark, [(good, "a"), ("{broken", "a"), (None, "b")], "json string, source_file string")).collect()}
    assert got["ok"].event_code == 4624 and got["ok"].fields["Big"] == "18446744073709551615" and got["ok"].level == 4
    assert got["ok"].ts == datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert got["malformed"].record_id is None


def test_ingest_of_containers_and_attributes(spark):
    record = {
        "Event": {
            "System": {"EventID": {"#attributes": {"Qualifiers": "16384"}, "#text": "1102"}, "Provider": {"#attributes": {"Name": "P", "EventSourceName": "S"}}, "Execution": {"#attributes": {"ProcessID": 4, "ThreadID": 8}}, "Security": {"#attributes": {"UserID": "S-1"}}, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T10:00:00Z"}}, "EventRecordID": "9"},
            "UserData": {"LogFileCleared": {"#text": "own", "@x": "no", "SubjectUserName": "eve", "Inner": {"Deep": {"A": 1}}, "B": [1, 2]}, "SubjectUserName": "bob"},
        }
    }
    mixed = {"System": {"EventID": 1, "Provider": "plain"}, "EventData": {"Data": [{"#attributes": {"Name": "X"}, "#text": "1"}, {"#text": "unnamed"}], "Y": "2"}}
    got = ingest_json(rows(spark, [(json.dumps(record), "a"), (json.dumps(mixed), "a")], "json string, source_file string"), keep=F.col("event_code") == 1102).collect()
    a, b = sorted(got, key=lambda r: -r.event_code)
    assert (a.event_code, a.qualifiers, a.provider, a.event_source_name, a.process_id, a.thread_id, a.user_id, a.record_id, a.status) == (1102, 16384, "P", "S", 4, 8, "S-1", 9, "ok")
    assert a.fields == {"LogFileCleared": "own", "A": "1", "B": "[1,2]", "SubjectUserName": "bob"} and a.subject_user == "bob" and a.target_user == ""
    assert (b.fields, b.provider, b.status, b.level) == ({"X": "1", "Y": "2"}, "plain", "filtered", 4)


def test_ingest_counts_in_the_same_scan(spark):
    texts = [json.dumps({"System": {"EventID": i % 3, "EventRecordID": i}}) for i in range(9)] + ["{", None, "[1]"]
    found, counts = observed(ingest_json(rows(spark, [(t, "f") for t in texts], "json string, source_file string"), keep=F.col("event_code") > 0))
    assert found.where("status = 'ok'").count() == 6
    assert counts.get == {"seen": 12, "ok": 6, "filtered": 3, "malformed": 3}


def test_id_expression():
    assert P.id_ranges("1-3, 7!2,x,9-8") == ([(1, 3), (7, 7)], [(2, 2)], ["x", "9-8"])


def test_excluded_substring_keeps_nulls(spark):
    df = rows(spark, [("Bob",), (None,), ("Al",)], "user_name string")
    assert {r[0] for r in df.where(P.contains_any(["user_name"], ["bo"], exclude=True)).collect()} == {None, "Al"}


def test_wildcards_are_plain(spark):
    df = rows(spark, [("50%",), ("500",)], "v string")
    assert [r[0] for r in df.where(P.condition(F.col("v"), "contains", "0%")).collect()] == ["50%"]


@pytest.mark.parametrize("operator,value,kept", [("contains", "B", 2), ("equals", "ab", 1), ("starts with", "b", 1), ("ends with", "B", 1), ("not contains", "a", 2), ("not equals", "ab", 3), ("regex", "^.b$", 1), ("greater than", "5", 1), ("less than", "11", 1), ("nonsense", "x", 0)])
def test_conditions(spark, operator, value, kept):
    df = rows(spark, [("ab",), ("ba",), ("0x0A",), (None,)], "v string")
    expected = {"not contains": 1, "contains": 2, "less than": 1}.get(operator, kept)
    assert df.where(P.condition(F.col("v"), operator, value)).count() == expected


def test_dst_day(spark):
    df = rows(spark, [("2024-03-31 00:30:00",), ("2024-03-31 01:30:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    hour = P.in_window(F.col("ts"), {"mode": "time", "from": "03:00:00", "to": "03:59:59", "zone": "Europe/Berlin"})
    assert df.where(hour).count() == 1


def test_bursts_dont_overlap(spark):
    df = rows(spark, [("k", t, i) for i, t in enumerate([0, 1, 2, 3, 4, 5, 100, 101, 102])], "key string, sec long, record_id long")
    got = sorted((r.start_s, r.end_s, r.n) for r in sequences.bursts(df, ["key"], 2, 3).collect())
    assert got == [(0, 2, 3), (3, 5, 3), (100, 102, 3)]


def test_interval_edges_and_causality(spark):
    a = rows(spark, [("h", 100, 1), ("g", 100, 2)], "computer string, sec long, record_id long")
    b = rows(spark, [("h", s, s) for s in (99, 100, 160, 161)], "computer string, sec long, record_id long")
    got = sorted(r.r_sec for r in sequences.interval_join(a, b, ["computer"], 60).collect())
    assert got == [100, 160]


def test_every_chain_is_kept(spark):
    a = rows(spark, [("h", 100 + i, i) for i in range(8)], "computer string, sec long, record_id long")
    b = rows(spark, [("h", 110 + i, 20 + i) for i in range(4)], "computer string, sec long, record_id long")
    pairs = sequences.interval_join(a, b, ["computer"], 60)
    got = {r.first_id: (r.matches, r.shown) for r in sequences.chains(pairs, "l", "r", 2).collect()}
    assert got == {i: (4, [20, 21]) for i in range(8)}
    got = {r.first_id: (r.matches, r.shown) for r in sequences.chains(pairs, "r", "l", 5, last=True).collect()}
    assert got == {20 + i: (8, [3, 4, 5, 6, 7]) for i in range(4)}


@pytest.mark.parametrize("name", ["chain_service_install", "chain_privilege_after_logon", "chain_task_after_logon", "chain_account_after_recon", "chain_shell_to_script"])
def test_whole_chains_cover_the_capped(name, spark):
    queries, sf = registry.queries(), "/root/testdata/sf0.01"
    whole = {r.first_id: r.matches for r in queries[f"{name}_whole"](spark, sf).collect()}
    capped = queries[name](spark, sf).collect()
    assert {r.first_id for r in capped} <= set(whole) and sum(whole.values()) >= len(capped)


def test_as_of_is_strictly_before(spark):
    a = rows(spark, [("h", 5, 1), ("h", 9, 3), ("x", 9, 4)], "k string, sec long, record_id long")
    v = rows(spark, [("h", 5, 1, "same"), ("h", 6, 2, "found")], "k string, sec long, record_id long, val string")
    got = {r.record_id: r.found_val for r in sequences.as_of(a, v, ["k"], ["val"]).collect()}
    assert got == {1: None, 3: "found", 4: None}


def test_gaps_and_coverage(spark):
    df = rows(spark, [("a", 1), ("a", 4), ("a", 4), ("b", 1), ("a", None)], "source_file string, record_id long")
    assert [(r.gap_from, r.gap_to) for r in sequences.record_gaps(df).collect()] == [(2, 3)]
    r = rows(spark, [("a", 1, 5), ("a", 3, 8), ("a", 20, 20)], "k string, lo long, hi long")
    assert sequences.merged_length(r, "k", "lo", "hi").first().expected == 9


@pytest.mark.parametrize("name,twin", [("stream_sessions", jobs.activity_sessions), ("stream_bursts", jobs.failure_counts)])
def test_streams_give_open_windows(spark, sf_dir, name, twin):
    batch = twin(security_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    whole = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, registry.queries()[name](spark, sf_dir).collect())) == whole and whole


def test_script_blocks(spark):
    zero = scripts.ZERO_ID
    df = rows(spark, [("b", 1, 1, 3, "ab"), ("b", 2, 1, 3, "abc"), ("b", 3, 3, 3, "x\0y"), (zero, 4, 1, 1, "p"), (zero, 5, 1, 1, "q")], "block_id string, record_id long, number int, total int, text string")
    got = {r.block: r for r in scripts.script_blocks(df).collect()}
    assert got["b"].text == "abc" + scripts.MISSING + "xy" and not got["b"].complete and len(got) == 3


def test_entropy_and_decode(spark):
    df = rows(spark, [("aabb",), ("",), ("aaaa",)], "v string")
    assert [round(r[0], 6) for r in df.select(S.entropy(F.col("v"))).collect()] == [1.0, 0.0, 0.0]
    import base64

    text = "powershell -enc " + base64.b64encode("Get-Date".encode("utf-16-le")).decode()
    assert rows(spark, [(text,)], "v string").select(S.decode_encoded_command(F.col("v"))).first()[0] == "Get-Date"


def test_tiers_and_cap(spark):
    df = rows(spark, [(80.0, True, 0.0, 0.1), (80.0, True, 1.0, 0.1), (80.0, False, 0.0, 0.1)], "s double, m boolean, p double, d double")
    assert [r[0] for r in df.select(B.capped(F.col("s"), F.col("m"), F.col("p"), F.col("d"))).collect()] == [19.0, 80.0, 80.0]


def test_threat_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text("# note\n1.2.3.4\nDomain.example.com\nmd5,0123456789abcdef0123456789abcdef,known\n1.2.3.4\n")
    got = {(r.ioc_type, r.val, r.verdict) for r in files.read_threat_csv(spark, str(tmp_path / "list.csv")).collect()}
    assert got == {("ipv4", "1.2.3.4", "bad"), ("domain", "domain.example.com", "bad"), ("md5", "0123456789abcdef0123456789abcdef", "known")}


def test_exports_survive_hostile_values(spark, tmp_path):
    df = rows(spark, [(1, "a'b\x01\"<&", {"F": "x\ny"})], "record_id long, name string, fields map<string,string>")
    files.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.ED_F == "x y" and back.name == "a'b \"<&"
    files.write_xml(df.drop("fields"), str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "event").load(str(tmp_path / "xml")).first().name == "a'b?\"<&"


def test_presets_and_profiles(spark):
    assert P.profile_filter({"ids": [1, 2]}, [{"event_ids": [2, 3]}, {"users": ["x"]}]) == {"ids": [2], "users": ["x"]}
    assert all(P.filter_predicate(p) is not None for p in P.PRESETS.values())
