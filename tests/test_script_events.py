"""Routing, sessions and exports of script events by hand."""

import glob
import itertools
import json
import tempfile

from sparklog.operators import script_events as E

SCHEMA = "event struct<record_id:long,source_file:string>, sec long, event_code int, channel string, computer string, pid long, user_sid string, fields map<string,string>"
CLASSIC, OPERATIONAL = "Windows PowerShell", "PowerShellCore/Operational"


def records(spark, *rows):
    """(sec, event_code, pid, fields), on one computer; the place is the record id."""
    return spark.createDataFrame([((i, "f"), s, c, OPERATIONAL if c > 4000 else CLASSIC, "A", p, "S-1", f) for i, (s, c, p, f) in enumerate(rows)], SCHEMA)


def test_assignment(spark):
    block = {"ScriptBlockId": "{B1}", "ScriptBlockText": "x"}
    log = records(
        spark,
        (10, 400, 5, {"HostId": "{h}", "HostApplication": "powershell.exe -EncodedCommand SQBFAFgA"}),
        (20, 400, 5, {"HostID": "h"}),
        (30, 403, 5, {"HostId": "h"}),
        (31, 403, 5, {"HostId": "h"}),
        (15, 600, 9, {"HostId": "h", "ProviderName": "Registry"}),
        (40, 4103, 9, {"ContextInfo": "Host ID = h\\n\\tUser = A=b".replace("\\n", "\n").replace("\\t", "\t")}),
        (25, 4103, 5, {"ContextInfo": ""}),
        (5, 800, 5, {}),
        (20, 4104, 5, block),
        (21, 4104, 5, block),
        (22, 4104, None, {"ScriptBlockId": ""}),
        (50, 600, 9, {"HostId": "unknown"}),
        (60, 400, 7, {}),
    )
    events = E.script_events(log)
    got = {r.event.record_id: r.session for r in E.assigned(events).collect()}
    assert got == {0: "h", 1: "h_2", 2: "h", 4: "h", 5: "h", 6: "h_2", 7: "h", 8: "h_2", 10: "_unsessioned", 12: "_pid7_60"}
    found = {r.session: r for r in E.sessions(events).collect()}
    assert (found["h"].stop_s, found["h"].providers, found["h"].user_name, found["h"].encoded_command, found["h"].ghost) == (30, ["Registry"], "A=b", "IEX", False)
    assert found["_pid7_60"].ghost and found["_unsessioned"].start_s is None


def test_only_the_engines_channels(spark):
    log = records(spark, (1, 400, 1, {}), (2, 4104, 1, {"MessageNumber": "two"})).union(records(spark, (3, 4104, 1, {})).replace(OPERATIONAL, "Security"))
    assert [(r.event_code, r.number, r.total, r.command) for r in E.script_events(log).orderBy("sec").collect()] == [(400, None, None, None), (4104, 1, 1, "(in-memory)")]
    assert E.assigned(E.script_events(log.limit(0))).count() == 0


def test_blocks_round_trip(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/blocks"
    blocks = {"b1": "line one\n\n  line two", "00:f:1": "é 😀", "b/3": "x"}
    E.write_by_key(spark.createDataFrame(list(blocks.items()), "block string, text string"), "block", path, "text")
    back = spark.read.text(path, wholetext=True)
    assert {r.block: r.value.removesuffix("\n") for r in back.collect()} == blocks


def test_sessions_are_runs_of_lines_in_few_files(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/runs"
    rows = spark.range(3000).selectExpr("concat('s', id % 700) as session", "concat('H', id % 2) as computer", "id as sec")
    E.write_runs(rows, ["computer", "session"], path)
    files, seen = {}, 0
    for f in glob.glob(path + "/*.json"):
        with open(f) as lines:
            names = [tuple(json.loads(x)[c] for c in ("computer", "session")) for x in lines]
        seen += len(names)
        runs = [n for n, _ in itertools.groupby(names)]
        assert len(runs) == len(set(runs))
        for n in runs:
            assert files.setdefault(n, f) == f
    assert (seen, len(files)) == (3000, 700) and len(glob.glob(path + "/*.json")) <= 8
