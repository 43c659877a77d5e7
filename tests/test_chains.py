"""Attack chains, indicators, tags and lineage on hand-made events."""

import random

from pyspark.sql import functions as F

from sparklog.functions.scalars import number, service_path_is_odd
from sparklog.operators import chains, ioc, lineage, sequences

SCHEMA = """record_id long, source_file string, sec long, event_code int, computer string, subject_user string, target_user string, image string, parent_image string,
  pid string, ppid string, process_guid string, parent_guid string, sub_status string, logon_type string, ip_address string, service_path string"""


def events(spark, *rows):
    """Rows of (sec, event_code, computer, {field: value}); the place is the record id, of file f, unless fields name others."""
    names = [c.split()[0] for c in SCHEMA.split(",")]
    made = [{"record_id": i, "source_file": "f", "sec": s, "event_code": e, "computer": c, **more} for i, (s, e, c, more) in enumerate(rows)]
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], SCHEMA)


def ids(*keys):
    return [k.record_id for k in keys]


def test_no_effect_before_its_cause(spark):
    shell = {"image": "C:\\Windows\\cmd.exe", "parent_image": "C:\\Office\\WINWORD.EXE"}
    log = events(spark, (90, 4104, "A", {}), (100, 4688, "A", shell), (160, 4104, "A", {}), (161, 4104, "A", {}), (110, 4104, "B", {}))
    found = chains.script_after_shell(log).collect()
    assert [(ids(r.first_event), r.n, ids(*r.shown), r.first_s, r.last_s, r.hosts) for r in found] == [([1], 2, [1, 2], 100, 160, ["A"])]


def test_brute_force_needs_the_success_of_that_user(spark):
    fail = lambda s, u="bob", state="0xC000006A": (s, 4625, "A", {"target_user": u, "sub_status": state})
    win = lambda s, u: (s, 4624, "A", {"target_user": u})
    five = [fail(s) for s in range(0, 50, 10)]
    assert chains.brute_force(events(spark, *five, win(100, "eve"))).count() == 0
    found = chains.brute_force(events(spark, *five, win(160, "Bob"), win(170, "bob"))).collect()
    assert [(r.n, r.first_s, r.last_s, ids(*r.shown)) for r in found] == [(6, 0, 160, [0, 1, 2, 3, 4, 5])]
    assert chains.brute_force(events(spark, *five, win(161, "bob"))).count() == 0
    assert chains.brute_force(events(spark, *five[:4], fail(45, state="0xC0000072"), win(60, "bob"))).count() == 0
    assert chains.brute_force(events(spark, *[fail(s, "PC1$") for s in range(5)], win(9, "PC1$"))).count() == 0


def test_parent_that_ended_is_a_mismatch(spark):
    start = lambda s, pid, ppid, image: (s, 4688, "A", {"pid": pid, "ppid": ppid, "image": image, "parent_image": "own.exe"})
    log = events(spark, start(1, "0x10", "4", "C:/a.exe"), start(2, "17", "16", "b.exe"), (3, 4689, "A", {"pid": "16"}), start(3, "18", "16", "c.exe"), start(4, "19", "0x10", "d.exe"), (5, 4688, "B", {"pid": "20", "ppid": "16", "image": "e.exe", "parent_image": ""}))
    got = {r.event.record_id: (r.parent, r.ppid_mismatch) for r in lineage.with_parents(lineage.process_events(log)).collect()}
    assert got == {0: ("own.exe", False), 1: ("a.exe", False), 3: ("a.exe", False), 4: (None, True), 5: (None, False)}
    chain = {r.event.record_id: r.chain for r in lineage.ancestry(lineage.with_parents(lineage.process_events(log))).collect()}
    assert chain[1] == ["b.exe", "a.exe", "own.exe"] and chain[4] == ["d.exe"]


def twins(rows):
    """Rows of host A in file a, and the same with the same record ids of host B in file b."""
    return [(s, e, h, {**more, "record_id": i, "source_file": h.lower()}) for h in "AB" for i, (s, e, more) in enumerate(rows)]


def test_record_ids_count_within_a_file(spark):
    logon = (10, 4624, {"target_user": "bob", "logon_type": "3", "ip_address": "8.8.8.8"})
    odd, plain = "D:\\temp\\x.exe", "C:\\Windows\\x.exe"
    rows = twins([logon, (20, 7045, {"service_path": plain}), (30, 4698, {}), (40, 4698, {})])
    rows[1][3]["service_path"] = odd
    log = events(spark, *rows)
    found = sorted((r.computer, r.n, ids(*r.shown), r.shown[0].source_file) for r in chains.service_after_logon(log).collect())
    assert found == [("A", 2, [0, 1], "a"), ("B", 2, [0, 1], "b")]
    found = sorted((r.computer, r.n, ids(*r.shown)) for r in chains.task_after_logon(log).collect())
    assert found == [("A", 3, [0, 2, 3]), ("B", 3, [0, 2, 3])]
    start = lambda s, pid, ppid, image: (s, 4688, {"pid": pid, "ppid": ppid, "image": image})
    log = events(spark, *twins([start(1, "16", "4", "a.exe"), start(2, "17", "16", "b.exe")]))
    got = sorted((r.event.source_file, r.event.record_id, r.entry and tuple(r.entry), r.parent) for r in lineage.with_parents(lineage.process_events(log)).collect())
    assert got == [("a", 0, None, None), ("a", 1, (0, "a"), "a.exe"), ("b", 0, None, None), ("b", 1, (0, "b"), "a.exe")]


def test_windows_over_hosts_have_all_their_hosts(spark):
    logon = lambda s, h, u: (s, 4624, h, {"target_user": u, "logon_type": "3"})
    log = events(spark, *[logon(s, h, u) for u in ("bob", "eve") for s, h in ((0, "C"), (10, "A"), (20, "B"), (30, "A"))])
    found = chains.many_hosts(log)
    assert sorted((r.user_name, r.n, r.hosts, ids(*r.shown)) for r in found.collect()) == [("bob", 4, ["A", "B", "C"], [0, 1, 2, 3]), ("eve", 4, ["A", "B", "C"], [4, 5, 6, 7])]
    # the same hosts and minute: the first is kept
    assert [r.user_name for r in chains.once_a_minute(found).collect()] == ["bob"]


def test_trees_by_guid(spark):
    node = lambda s, guid, parent, image, code=1: (s, code, "A", {"process_guid": guid, "parent_guid": parent, "image": image})
    zero = chains.NO_GUID
    log = events(spark, node(0, zero, "", "winword.exe"), node(1, zero, zero, "cmd.exe"), node(2, "{A}", "{x}", "WINWORD.EXE"), node(3, "{b}", "{a}", "plain.exe"), node(4, "{c}", "{b}", "cmd.exe", 4688), node(5, "{c}", "{b}", "again.exe"), node(6, "{d}", "{c}", "C:/Users/Public/x.exe"))
    found = chains.process_trees(log).collect()
    assert [(r.severity, ids(r.first_event), r.n, ids(*r.shown)) for r in found] == [("critical", [2], 5, [2, 3, 4, 5, 6])]


def test_order_of_all_chains(spark):
    log = events(spark, (0, 4624, "A", {"target_user": "bob", "logon_type": "3", "ip_address": "8.8.8.8"}), (5, 4698, "A", {}), (9, 7045, "A", {"service_path": "D:/temp/x.exe"}))
    missing = ["auth_package", "key_length", "lm_package", "privileges", "channel", "ticket_cipher", "ticket_service", "logon_id"]
    log = log.withColumns({c: F.lit(None).cast("string") for c in missing})
    assert [(r.rule, r.severity) for r in chains.all_chains(log).collect()] == [("service_after_logon", "high"), ("task_after_logon", "medium")]


def test_service_paths_and_numbers(spark):
    paths = ["C:\\Windows\\System32\\a.exe", '"C:\\Users\\Public\\a.exe"', "%SystemRoot%\\temp\\a.exe", "D:\\temp\\a.exe", "", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(service_path_is_odd(F.col("p")).alias("odd")).collect()
    assert [r.odd for r in rows] == [False, True, False, True, False, False]
    found = spark.createDataFrame([("0x00000000000001f4",), ("7fff",), ("12",)], "p string").select(number(F.col("p")).alias("n")).collect()
    assert [r.n for r in found] == [500, None, 12]


def test_addresses_and_domains_have_bounds(spark):
    df = spark.createDataFrame([(1, "see 999.1.1.1 and 8.8.8.8; FOO.example.COM, not foo.common")], "id long, t string")
    assert {(r.ioc_type, r.val) for r in ioc.text_indicators(df, "t", "id").collect()} == {("ipv4", "8.8.8.8"), ("domain", "foo.example.com")}


def test_pair_rules_make_no_row_per_pair(spark, monkeypatch):
    """Random events against a plain walk, with seconds of many events, in several chunks of time; pairs are never joined."""
    rng, odd = random.Random(5), "D:\\temp\\x.exe"
    made = []
    for _ in range(900):
        code = rng.choice([4624, 4624, 7045, 4698, 4798, 4720, 1102, 4663])
        more = {"target_user": rng.choice(["bob", "eve"]) if code == 4624 else "", "subject_user": rng.choice(["bob", "eve", ""]) if code in (4720, 4798) else "", "logon_type": "3", "ip_address": "8.8.8.8", "service_path": rng.choice([odd, "x.exe", None])}
        made.append((rng.choice([0, 5000]) + rng.randrange(900), code, rng.choice(["A", "B", "", None]), more))
    log = events(spark, *made).withColumn("channel", F.lit("Security"))
    monkeypatch.setattr(sequences, "SPREAD", 2)
    monkeypatch.delattr(chains, "interval_join")
    rows = [(s, i, e, c, m["target_user"] or m["subject_user"], m["service_path"] == odd) for i, (s, e, c, m) in enumerate(made) if c is not None]
    cases = {
        "service_after_logon": ((4624,), (7045,), 120, lambda a, b: True),
        "task_after_logon": ((4624,), (4698,), 300, lambda a, b: True),
        "account_after_recon": ((4798,), (4720,), 600, lambda a, b: a[4] in ("", b[4])),
    }
    for name, (first, then, seconds, fits) in cases.items():
        rule, expected = getattr(chains, name), []
        for a in (r for r in rows if r[2] in first):
            found = sorted(b for b in rows if b[2] in then and b[3] == a[3] and 0 <= b[0] - a[0] <= seconds and fits(a, b))
            if name == "service_after_logon" and any(b[5] for b in found):
                found = [b for b in found if b[5]]
            if found:
                expected.append((a[1], a[4], a[0], found[-1][0], len(found) + 1, [a[1], *[b[1] for b in found[: rule.most]]], [a[3]] if a[3] else []))
        got = sorted((*ids(r.first_event), r.user_name, r.first_s, r.last_s, r.n, ids(*r.shown), r.hosts) for r in rule(log).collect())
        assert got == sorted(expected)
    expected = []
    for b in (r for r in rows if r[2] == 1102):
        found = sorted(a for a in rows if a[2] != 1102 and a[3] == b[3] and 0 < b[0] - a[0] <= 1800)
        if found:
            expected.append((b[1], found[0][0], b[0], len(found) + 1, [*[a[1] for a in found[-5:]], b[1]]))
    assert sorted((*ids(r.first_event), r.first_s, r.last_s, r.n, ids(*r.shown)) for r in chains.log_clearing(log).collect()) == sorted(expected)


def test_members_of_pair_rules_are_exploded(spark, monkeypatch):
    """Random events against a plain walk, with seconds of many events in several groups; pairs aren't joined one by one."""
    rng, odd = random.Random(8), "D:\\temp\\x.exe"
    made = []
    for _ in range(500):
        code = rng.choice([4624, 7045, 1102, 4663, 4663])
        more = {"target_user": "bob", "logon_type": "3", "ip_address": "8.8.8.8", "service_path": rng.choice([odd, "x.exe", "x.exe", None])}
        made.append((rng.choice([0, 5000]) + rng.choice([7, 60, rng.randrange(2400)]), code, rng.choice(["A", "B", "", None]), more))
    log = events(spark, *made).withColumn("channel", F.lit("Security"))
    monkeypatch.setattr(sequences, "GROUP", 2, raising=False)
    monkeypatch.delattr(chains, "interval_join")
    rows = [(s, i, e, c, m["service_path"] == odd) for i, (s, e, c, m) in enumerate(made) if c is not None]
    cases = {
        "log_clearing": ((1102,), lambda a, b: b[2] != 1102 and 0 < a[0] - b[0] <= 1800),
        "service_after_logon": ((4624,), lambda a, b: b[2] == 7045 and 0 <= b[0] - a[0] <= 120),
    }
    for name, (first, fits) in cases.items():
        expected = []
        for a in (r for r in rows if r[2] in first):
            found = [b for b in rows if b[3] == a[3] and fits(a, b)]
            if name == "service_after_logon" and any(b[4] for b in found):
                found = [b for b in found if b[4]]
            expected += [(a[1], b[1], b[0], b[3], b is a) for b in (found and [a, *found])]
        got = getattr(chains, name).members(log).collect()
        assert sorted((r.chain.record_id, r.event.record_id, r.sec, r.host, r.lead) for r in got) == sorted(expected)
