"""Streams over several triggers against their batch twins."""

import random
import tempfile

from pyspark.sql import functions as F

from sparklog.operators.lineage import process_events, with_parents
from sparklog.streaming import jobs, lineage

SCHEMA = "record_id long, source_file string, sec long, event_code int, computer string, image string, parent_image string, pid string, ppid string, process_guid string, parent_guid string, subject_user string, hashes string"


def a_log(rng, n=160):
    """Starts and ends of few numbers and GUIDs on two hosts, in order of time; record ids repeat between the files."""
    rows = []
    for i in range(n):
        code = rng.choice([1, 4688, 4688, 4689])
        guid = f"{{g{rng.randrange(40)}}}" if code == 1 else None
        parent = f"{{G{rng.randrange(40)}}}" if code == 1 else None
        image = rng.choice(["a.exe", "b.exe", "c.exe"])
        digest = rng.choice(["h1", "h2", "h3"]) if code == 1 else None
        rows.append((i // 2, f"f{i % 2}", 1000 + i // 3, code, rng.choice("AB"), image, rng.choice(["own.exe", ""]), str(rng.randrange(1, 6)), str(rng.randrange(0, 6)), guid, parent, "u", digest))
    return rows


def new_hashes(rows):
    seen, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if r[12]:
            known = seen.setdefault((r[4], r[5]), set())
            if known and r[12] not in known:
                out.add((r[1], r[0]))
            known.add(r[12])
    return out


def test_lineage_over_triggers(spark):
    rows = a_log(random.Random(7))
    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], SCHEMA).coalesce(1).write.parquet(f"{folder}/in-{k:04d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*").withColumn("ts", F.timestamp_seconds("sec"))
    got = jobs.run(spark, lineage.lineage(process_events(stream, "ts"), late="5 seconds"), "parents").collect()
    twin = with_parents(process_events(spark.createDataFrame(rows, SCHEMA))).collect()
    key = lambda e: (e and e.source_file, e and e.record_id)
    want = sorted(((*key(r.event), *key(r.entry), r.parent, r.ppid_mismatch) for r in twin), key=str)
    assert sorted(((r.source_file, r.record_id, r.entry_file, r.entry_id, r.parent, r.flag) for r in got if r.kind == "parent"), key=str) == want
    assert {(r.source_file, r.record_id) for r in got if r.kind == "hash" and r.flag} == new_hashes(rows)
    assert sum(r.kind == "hash" for r in got) == sum(bool(r[12]) for r in rows)


def test_lineage_state_is_kept_by_bucket(spark, monkeypatch):
    """Many GUIDs over triggers need few calls; a row looks up what earlier triggers brought, unless its key has been forgotten."""
    monkeypatch.setattr(lineage, "BUCKETS", 8, raising=False)
    start = lambda i, sec, guid, parent: (i, "f", sec, 1, "A", f"{guid}.exe", "own.exe", "0", "0", guid, parent, "u", "")
    first = [start(i, 1000 + i, f"g{i}", "") for i in range(300)]
    second = [start(300 + i, 2000 + i, f"c{i}", f"g{i}") for i in range(300)]
    fresh, later = [start(600, 9000, "x", "")], [start(603, 9050, "w", "")]
    last = [start(601, 9100, "y", "g5"), start(602, 9101, "z", "c250")]
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, rows in enumerate((first, second, fresh, later, last)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in-{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*").withColumn("ts", F.timestamp_seconds("sec"))
    kept = lineage.lineage(process_events(stream, "ts"), late="5 seconds", keep=6800)
    query = kept.writeStream.format("memory").queryName("kept_by_bucket").trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    query.awaitTermination()
    parents = {r.record_id: r.parent for r in spark.table("kept_by_bucket").where("kind = 'parent'").collect()}
    assert len(parents) == 604 and all(parents[300 + i] == f"g{i}.exe" for i in range(300))
    # behind the watermark of the trigger before the last, g5's last version is by 7,990 s, c250's by 6,745 s
    assert (parents[601], parents[602]) == ("own.exe", "c250.exe")
    assert all(int(p["stateOperators"][0]["numRowsTotal"]) <= 8 for p in query.recentProgress)
