"""Parents and first-seen hashes of process starts over a stream, with state per process number, GUID or name.

The twin of ``operators.lineage.with_parents``.  State is kept by (computer, what is looked up), not by host: a
start is a version of its own number and GUID, an end one of its number, and a child looks its parent's up.  So the
starts of a busy host are spread over all tasks.  Keys are grouped in ``BUCKETS`` by a hash: a group's state comes and
goes with its rows, once a trigger, where a call per GUID, or per entry of its state, costs far more than the lookup.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from sparklog.operators.lineage import ENDS, STARTS

#: Versions and hashes are kept this long (seconds) after the last row of their key.
KEEP = 60 * 86_400
OUT = "kind string, computer string, source_file string, record_id long, entry_id long, entry_file string, parent string, flag boolean"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_ROWS = ["computer", "what", "sec", "record_id", "source_file", "role", "own"]
#: Groups that all numbers, GUIDs and names are dealt over, fixed for a stream's life; a group is one call a trigger.
BUCKETS = 1024
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _versions(keep: int):
    """Starts and ends of the process numbers and GUIDs of a bucket, and hashes of its process names.

    A lookup finds the latest version strictly before the child by time and key, so rows of a trigger, and rows that
    come late, need no order.  Behind the watermark only the latest start and end stay.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() // 1000
        held = pickle.loads(state.get[0]) if state.exists else {}
        out, changed, brought = [], False, {}
        for frame in frames:
            for computer, what, sec, record, file, role, own in zip(*[frame[c].tolist() for c in _ROWS]):
                children, hashed, new = brought.setdefault((computer, what), ([], [], {}))
                if role == "child":
                    children.append(((sec, record, file), own))
                elif role == "hash":
                    hashed.append(((sec, record, file), own))
                else:
                    new[(sec, record, file, role == "end")] = own
        for (computer, what), (children, hashed, new) in brought.items():
            versions, hashes, latest = held.get((computer, what), ({}, {}, 0))
            found = versions | new
            starts, ends = (sorted(k[:3] for k in found if k[3] == ended) for ended in (False, True))
            for at, own in children:
                p, e = bisect_left(starts, at), bisect_left(ends, at)
                start, end = (starts[p - 1] if p else None), (ends[e - 1] if e else None)
                over = bool(start and end and end > start and end[0] < at[0])
                parent = None if over else (found[(*start, False)] if start else own)
                out.append(("parent", computer, at[2], at[1], start and start[1], start and start[2], parent, over))
            for at, value in sorted(hashed):
                out.append(("hash", computer, at[2], at[1], None, None, what[2:], bool(hashes) and value not in hashes))
                hashes.setdefault(value, at[0])
            if new or hashed:
                for ended, all_of in ((False, starts), (True, ends)):
                    for k in all_of[: max(0, bisect_left(all_of, (watermark,)) - 1)]:
                        del found[(*k, ended)]
                held[computer, what], changed = (found, hashes, max(latest, *[k[0] for k in new], *[at[0] for at, _ in hashed])), True
        for k in [k for k, (_, _, latest) in held.items() if latest + keep <= watermark]:
            del held[k]
            changed = True
        if held:
            if changed:
                state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp((min(latest for _, _, latest in held.values()) + keep) * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"record_id": "Int64", "entry_id": "Int64"})

    return run


def lineage(events: DataFrame, late: str = "10 minutes", keep: int = KEEP) -> DataFrame:
    """For each start of ``process_events`` (with ``ts``) its parent (kind 'parent': entry, name, whether the number's process had
    ended) and, if it has a hash, whether that is a new one of a known process (kind 'hash').

    Rows later than ``late`` are still looked up, against what is kept.  Hashes of one process are in the order in
    which triggers bring them.  A key without rows for ``keep`` seconds is forgotten.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    start, end = F.col("event_code").isin(list(STARTS)), F.col("event_code").isin(list(ENDS))
    number = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    guid = lambda c: F.concat(F.lit("g:"), F.col(c))
    role = lambda hit, what, name, own: F.when(hit, F.struct(what.alias("what"), F.lit(name).alias("role"), own.alias("own")))
    own = F.nullif(F.col("parent_name"), F.lit(""))
    by_guid = start & (F.col("guid") != "") & (F.col("parent_guid") != "")
    by_number = start & (F.col("guid") == "") & (F.col("ppid") != 0)
    roles = F.array_compact(
        F.array(
            role(start & (F.col("guid") != ""), guid("guid"), "start", F.col("name")),
            role(start & (F.col("pid") != 0), number("pid"), "start", F.col("name")),
            role(end & (F.col("pid") != 0), number("pid"), "end", F.col("name")),
            role(by_guid, guid("parent_guid"), "child", own),
            role(by_number, number("ppid"), "child", own),
            role(start & (F.col("image_hash") != ""), F.concat(F.lit("h:"), F.col("name")), "hash", F.col("image_hash")),
        )
    )
    rows = events.withWatermark("ts", late).select("ts", "computer", F.unix_timestamp("ts").alias("sec"), "event.*", F.explode(roles).alias("r")).select("ts", "computer", "sec", "record_id", "source_file", "r.*")
    kept = rows.withColumn("bucket", F.pmod(F.hash("computer", "what"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(_versions(keep), OUT, "held binary", "append", "EventTimeTimeout")
    alone = events.where(start & ~by_guid & ~by_number)
    none = F.lit(None)
    return kept.union(alone.select(F.lit("parent"), "computer", "event.source_file", "event.record_id", none.cast("long"), none.cast("string"), own, F.lit(False)))
