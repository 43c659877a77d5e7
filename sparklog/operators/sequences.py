"""Joins over time, bursts, gaps and sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.sources.files import stored


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], seconds: int, left_s: str = "sec", right_s: str = "sec", condition: Column | None = None) -> DataFrame:
    """Rows l and r of equal ``keys`` with ``0 <= r - l <= seconds``; columns get prefixes l_ and r_.

    Times are cut into buckets of the window's width, so that only neighbours of a key meet.
    """
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    width = max(1, seconds)
    bucket = lambda c: F.floor(c / width)
    at = F.col(f"l_{left_s}")
    a = a.withColumn("_b", F.explode(F.sequence(bucket(at), bucket(at + seconds))))
    b = b.withColumn("_c", bucket(F.col(f"r_{right_s}")))
    on = (F.col("_b") == F.col("_c")) & F.col(f"r_{right_s}").between(at, at + seconds)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    if condition is not None:
        on = on & condition
    return a.join(b, on).drop("_b", "_c")


def chains(pairs: DataFrame, by: str, shown: str, most: int, last: bool = False) -> DataFrame:
    """One row per event ``by`` (prefix l or r) of interval-joined ``pairs``: first_id, computer, the number of all its
    matches, and the ids of the ``most`` first (or ``last``) of them in time order.

    Only the list is short; no chain and no match in the number is left out.
    """
    key, order = f"{by}_record_id", [F.col(f"{shown}_sec"), F.col(f"{shown}_record_id")]
    ranked = pairs.withColumn("_p", F.row_number().over(W.partitionBy(key).orderBy(*[c.desc() if last else c.asc() for c in order])))
    entry = F.when(F.col("_p") <= most, F.struct(order[0].alias("s"), order[1].alias("id")))
    grouped = ranked.groupBy(F.col(key).alias("first_id"), F.col(f"{by}_computer").alias("computer"))
    return grouped.agg(F.count("*").alias("matches"), F.sort_array(F.collect_list(entry))["id"].alias("shown"))


#: Width of a time chunk, in windows (two at least); starts of an island that are folded in one array.
SPREAD, FOLD = 64, 4096


def _chunked(df: DataFrame, s: str, width: int, ahead: int) -> tuple[DataFrame, Column]:
    """Rows in their chunk of time, and those up to ``ahead`` after a chunk in that one, too; and which are in their own."""
    chunk = lambda c: F.floor(c / width)
    both = F.array_distinct(F.array(chunk(F.col(s)), chunk(F.col(s) - ahead)))
    return df.withColumn("_chunk", F.explode(both)), F.col("_chunk") == chunk(F.col(s))


def window_summary(starts: DataFrame, others: DataFrame, keys: list[str], seconds: int, most: int, tie: str = "event", back: bool = False, strict: bool = False) -> DataFrame:
    """For each (keys, sec) of ``starts`` what ``others`` of its keys are in the ``seconds`` from then on (``back``: before it),
    without a row for each pair: n, far_s (the time of the farthest), and top, the ``most`` nearest as (sec, tie), the nearest first.

    Both ends of the window count, but for its beginning if ``strict``; a time without others has no row.  Of one second
    the first by ``tie`` are the nearest (``back``: the last).  Rows of a second are counted first, and starts of one
    second share a row.  The counts are differences of running sums within chunks of time, so that a row costs the
    same however many others its window holds.
    """
    way = -1 if back else 1
    at = [*keys, "sec"]
    rank = F.row_number().over(W.partitionBy(*at).orderBy(F.desc(tie) if back else F.asc(tie)))
    given = others.select(*at, tie)
    counted = given.groupBy(*at).agg(F.count("*").alias("_c"))
    # ranks up to a number are cut before the shuffle
    nearest = given.withColumn("_p", rank).where(F.col("_p") <= most).select(*at, F.struct("sec", tie).alias("_t"))
    rows = counted.unionByName(nearest, allowMissingColumns=True).unionByName(starts.select(*at).distinct().withColumn("_start", F.lit(True)), allowMissingColumns=True)
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in at]))
    rows = rows.groupBy(*at).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_c"), F.sort_array(F.collect_list("_t"), asc=not back).alias("_t"), F.coalesce(F.bool_or("_start"), F.lit(False)).alias("_start"))
    ahead = max(1, seconds)
    chunked, own = _chunked(rows.withColumn("_at", F.col("sec") * way), "_at", ahead * SPREAD, ahead)
    chunked = chunked.withColumn("_some", F.col("_c") > 0)
    chunk = [*keys, "_chunk"]
    line = W.partitionBy(*chunk).orderBy("_at")
    until = line.rangeBetween(W.unboundedPreceding, seconds)
    before = line.rangeBetween(W.unboundedPreceding, 0 if strict else -1)
    # of a second's others and those of the next ones, then looked up from where a window begins
    near = F.slice(F.flatten(F.collect_list("_t").over(W.partitionBy(*chunk, "_some").orderBy("_at").rowsBetween(0, most - 1))), 1, most)
    later = W.partitionBy(*chunk).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    seen = chunked.withColumn("_near", F.when(F.col("_some"), near))
    seen = seen.withColumn("top", F.last("_near", ignorenulls=True).over(later))
    seen = seen.withColumn("n", F.sum("_c").over(until) - F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_far", F.max(F.when(F.col("_some"), F.col("_at"))).over(until))
    found = seen.where(own & F.col("_start") & (F.col("n") > 0))
    return found.select(*at, "n", (F.col("_far") * way).alias("far_s"), F.filter("top", lambda x: x["sec"] * way <= F.col("_at") + seconds).alias("top"))


#: Buckets to a window's width, and most rows of one group, of ``window_groups``.
PARTS, GROUP = 32, 1024


def window_groups(starts: DataFrame, others: DataFrame, keys: list[str], seconds: int, by: list[str], tie: str = "event", back: bool = False, strict: bool = False) -> DataFrame:
    """``starts`` with each group of ``others`` of its keys in the ``seconds`` from then on (``back``: before it): other_s, ``by``,
    and others, the ``tie`` of up to ``GROUP`` rows of that second.

    Both ends of the window count, but for its beginning if ``strict``.  For rules that want a row per pair: a group is in a
    window or out of it as a whole, so that pairs are made by exploding it, and neither tested nor joined one by one.
    Times are cut into buckets, and both sides dealt by key and bucket over four tasks a core, as a few megabytes of
    events can have millions of pairs.  The starts are copied, not the groups.
    """
    width = max(1, -(-seconds // PARTS))
    bucket = lambda c: F.floor(c / width)
    least = int(strict)
    ends = (F.col("sec") - seconds, F.col("sec") - least) if back else (F.col("sec") + least, F.col("sec") + seconds)
    # any order does, as it only cuts a second's rows into groups
    place = F.row_number().over(W.partitionBy(*keys, "sec").orderBy(*by, tie))
    cut = others.select(*keys, F.col("sec").alias("other_s"), *by, tie, F.floor((place - 1) / GROUP).alias("_g"))
    groups = cut.groupBy(*keys, "other_s", *by, "_g").agg(F.collect_list(tie).alias("others")).drop("_g").withColumn("_b", bucket(F.col("other_s")))
    ranged = starts.withColumn("_b", F.explode(F.sequence(bucket(ends[0]), bucket(ends[1]))))
    tasks = 4 * starts.sparkSession.sparkContext.defaultParallelism
    a = ranged.repartition(tasks, "_b", *keys).hint("merge")
    b = groups.repartition(tasks, "_b", *keys)
    return a.join(b, ["_b", *keys]).where(F.col("other_s").between(*ends)).drop("_b")


def bursts(df: DataFrame, keys: list[str], seconds: int, least: int, s: str = "sec", tie: str = "record_id", distinct: str | None = None, least_distinct: int = 0, refine: Callable[[DataFrame], DataFrame] | None = None, fold: int = FOLD) -> DataFrame:
    """Greedy bursts per key: from a row take all within ``seconds``; with ``least`` rows emit them and go on
    after the last, else go on at the next row.

    A start must also reach ``least_distinct`` values of ``distinct``, and stay in what ``refine`` makes of the
    starts (columns of the result; it may add some).  Result: keys, start_s, end_s, n, first_id, last_id (``tie``).
    Rows without a key or time belong to no burst; times are whole seconds.

    Rows of one second are counted first: they end in the same windows, so only the first of a second can begin
    one.  Windows look ahead within chunks of time, no task holds a key.  Starts that overlap form islands; in an
    island of up to ``fold`` starts the chosen ones are folded from one array, in a longer one each start points
    to the first beyond its window, and what the island's first reaches is found by doubling the pointers.
    """
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, s)]))
    by_second = rows.groupBy(*keys, s).agg(F.count("*").alias("_c"), F.min(tie).alias("first_id"), F.max(tie).alias("_hi"))
    width = seconds * SPREAD
    chunked, own = _chunked(by_second, s, width, seconds)
    # running sums grow row by row; a frame with two ends would be summed anew for each row
    line = W.partitionBy(*keys, "_chunk").orderBy(s)
    until, before = line.rangeBetween(W.unboundedPreceding, seconds), line.rangeBetween(W.unboundedPreceding, -1)
    n = F.sum("_c").over(until) - F.coalesce(F.sum("_c").over(before), F.lit(0))
    seen = chunked.withColumn("n", n).withColumn("_end", F.max(F.struct(F.col(s).alias("s"), F.col("_hi").alias("hi"))).over(until))
    starts = seen.where(own & (F.col("n") >= least))
    if distinct:
        enough = _distinct_ahead(rows, keys, s, seconds, distinct, width).where(F.col("_d") >= least_distinct)
        starts = starts.join(enough, [*keys, s], "left_semi")
    starts = starts.select(*keys, F.col(s).alias("start_s"), F.col("_end.s").alias("end_s"), "n", "first_id", F.col("_end.hi").alias("last_id"))
    if refine is not None:
        starts = refine(starts)
    order = W.partitionBy(*keys).orderBy("start_s")
    starts = starts.withColumn("_head", F.coalesce(F.col("start_s") - F.lag("start_s").over(order) > seconds, F.lit(True)).cast("long"))
    starts = stored(starts.withColumn("_island", F.sum("_head").over(order)).drop("_head"), "burst-starts")
    island = [*keys, "_island"]
    sizes = starts.groupBy(*island).agg(F.count("*").alias("_size"))
    listed = starts.groupBy(*island).agg(F.count("*").alias("_size"), F.min("start_s").alias("_least"))
    short = starts.join(sizes.where(F.col("_size") <= fold), island).groupBy(*island).agg(F.sort_array(F.collect_list("start_s")).alias("_all"))
    kept = F.aggregate(
        "_all",
        F.expr("cast(array() as array<bigint>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x > F.element_at(acc, -1) + seconds), F.concat(acc, F.array(x))).otherwise(acc),
    )
    chosen = short.select(*keys, F.explode(kept).alias("start_s"))
    long = listed.where(F.col("_size") > fold)
    if not long.isEmpty():
        nodes = starts.join(long.select(*island), island).select(*island, "start_s")
        heads = long.select(*keys, F.col("_least").alias("start_s"))
        chosen = chosen.unionByName(_reached(nodes, heads, keys, seconds))
    return starts.drop("_island").join(chosen, [*keys, "start_s"])


def _distinct_ahead(rows: DataFrame, keys: list[str], s: str, seconds: int, value: str, width: int) -> DataFrame:
    """keys, ``s`` and _d, the number of distinct ``value`` (nulls don't count) in the ``seconds`` from then on, for each second of ``rows``.

    A value is in the windows that begin up to ``seconds`` before one of its times, but for those that its time before
    is in already.  So each of its times adds one where these begin and takes it away behind itself, and the number is a
    running sum of both: a row costs the same however many others its window holds.
    """
    chunked, _ = _chunked(rows.select(*keys, s, F.col(value).alias("_v")).distinct(), s, width, seconds)
    at, one = F.col(s), F.col("_v").isNotNull().cast("int")
    begin = F.greatest(at - seconds, F.lag(s).over(W.partitionBy(*keys, "_chunk", "_v").orderBy(s)) + 1)
    step = lambda s, by, real: F.struct(s.alias("s"), by.alias("by"), F.lit(real).alias("real"))
    each = F.explode(F.array(step(F.col("_from"), one, False), step(at + 1, -one, False), step(at, F.lit(0), True)))
    steps = chunked.withColumn("_from", begin).select(*keys, "_chunk", each.alias("_e"))
    steps = steps.groupBy(*keys, "_chunk", F.col("_e.s").alias(s)).agg(F.sum("_e.by").alias("_by"), F.bool_or("_e.real").alias("_real"))
    counted = steps.withColumn("_d", F.sum("_by").over(W.partitionBy(*keys, "_chunk").orderBy(s)))
    return counted.where(F.col("_real") & (F.col("_chunk") == F.floor(at / width))).select(*keys, s, "_d")


def _reached(nodes: DataFrame, heads: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, start_s of what ``heads`` reach, each start of an island pointing to the first beyond its window.

    Starts of an island are at most ``seconds`` apart, so that one is at most twice that away.  A round doubles
    what the pointers skip; the rounds grow with the logarithm of an island's bursts.
    """
    chunked, own = _chunked(nodes, "start_s", seconds * SPREAD, 2 * seconds)
    # from the last start to the first, as then a frame that has one end grows row by row
    beyond = W.partitionBy(*keys, "_island", "_chunk").orderBy(F.desc("start_s")).rangeBetween(W.unboundedPreceding, -(seconds + 1))
    jumps = chunked.withColumn("_next", F.min("start_s").over(beyond)).where(own & F.col("_next").isNotNull()).select(*keys, "start_s", "_next")
    reached, jumps = stored(heads, "burst-reached"), stored(jumps, "burst-jumps")
    while not jumps.isEmpty():
        step = reached.join(jumps, [*keys, "start_s"]).select(*keys, F.col("_next").alias("start_s"))
        reached = stored(reached.unionByName(step), "burst-reached")
        after = jumps.select(*keys, F.col("start_s").alias("_next"), F.col("_next").alias("_then"))
        jumps = stored(jumps.join(after, [*keys, "_next"]).select(*keys, "start_s", F.col("_then").alias("_next")), "burst-jumps")
    return reached


def burst_rows(df: DataFrame, found: DataFrame, keys: list[str], seconds: int, s: str = "sec") -> DataFrame:
    """The rows of each burst: its columns with the prefix l_, theirs with r_."""
    return interval_join(found, df, keys, seconds, left_s="start_s", right_s=s)


def as_of(df: DataFrame, versions: DataFrame, keys: list[str], values: list[str], s: str = "sec", tie: str = "record_id") -> DataFrame:
    """``df`` with the ``values`` of the latest of ``versions`` of its keys strictly before, by (s, tie); null if none.

    One pass over both in time order per key; nothing is joined by ranges.
    """
    extra = [c for c in df.columns if c not in (*keys, s, tie)]
    mark = F.struct(*[F.col(c) for c in values])
    a = df.select(*keys, s, tie, F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in extra]).alias("_row"), F.lit(None).cast(versions.select(mark.alias("m")).schema["m"].dataType).alias("_v"))
    b = versions.select(*keys, s, tie, F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), mark.alias("_v"))
    before = W.partitionBy(*keys).orderBy(s, tie, "_side").rowsBetween(W.unboundedPreceding, -1)
    found = a.unionByName(b).withColumn("_f", F.last("_v", ignorenulls=True).over(before)).where("_side = 0")
    return found.select(*keys, s, tie, *[F.col(f"_row.{c}").alias(c) for c in extra], *[F.col(f"_f.{c}").alias(f"found_{c}") for c in values])


def record_gaps(df: DataFrame, file: str = "source_file", record: str = "record_id") -> DataFrame:
    """Missing record ids of each file as ranges."""
    ids = df.select(file, record).where(F.col(record).isNotNull()).distinct()
    before = ids.withColumn("_p", F.lag(record).over(W.partitionBy(file).orderBy(record)))
    gaps = before.where(F.col(record) > F.col("_p") + 1)
    return gaps.select(file, (F.col("_p") + 1).alias("gap_from"), (F.col(record) - 1).alias("gap_to"), (F.col(record) - F.col("_p") - 1).alias("missing"))


def merged_length(ranges: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Number of ids that each key's ranges cover, where ranges may overlap."""
    before = W.partitionBy(key).orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1)
    top = F.max(hi).over(before)
    added = F.greatest(F.col(hi) - F.greatest(F.col(lo) - 1, F.coalesce(top, F.col(lo) - 1)), F.lit(0))
    return ranges.withColumn("_a", added).groupBy(key).agg(F.sum("_a").alias("expected"))


def logon_sessions(log: DataFrame, start: int = 4624, ends: tuple[int, ...] = (4634, 4647), process: int = 4688, privilege: int = 4672) -> DataFrame:
    """Sessions of each (computer, logon_id): each start opens one; rows before the first start are a partial one."""
    order = W.partitionBy("computer", "logon_id").orderBy("sec", "record_id")
    number = F.sum((F.col("event_code") == start).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = log.where("logon_id is not null").withColumn("instance", number)
    count = lambda code: F.sum((F.col("event_code") == code).cast("long"))
    ended = F.max(F.when(F.col("event_code").isin(list(ends)), F.col("sec")))
    out = rows.groupBy("computer", "logon_id", "instance").agg(
        F.min("sec").alias("start_s"),
        F.coalesce(ended, F.max("sec")).alias("end_s"),
        count(process).alias("processes"),
        count(privilege).alias("privileges"),
        F.count("*").alias("events"),
        ended.isNull().alias("active"),
        F.min_by("logon_type", F.struct("sec", "record_id")).alias("logon_type"),
    )
    return out.withColumn("partial", F.col("instance") == 0).withColumn("seconds", F.col("end_s") - F.col("start_s"))
