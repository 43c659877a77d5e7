"""Line deduplication by an exact set-similarity join, in DataFrame operations alone.

A line's set has its distinct words (A-Z lower-cased, cut at blanks, tabs and such).  A line
goes when an earlier line, by (doc_id, line number), has ``100 * common >= percent * union``;
it doesn't matter whether that one goes itself.  Lines without words stay.

Lines of equal sets are one class, named by its first line.  Words are ordered by rarity, by
a sketch of all word counts (any order gives the same result, a good one fewer candidates).
Two similar sets share a word among their first ``n - ceil(percent * n / 100) + 1``; so
classes are joined on those, and kept as candidates by length, by the words' positions, and
by a 64-bit parity map (sets that differ in ``k`` words differ in at most ``k`` bits).  Then
the full sets decide.

Many copies of a line would give a pair for any two.  So each class is held first against
the first class of each of its words alone; those that find a match are settled, as one
earlier match is enough, and only the others are held against all earlier ones.

Null texts stay null.  Very long texts are cut into lines and words like any other.  Rows that
repeat a doc_id are one document: a line isn't later than the line of the same number there.
Null doc_ids count as one id below all others.  An empty table gives an empty result.  Other
columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize

PERCENT = 85
#: Buckets of the word sketch, and how many of them are one row of it.
BUCKETS, CHUNK = 1 << 17, 1 << 10
#: Rows up to which a table of ids is broadcast.
SMALL = 200_000
_NO_ID = -(1 << 63)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\x0b\x0c"
_PLAIN = "abcdefghijklmnopqrstuvwxyz    "


def _hashes(text: Column) -> Column:
    """Hashes of the distinct words of a line."""
    found = F.transform(F.split(F.translate(text, _UPPER, _PLAIN), " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(found), F.xxhash64(F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d")
    return docs.select(at, F.posexplode(F.split("text", "\n")).alias("l", "line"))


def _levels(docs: DataFrame) -> bytearray:
    """Per bucket of word hashes a byte: the logarithm of how often its words occur in all documents."""
    spark = docs.sparkSession
    words = docs.select(F.explode(F.split(F.translate("text", _UPPER + "\n", _PLAIN + " "), " ")).alias("word")).where("word <> ''")
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = words.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    level = F.chr(F.lit(1) + F.log2(F.sum("n") + 1).cast("int"))
    rows = counts.union(every).groupBy("bucket").agg(level.alias("level"))
    chunk = F.floor(F.col("bucket") / CHUNK).alias("chunk")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "level"))), lambda x: x.level), "")
    chunks = rows.groupBy(chunk).agg(text.alias("text")).orderBy("chunk").collect()
    return bytearray("".join(r.text for r in chunks), "ascii")


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """d, l of each line that isn't empty (n is 0 if it has no word); its class key k1, k2; n words, parity map and first words."""
    table = F.lit(_levels(docs))
    at = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1
    level = lambda h: F.ascii(F.substring(table, at(h), F.lit(1)).cast("string")).cast("long")
    low = F.lit((1 << 57) - 1)
    ranked = F.transform(_hashes(F.col("line")), lambda h: F.shiftleft(level(h), 57).bitwiseOR(h.bitwiseAND(low)))
    rows = _lines(docs).where("line <> ''").select("d", "l", F.sort_array(ranked).alias("codes"))
    n = F.size("codes")
    first = n - F.floor((percent * n + 99) / 100).cast("int") + 1
    parity = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))))
    prefix = F.transform(F.slice("codes", F.lit(1), first), lambda c: F.hash(c))
    return rows.select("d", "l", F.xxhash64("codes").alias("k1"), F.hash("codes").alias("k2"), n.alias("n"), parity.alias("parity"), prefix.alias("prefix"))


def _alike(percent: int, x: str = "x.", y: str = "y.") -> Column:
    """Whether postings x and y can be of similar sets, if theirs is the first word that both have: by length, positions and parity maps."""
    least = f"ceil({percent} * ({x}n + {y}n) / {100 + percent}.0 - 1e-9)"
    return F.expr(
        f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) and least({x}n - {x}i, {y}n - {y}i) + 1 >= {least}"
        f" and bit_count({x}parity ^ {y}parity) <= {x}n + {y}n - 2 * {least}"
    )


def _checked(small: DataFrame, limit: int = SMALL) -> DataFrame:
    """``small``, marked for broadcast if it has no more than ``limit`` rows."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """d, l of lines yd, yl of those pairs (of lines xd, xl and yd, yl) whose full word sets are similar enough."""
    ends = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl")).distinct()
    ends = materialize(ends, "ends")
    wanted = materialize(ends.select(F.col("d").alias("doc_id")).distinct(), "wanted")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text").join(_checked(wanted), "doc_id", "left_semi")
    sets = _lines(texts).join(ends, ["d", "l"], "left_semi").select("d", "l", _hashes(F.col("line")).alias("words"))
    sets = materialize(sets, "sets")
    x = sets.select(F.col("d").alias("xd"), F.col("l").alias("xl"), F.col("words").alias("xw"))
    y = sets.select(F.col("d").alias("yd"), F.col("l").alias("yl"), F.col("words").alias("yw"))
    common = F.size(F.array_intersect("xw", "yw"))
    found = pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"])
    found = found.where(100 * common >= percent * (F.size("xw") + F.size("yw") - common))
    found = materialize(found.select(F.col("yd").alias("d"), F.col("yl").alias("l")).distinct(), "matched")
    discard(ends, wanted, sets)
    return found


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """d, l of each line of ``docs`` (doc_id, text) that an earlier line matches."""
    # filtered when read: a filter on what the sets are made of would be pushed down and compute them twice
    lines = materialize(_sets(docs, percent), "lines")
    sets = lines.where("n > 0")
    pick = [F.first(c).alias(c) for c in ("n", "parity", "prefix")]
    classes = sets.groupBy("k1", "k2").agg(F.min(F.struct("d", "l")).alias("at"), *pick)
    classes = materialize(classes.select("k1", "k2", "at.d", "at.l", "n", "parity", "prefix"), "classes")
    postings = classes.select("d", "l", "n", "parity", F.posexplode("prefix").alias("i", "key")).withColumn("i", F.col("i") + 1)
    at = F.struct("d", "l", "n", "parity", "i")
    heads = postings.groupBy("key").agg(F.min(at).alias("h"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("key", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("d", "l", "n", "parity", "i")])
    shared = materialize(postings.join(heads, "key").where("d <> hd or l <> hl"), "postings")

    ends = [F.col("hd").alias("xd"), F.col("hl").alias("xl"), F.col("d").alias("yd"), F.col("l").alias("yl")]
    pairs = materialize(shared.where(_alike(percent, "h", "")).select(*ends).distinct(), "pairs")
    settled = _confirmed(docs, pairs, percent)
    open_ = shared.join(settled, ["d", "l"], "left_anti")
    ends = [F.col(f"{t}.{c}").alias(f"{t}{c}") for t in "xy" for c in "dl"]
    later = F.expr("x.key = y.key and (x.d < y.d or x.d = y.d and x.l < y.l)")
    rest = materialize(shared.alias("x").join(open_.alias("y"), later & _alike(percent)).select(*ends).distinct(), "pairs")
    more = _confirmed(docs, rest, percent)
    # classes whose first line goes lose all lines, others all but the first
    matched = settled.union(more).distinct()
    named = classes.join(matched.withColumn("gone", F.lit(True)), ["d", "l"], "left")
    named = named.select("k1", "k2", F.col("d").alias("cd"), F.col("l").alias("cl"), F.coalesce("gone", F.lit(False)).alias("gone"))
    gone = sets.select("d", "l", "k1", "k2").join(named, ["k1", "k2"]).where("gone or d <> cd or l <> cl")
    gone = materialize(gone.select("d", "l"), "gone")
    discard(lines, classes, shared, pairs, rest, settled, more)
    return gone


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with its columns, the text without the lines that an earlier line matches.

    Where named, columns ``n_lines`` (before) and ``n_removed`` are added.
    """
    gone = removed_lines(docs.select("doc_id", "text"), percent)
    gone = gone.groupBy("d").agg(F.collect_set("l").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID))).join(gone, "d", "left")
    lines = F.split("row.text", "\n")
    rows = rows.withColumn("lines", lines).withColumn("kept", F.filter(lines, lambda line, i: ~F.array_contains("gone", i)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    before = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.coalesce(F.size("lines") - F.size("kept"), F.lit(0))).cast("long")
    rows = rows.select("row", text.alias("new text"), before.alias("n before"), lost.alias("n lost"))
    quoted = lambda c: "row.`" + c.replace("`", "``") + "`"
    added = [F.col(c).alias(name) for c, name in (("n before", n_lines), ("n lost", n_removed)) if name]
    return rows.select(*[F.col("new text").alias(c) if c == "text" else F.col(quoted(c)).alias(c) for c in docs.columns], *added)


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed of each document."""
    return without_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PERCENT, "n_lines", "n_removed")


#: The same in DuckDB: an exact prefix-filtered join, by word counts.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id AS d, CAST(i - 1 AS INTEGER) AS l, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), sets AS (
  SELECT d, l, list_sort(list_distinct([x FOR x IN string_split(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(13) || chr(11) || chr(12), 'abcdefghijklmnopqrstuvwxyz    '), ' ') IF x <> ''])) AS words FROM lines
), full_sets AS (
  SELECT d, l, words, len(words) AS n FROM sets WHERE len(words) > 0
), classes AS (
  SELECT words, n, min(struct_pack(d := d, l := l)) AS pos FROM full_sets GROUP BY words, n
), tokens AS (
  SELECT pos, n, unnest(words) AS w FROM classes
), rarity AS (
  SELECT w, count(*) AS f FROM tokens GROUP BY w
), ranked AS (
  SELECT pos, n, w, row_number() OVER (PARTITION BY pos ORDER BY f, w) AS i FROM tokens JOIN rarity USING (w)
), prefix AS (
  SELECT pos, n, w FROM ranked WHERE i <= n - CAST(ceil({PERCENT} * n / 100.0) AS INTEGER) + 1
), pairs AS (
  SELECT DISTINCT x.pos AS a, y.pos AS b FROM prefix x JOIN prefix y ON x.w = y.w AND x.pos < y.pos AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)
), matched AS (
  SELECT DISTINCT b FROM pairs JOIN classes x ON x.pos = a JOIN classes y ON y.pos = b
  WHERE 100 * len(list_intersect(x.words, y.words)) >= {PERCENT} * (x.n + y.n - len(list_intersect(x.words, y.words)))
), gone AS (
  SELECT s.d, s.l FROM full_sets s JOIN classes c USING (words)
  WHERE s.d <> c.pos.d OR s.l <> c.pos.l OR c.pos IN (SELECT b FROM matched)
), kept AS (
  SELECT d, string_agg(line, chr(10) ORDER BY l) AS text FROM lines WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.d = lines.d AND gone.l = lines.l) GROUP BY d
), sizes AS (
  SELECT d, count(*) AS n_lines FROM lines GROUP BY d
), losses AS (
  SELECT d, count(*) AS n_removed FROM gone GROUP BY d
)
SELECT doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents t LEFT JOIN kept ON kept.d = doc_id LEFT JOIN sizes ON sizes.d = doc_id LEFT JOIN losses ON losses.d = doc_id
"""
