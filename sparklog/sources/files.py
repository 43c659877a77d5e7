"""Readers and writers: columnar logs, exports, threat lists, detections, manifests."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.scalars import squeeze, xml_text


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; a temporary one in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and outlives its executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_log(df: DataFrame, path: str, ts: str = "ts", record: str = "record_id") -> None:
    """Columnar log: each file sorted by time (missing last) and record, so that row groups can be skipped."""
    ordered = df.sortWithinPartitions(F.col(ts).asc_nulls_last(), record)
    ordered.write.option("compression", "zstd").option("maxRecordsPerFile", 5_000_000).parquet(path)


def read_log(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def field_names(df: DataFrame, fields: str = "fields") -> list[str]:
    """Distinct names in a map column, sorted; the names of a log's schema, not its values, reach the driver."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys(fields)).alias("name")).distinct().collect())


def with_field_columns(df: DataFrame, names: list[str], fields: str = "fields", prefix: str = "ED_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != fields], *[F.col(fields)[n].alias(prefix + n) for n in names])


def write_csv(df: DataFrame, path: str, fields: str = "fields", tags: str | None = None) -> None:
    """CSV with a column per field name; tags as ``tid:name`` list; control characters become blanks."""
    wide = with_field_columns(df, field_names(df, fields), fields)
    if tags:
        wide = wide.withColumn(tags, F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["tid"], t["tactic"])), "; "))
    clean = [squeeze(F.col(c), None).alias(c) if kind == "string" else F.col(c) for c, kind in wide.dtypes]
    wide.select(*clean).write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_xml(df: DataFrame, path: str, row: str = "event") -> None:
    """XML rows; text that XML can't hold is shown as escapes."""
    clean = [F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "?").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    df.select(*clean).write.format("xml").option("rowTag", row).option("rootTag", "events").save(path)


def xml_lines(df: DataFrame, columns: list[str], row: str = "event") -> DataFrame:
    parts = [F.concat(F.lit(f"<{c}>"), xml_text(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(f"</{c}>")) for c in columns]
    return df.select(F.concat(F.lit(f"<{row}>"), *parts, F.lit(f"</{row}>")).alias("line"))


def read_threat_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ioc_type, val, verdict) of a list with one to three columns; a missing type is guessed, a missing verdict is bad."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(parts.alias("p"))
    first, second, third = (F.get("p", F.lit(i)) for i in range(3))
    typed = F.size("p") >= 2
    val = F.when(typed, second).otherwise(first)
    return threat_rows(rows.select(F.when(typed, first).alias("ioc_type"), val.alias("val"), F.coalesce(third, F.lit("bad")).alias("verdict")))


def read_threat_stix(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of a STIX bundle; the verdict comes from the labels."""
    bundle = spark.read.option("multiLine", True).schema("objects array<struct<type: string, pattern: string, labels: array<string>>>").json(path)
    rows = bundle.select(F.explode("objects").alias("o")).where("o.type = 'indicator'").select("o.pattern", "o.labels")
    kind = F.regexp_extract("pattern", r"\[([a-z0-9-]+):", 1)
    names = F.when(kind == "ipv4-addr", "ipv4").when(kind == "domain-name", "domain").when(kind == "url", "url")
    verdict = F.when(F.array_contains("labels", "benign"), "known").otherwise("bad")
    return threat_rows(rows.select(names.alias("ioc_type"), F.regexp_extract("pattern", r"=\s*'([^']*)'", 1).alias("val"), verdict.alias("verdict")))


def threat_rows(rows: DataFrame) -> DataFrame:
    """Lower-cased values, guessed types, one row per (ioc_type, val)."""
    v = F.lower(F.trim("val"))
    guess = F.when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4").when(v.rlike("^[0-9a-f]{32}$"), "md5").when(v.rlike("^[0-9a-f]{40}$"), "sha1").when(v.rlike("^[0-9a-f]{64}$"), "sha256").when(v.rlike("^https?://"), "url").otherwise("domain")
    return rows.select(F.coalesce("ioc_type", guess).alias("ioc_type"), v.alias("val"), "verdict").where("val <> ''").dropDuplicates(["ioc_type", "val"])


def detection_chains(df: DataFrame) -> DataFrame:
    """Chains of external detections (rule, computer, level, ts): one per rule and host."""
    severity = F.when(F.lower("level").isin("critical", "crit"), 0).when(F.lower("level") == "high", 1).when(F.lower("level").isin("medium", "med"), 2).otherwise(3)
    return df.groupBy("rule", "computer").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(severity).alias("severity"))


#: Files up to this length are hashed as one value; endings of files that Spark's text reader would decompress.
WHOLE, PACKED = 1 << 26, (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each input file that isn't empty.

    A value can't hold 2 GB, so that files over ``WHOLE`` are read as lines, but for those with an ending of a
    compression: only these are held whole, and fail over 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    of = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    out = of(files.where(F.col("length") <= WHOLE))
    # names of files over 64 MB only
    long = [r[0] for r in files.where(F.col("length") > WHOLE).select("path").collect()]
    packed = [p for p in long if p.endswith(PACKED)]
    lines = [p for p in long if not p.endswith(PACKED)]
    if packed:
        out = out.union(of(spark.read.format("binaryFile").load([_plain(p) for p in packed])))
    if lines:
        out = out.union(_line_digests(spark, lines))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


def _plain(path: str) -> str:
    """``path`` without a pattern's meaning."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def _line_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and sha256 of files of any length, read as lines of bytes, a batch of them at a time.

    A hash goes through its file in order, so that a file is one task's; files are dealt over tasks.  A line must be
    shorter than 2 GB.
    """
    # settings of a session of its own: a split is a file
    own = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", str(1 << 50))
    rows = own.read.option("lineSep", "\n").text([_plain(p) for p in paths])
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("line"))
    out, schema = shared_path(spark, "digests"), "path string, length long, sha256 string"
    rows.mapInArrow(_digest, schema).write.parquet(out)
    return spark.read.schema(schema).parquet(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files of lines (path, length of the file, line), each file's rows in order.

    The reader leaves out a byte order mark and doesn't tell whether the last line is ended; what is missing of the
    file's length tells both.
    """
    mark, current, plain, marked, read = b"\xef\xbb\xbf", None, None, None, 0

    def digest() -> pa.RecordBatch:
        path, length = current
        if length - read not in (0, 1, 3, 4):
            raise ValueError(f"{path}: {read} bytes read of {length}")
        found = marked if length - read >= 3 else plain
        if (length - read) % 3 == 1:
            found.update(b"\n")
        return pa.RecordBatch.from_pydict({"path": [unquote(path)], "length": [length], "sha256": [found.hexdigest()]})

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            names = batch.column(0)
            file, end = names[start].as_py(), batch.num_rows
            if names[end - 1].as_py() != file:
                end = start + pc.sum(pc.equal(names[start:], file)).as_py()
            data = b"\n".join(batch.column(2)[start:end].to_pylist())
            if current is None or current[0] != file:
                if current:
                    yield digest()
                current, plain, marked, read = (file, batch.column(1)[start].as_py()), hashlib.sha256(), hashlib.sha256(mark), 0
            else:
                data = b"\n" + data
            plain.update(data)
            marked.update(data)
            read, start = read + len(data), end
    if current:
        yield digest()
