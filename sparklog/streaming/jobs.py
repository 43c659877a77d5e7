"""Streaming twins of log operators.  Each takes a streaming (or batch) log and returns a DataFrame.

Event time is ``ts``; in append mode (``run``) what comes later than the watermark is left out, and
windows that the watermark hasn't passed stay open.  ``run`` drives a query over all rows that are
there and reads its sink back; ``run_whole`` does so in complete mode, which gives open windows, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.sources.audit_log import audit_view
from sparklog.sources.files import shared_path
from sparklog.sources.security_log import _VIEW, _split

LATE = "10 minutes"


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log view over files of events as they arrive."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.selectExpr(*_split(_VIEW)).withColumn("ts", F.col("ts").cast("timestamp"))


def deduped(log: DataFrame) -> DataFrame:
    """One row per record of a file."""
    return log.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["source_file", "record_id"])


def failure_counts(log: DataFrame, least: int = 3, length: str = "1 day", step: str = "6 hours") -> DataFrame:
    """Sliding windows of failures per host."""
    failed = log.where("event_code = 4625").withWatermark("ts", LATE)
    counts = failed.groupBy(F.window("ts", length, step), "computer").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "computer", "n")


def activity_sessions(log: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    rows = log.withWatermark("ts", LATE)
    return rows.groupBy(F.session_window("ts", gap), "user_name").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_name", "n")


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log over files of events as they arrive, with its time as ``ts``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return audit_view(events).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_704_067_200))


def run(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write all that is there to a Parquet sink in the shared folder, and read it."""
    path = shared_path(spark, name)
    started = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_whole(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """As ``run`` for windows and sessions, with those still open at the end: each trigger writes all groups, the last one is read."""
    path = shared_path(spark, name)
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(f"{path}/{number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(spark, f"{name}-state")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(written[-1]) if written else spark.createDataFrame([], df.schema)
