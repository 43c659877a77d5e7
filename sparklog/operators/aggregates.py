"""Value counts, capture differences and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_metadata(df: DataFrame, columns: list[str], blank: str = "N/A") -> DataFrame:
    """Counts of each value of each column, in one scan and one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(blank)).alias("val")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.name", "p.val").agg(F.count("*").alias("n"))


def column_values(df: DataFrame, column: str, others: Column, part: str | None = None, most: int = 1000) -> DataFrame:
    """The most frequent values of a column under the filters of all other columns."""
    rows = df.where(others)
    if part:
        rows = rows.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(part.lower())))
    return rows.groupBy(F.col(column).alias("val")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "val").limit(most)


def capture_diff(baseline: DataFrame, incident: DataFrame, keys: list[str], factor: float = 3.0) -> DataFrame:
    """Keys that are new, missing, or changed by ``factor`` between two captures."""
    b = baseline.groupBy(*keys).agg(F.count("*").alias("before"))
    i = incident.groupBy(*keys).agg(F.count("*").alias("after"))
    both = b.join(i, keys, "full_outer").na.fill(0, ["before", "after"])
    kind = F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "missing").when(F.col("after") >= factor * F.col("before"), "spike").when(F.col("before") >= factor * F.col("after"), "drop").otherwise("same")
    return both.withColumn("kind", kind).withColumn("ratio", F.round(F.col("after") / F.when(F.col("before") > 0, F.col("before")), 6))


def record_accounting(df: DataFrame, file: str = "source_file", status: str = "status") -> DataFrame:
    """Per file: records seen, and how each ended; ``whole`` if the parts add up."""
    of = lambda *names: F.sum(F.col(status).isin(*names).cast("long"))
    out = df.groupBy(file).agg(F.count("*").alias("seen"), of("malformed").alias("malformed"), of("filtered").alias("filtered"), of("ok").alias("kept"))
    return out.withColumn("whole", F.col("seen") == F.col("malformed") + F.col("filtered") + F.col("kept"))


def cooccurrence(indicators: DataFrame, per_type: int = 500, most: int = 100, high: int = 10, medium: int = 5) -> DataFrame:
    """Pairs of indicators (ioc_type, val) by the number of contexts (a column ``context``) that both are in.

    The ``per_type`` most frequent of each type and the ``most`` frequent pairs are the report's limits.
    A context meets itself by an equi join on the context alone, over the kept indicators.
    """
    from pyspark.sql import Window as W

    counts = indicators.groupBy("ioc_type", "val").agg(F.count("*").alias("c"))
    kept = counts.withColumn("r", F.row_number().over(W.partitionBy("ioc_type").orderBy(F.desc("c"), "val"))).where(F.col("r") <= per_type)
    rows = indicators.select("ioc_type", "val", "context").distinct().join(kept.select("ioc_type", "val"), ["ioc_type", "val"], "left_semi")
    key = F.concat_ws(":", "ioc_type", "val")
    a, b = rows.select("context", key.alias("a")), rows.select("context", key.alias("b"))
    pairs = a.join(b, "context").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    level = F.when(F.col("together") > high, "high").when(F.col("together") >= medium, "medium").otherwise("low")
    return pairs.withColumn("confidence", level).orderBy(F.desc("together"), "a", "b").limit(most)
