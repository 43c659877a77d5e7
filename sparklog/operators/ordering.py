"""Places in an order over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.sources.files import stored

#: What a log's table may be sorted by, and the column that has it (of those that the log has).
SORTABLE = {
    "number": "record_id", "event_id": "event_code", "level": "level", "timestamp": "ts", "computer": "computer", "channel": "channel", "user": "user_name", "source": "source_file",
    "record_id": "record_id", "provider": "provider", "keywords": "keywords", "opcode": "opcode", "log": "channel", "process_id": "pid", "thread_id": "tid", "correlation_id": "activity_id",
}


def sort_order(df: DataFrame, name: str, descending: bool = False) -> list[Column] | None:
    """Order by one of ``SORTABLE``, missing values last, then by time and record; none for other names."""
    column = SORTABLE.get(name)
    if column not in df.columns:
        return None
    way = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return [way, *[F.col(c) for c in ("ts", "record_id", "source_file") if c in df.columns]]


def sorted_by(df: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """``df`` in that order; as it is for names that can't be sorted by."""
    order = sort_order(df, name, descending)
    return df.orderBy(*order) if order else df


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``df`` with the place, from 1, of each row in ``order`` (which should leave no ties).

    Rows are sorted by ranges and stored; a row's place is its number within its range, and the number of all
    rows of the ranges before.  Only the sizes of the ranges, one row each, meet in one task.
    """
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_inner", inner), "sorted")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_range", before.alias("_base"))
    return rows.join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_inner") + 1).drop("_range", "_inner", "_base")


def mixed_order(value: Column) -> list[Column]:
    """Numbers first, by value, then texts without regard to case."""
    number = value.try_cast("double")
    return [number.isNull(), number, F.lower(value), value]
