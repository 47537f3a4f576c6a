"""Ranks without a task that holds them all: rows are dealt by ranges, and each range counts from where the last one ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.scratch import written

#: Bits of a row's number within its task, as ``monotonically_increasing_id`` gives it.
_WITHIN_TASK = 33


def ranked(df: DataFrame, order: list[str | Column], within: list[str] = (), rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add ``rank``, from 0 on by ``order`` within each key, and ``total``, the key's number of rows, if it is named.

    The rows are dealt by ranges of keys and order, and sorted within them, so that a key with most of the rows is
    spread over many tasks. Only the counts of ranges meet, a row for each key in each of them. Keys must not be null;
    rows that are equal in the order have any ranks among themselves. An empty table gives no rows. The ranges are
    written to the shared folder, since their places would change with a second run of the input.
    """
    spread = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    placed = written(spread.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", _WITHIN_TASK))
    counts = placed.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_key = Window.partitionBy(*within)
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_rows").over(of_key))
    counts = written(counts.drop("_rows"), "range-counts")
    out = placed.join(counts, ["_part", *within]).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, rank, *([total] if total else []))


def following(df: DataFrame, order: str, columns: list[str], within: list[str] = ()) -> DataFrame:
    """Add ``next_<column>``, a column's value in the next row by ``order`` within each key, null at the last one.

    As a window gives it, but where keys are few no task holds all rows of one.
    """
    placed = ranked(df, [order], within, "_rank")
    after = placed.select(*within, (F.col("_rank") - 1).alias("_rank"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return placed.join(after, [*within, "_rank"], "left").drop("_rank")
