"""Windowed means and tidal filters of streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.operators.filters import least_weight, tidal_weights


def resample(df: DataFrame, keys: list[str], time: str, v: str, width: str = "3 hours", late: str | None = None) -> DataFrame:
    """Means over tumbling windows: keys, start, v, n. For streams ``late`` is the watermark; it works on tables too."""
    rows = df.withWatermark(time, late) if late else df
    out = rows.groupBy(F.window(time, width), *keys).agg(F.avg(v).alias(v), F.count(v).alias("n"))
    return out.select(*keys, F.col("window.start").alias("start"), v, "n")


def tidal_resample(df: DataFrame, keys: list[str], time: str, v: str, name: str = "demerliac", na_thres: float = 0.0, late: str | None = None) -> DataFrame:
    """Hourly means through a tidal filter, for streams and tables: keys, hour (the filter's centre), v.

    Hours are tumbling windows, the filter sliding ones of its length over them, so that the state is bounded by the
    filter and the watermark ``late``: an hour comes out when all that its filter reaches has come in. Hours without
    a row, or with missing values only, have no weight; where too little weight is left there is no row. No key
    may be called ``window``.
    """
    weights = np.array(tidal_weights(name))
    rows = df.withWatermark(time, late) if late else df
    hourly = rows.groupBy(F.window(time, "1 hour"), *keys).agg(F.avg(v).alias("_v"))
    near = hourly.select(*keys, "_v", F.col("window.start").alias("_hour"), F.window("window", f"{len(weights)} hours", "1 hour").alias("_near"))
    # Differences of instants are taken in seconds, since days of the session's time zone may have 23 or 25 hours.
    seconds = F.unix_seconds if df.schema[time].dataType.typeName() == "timestamp" else lambda c: F.expr(f"CAST(CAST({c} - TIMESTAMP_NTZ '1970-01-01' AS INTERVAL SECOND) AS BIGINT)")
    place = ((seconds("_hour") - seconds("_near.start")) / 3600).cast("int")
    near = near.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1))
    sums = near.groupBy("_near", *keys).agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_q"))
    hour = F.col("_near.start") + F.expr(f"INTERVAL {len(weights) // 2} HOURS")
    return sums.where(F.col("_q") > least_weight(weights, na_thres)).select(*keys, hour.alias("hour"), (F.col("_s") / F.col("_q")).alias(v))
