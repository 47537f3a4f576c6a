"""Grids, profiles and points derived from the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.operators.filters import regular_hours


#: Takes values off round decimals, so that no engine's rounding meets a tie.
SCALE = 1.0001237
#: Rows of profiles that one task sorts, about.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 360 - 180).cast("double").alias("lon"),
        (F.col("c_custkey") * 53 % 171 - 85).cast("double").alias("lat"), F.col("c_acctbal").alias("value"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 73 % 360 - 180).cast("double").alias("lon"),
        (F.col("s_suppkey") * 29 % 171 - 85).cast("double").alias("lat"), F.col("s_acctbal").alias("value"),
    )


POINTS = """
c AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 53 % 171 - 85 AS DOUBLE) AS lat, c_acctbal AS value FROM customer),
s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 73 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey * 29 % 171 - 85 AS DOUBLE) AS lat, s_acctbal AS value FROM supplier)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of layers: prof, lvl, dz, v (missing for large discounts), y (depth of the layer's end)."""
    li = table(spark, sf_dir, "lineitem")
    # All that follows sorts by profile in these tasks, whose memory stays the same however many rows there are.
    li = li.repartition(max(spark.sparkContext.defaultParallelism, -(-li.count() // TASK_ROWS)), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    rows = li.select(
        F.col("l_orderkey").alias("prof"), F.row_number().over(order).alias("lvl"), F.col("l_quantity").alias("dz"),
        F.when(F.col("l_discount") <= 0.08, F.col("l_extendedprice") * SCALE).alias("v"), F.col("l_tax").alias("w"),
    )
    return rows.withColumn("y", F.sum("dz").over(Window.partitionBy("prof").orderBy("lvl")))


LEVELS = """
l AS (SELECT l_orderkey AS prof, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS INTEGER) AS lvl,
        l_quantity AS dz, CASE WHEN l_discount <= 0.08 THEN l_extendedprice * 1.0001237::DOUBLE END AS v, l_tax AS w FROM lineitem),
p AS (SELECT *, sum(dz) OVER (PARTITION BY prof ORDER BY lvl) AS y FROM l)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of 40 columns: i, j, v (missing for small parts), lon, lat."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % 40).cast("int").alias("i"), F.floor(F.col("p_partkey") / 40).cast("int").alias("j"),
        F.when(F.col("p_size") >= 10, F.col("p_retailprice")).alias("v"),
    ).withColumns({"lon": F.col("i") * 2.0 + F.lit(0.0), "lat": F.col("j") * 3.0})


CELLS = """
f AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS i, CAST(p_partkey // 40 AS INTEGER) AS j,
        CASE WHEN p_size >= 10 THEN p_retailprice END AS v, CAST(p_partkey % 40 AS DOUBLE) * 2 AS lon, CAST(p_partkey // 40 AS DOUBLE) * 3 AS lat FROM part)"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of event values by type, every hour present: event_type, hour, value."""
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value") * SCALE)
    return regular_hours(events, ["event_type"], "ts", "value")


HOURS = """
g AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value * 1.0001237::DOUBLE) AS value FROM events GROUP BY ALL),
r AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM g GROUP BY event_type),
h AS (SELECT r.event_type, r.hour, g.value FROM r LEFT JOIN g ON r.event_type = g.event_type AND r.hour = g.hour)"""
