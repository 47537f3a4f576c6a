"""Sharding by extendible hashing.

A row's hash bits are those of the SHA-256 of its identifier. A bucket is a prefix of these bits. The
directory maps prefixes to buckets; a bucket whose bytes exceed the limit splits on its next bit, and
only such a bucket does. Byte counts are summed by prefixes of a depth that fits the input, then over
all shorter prefixes at once; prefixes that are still too large are counted again some bits deeper.
All of it is DataFrame operations on the JVM.

Cases: a null text has no bytes; a null identifier hashes as the empty string; a single text above the limit is a shard of its own, and
rows that share an identifier cannot be parted, so that their shard is one of the deepest: both are marked
``oversized``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that the directory may use.
MAX_DEPTH = 60
#: Bits by which the first count goes beyond the depth of evenly filled shards, and each later one beyond the last.
SPARE, DEEPER = 4, 14
SHARD_BYTES = 1 << 20


def hash_bits(id_col: str) -> Column:
    """The first 60 bits of the SHA-256 of the identifier as a long."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the 60 bits, as a number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(MAX_DEPTH) - depth).cast("int"))


def directory(sized: DataFrame, limit: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets of rows (_bits, _bytes): depth, prefix, shard_bytes, shard_rows, oversized.

    Each pass sums the rows of the prefixes that are still too large, so the number of passes follows
    the excess depth of the fullest bucket, not the number of buckets.
    """
    if limit <= 0:
        raise ValueError(f"a shard holds at least one byte: limit {limit}")
    spark = sized.sparkSession
    total = sized.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("n")).first()["n"]
    lo, hi = 0, min(max_depth, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    left, found = sized, []
    while True:
        fine = left.groupBy(prefix(F.col("_bits"), hi).alias("_p")).agg(
            F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
        )
        by_depth = (
            fine.select("_p", "_bytes", "_rows", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth"))
            .withColumn("prefix", F.call_function("shiftright", "_p", (F.lit(hi) - F.col("depth")).cast("int")))
            .groupBy("depth", "prefix")
            .agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"))
        )
        splits = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        above = by_depth.where(splits).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        # A bucket of the directory fits while the bucket that it was split from does not.
        leaf = by_depth.where(~splits | (F.col("depth") == max_depth))
        found.append(
            leaf.where(F.col("depth") == 0).unionByName(leaf.where(F.col("depth") > lo).join(above, ["depth", "prefix"], "left_semi"))
            if lo == 0
            else leaf.where(F.col("depth") > lo).join(above, ["depth", "prefix"], "left_semi")
        )
        if hi == max_depth:
            break
        over = by_depth.where((F.col("depth") == hi) & splits).select(F.col("prefix").alias("_over"))
        if over.isEmpty():
            break
        left = left.join(over, prefix(F.col("_bits"), hi) == F.col("_over"), "left_semi")
        lo, hi = hi, min(max_depth, hi + DEEPER)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("oversized", F.col("shard_bytes") > limit)


def extendible_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Each row's shard: id, n_bytes, depth, shard_id (the prefix in bits), shard_bytes, shard_rows, oversized.

    The rows find their bucket through the directory: its entries at the depths in use (at most
    ``max_depth`` + 1 of them) are tried by joins on equal prefixes.
    """
    rows = df.select(
        F.col(id_col).alias(id_col),
        hash_bits(id_col).alias("_bits"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes"),
    )
    buckets = directory(rows.select("_bits", "_bytes"), limit, max_depth)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())
    keys = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else rows.withColumn("depth", F.lit(0))
    keys = keys.withColumn("prefix", prefix(F.col("_bits"), F.col("depth")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    )
    return keys.join(buckets, ["depth", "prefix"]).select(
        id_col,
        F.col("_bytes").alias("n_bytes"),
        F.col("depth").cast("int").alias("depth"),
        bits.alias("shard_id"),
        "shard_bytes",
        "shard_rows",
        "oversized",
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write ``df`` as Parquet with one folder for each shard, ``shard_id=...``; a column of that name gives way."""
    shards = extendible_shards(df, id_col, text_col, limit).select(F.col(id_col).alias("_shard_of"), "shard_id").distinct()
    rows = df.drop("shard_id")
    rows.join(shards, rows[id_col].eqNullSafe(F.col("_shard_of"))).drop("_shard_of").repartition("shard_id").write.partitionBy("shard_id").parquet(path)
