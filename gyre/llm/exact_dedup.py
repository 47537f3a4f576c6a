"""Exact deduplication as a stateful stream.

The documents are read as a stream of files. Keyed state on local disk (RocksDB), saved to the shared
folder with every micro-batch and never expired, holds for each digest the identifier that stays, the
number of rows and the locator of the content (the identifier's row in the source). Rows whose digest
was seen are hits: their full bytes are grouped under the digest, so that two texts that only share a
digest part again. All of it is DataFrame operations on the JVM.

Cases: a null text counts as the empty text; a null identifier is a row like any other and loses to
every identifier; rows that repeat an identifier all count, and share ``kept``; other columns of the
input are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.session import shared_dir, written

#: State on disk. Without the second setting each store takes some MB of disk ahead, however few its keys; the others bound
#: the memory that all stores of an executor share, whatever their number.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

#: The least and the most bytes of files in a micro-batch, unless it is told.
BATCH_BYTES = (64 << 20, 64 << 30)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    max_bytes_per_batch: int | None = None,
    locators: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; the largest id of equal texts stays.

    ``path`` is a Parquet file, folder or pattern as Spark's readers take it, ``digest`` a function of the text
    column (the check on full bytes makes the result the same for any), ``max_bytes_per_batch`` bounds a
    micro-batch: by default an eighth of the files, in bounds of its own (``BATCH_BYTES``). ``locators`` adds keep_file and keep_row, where the text that stays is found.
    """
    source = spark.read.parquet(path)
    if max_bytes_per_batch is None:
        size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        max_bytes_per_batch = min(BATCH_BYTES[1], max(BATCH_BYTES[0], size // 8))
    rows = _rows(source, id_col, text_col, digest)
    state = _state(spark, path, rows, id_col, text_col, digest, max_bytes_per_batch)
    hits = rows.join(state.where("_n > 1").select("_digest"), "_digest", "left_semi")
    classes = hits.groupBy("_digest", "_text").agg(F.max("_at").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    shared = classes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_classes")).where("_classes > 1").select("_digest")
    shared = written(shared, "exact-dedup-shared")
    plain = rows.drop("_text").join(state, "_digest").join(shared, "_digest", "left_anti")
    if shared.isEmpty():
        return _named(plain, id_col, locators)
    parted = rows.join(shared, "_digest", "left_semi").join(classes, ["_digest", "_text"])
    columns = ["_at", "_sha", "_keep", "_n"]
    return _named(plain.select(*columns).unionByName(parted.select(*columns)), id_col, locators)


def _named(rows: DataFrame, id_col: str, locators: bool) -> DataFrame:
    return rows.select(
        F.col("_at.id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_at.id").eqNullSafe(F.col("_keep.id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_keep.file").alias("keep_file"), F.col("_keep.row").alias("keep_row")] if locators else []),
    )


def _rows(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Identifier with locator (_at), text, digest and SHA-256 of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(at.alias("_at"), text.alias("_text"), digest(text).alias("_digest"), sha256(text).alias("_sha"))


def _state(spark, path, rows, id_col, text_col, digest, max_bytes) -> DataFrame:
    """Run the stream to its end; the last state of each digest: _digest, _keep (identifier and locator), _n."""
    place = shared_dir(spark, "exact-dedup")
    updates = f"{place}/updates"
    with settings(spark, STATE):
        schema = spark.read.parquet(path).select(id_col, text_col).schema
        # A pattern, since a stream takes a single file by a pattern only.
        files = f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(files)
        keyed = _rows(stream, id_col, text_col, digest).groupBy("_digest")
        query = (
            keyed.agg(F.max("_at").alias("_keep"), F.count(F.lit(1)).alias("_n"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{place}/checkpoint")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    kind = rows.schema["_at"].dataType.simpleString()
    empty = spark.createDataFrame([], f"_digest string, _keep {kind}, _n bigint")
    if not _exists(spark, updates):
        return empty
    seen = spark.read.schema(empty.schema).parquet(f"{updates}/batch=*")
    return seen.groupBy("_digest").agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Set settings of the session for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
