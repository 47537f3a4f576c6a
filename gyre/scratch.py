"""Folders for what a job writes on its way: shared by driver and executors, gone when the driver ends."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_OPEN: list[list] = []


@contextmanager
def cleared():
    """Folders that are made inside go when the block ends: for a driver that lives on, once results have been written.

    Frames that operators returned inside read these folders and cannot be used after it.
    """
    made: list = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for files, where in made:
            files.delete(where, True)


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one of the cluster (``spark.checkpoint.dir``), deleted when the driver ends.

    Only where that setting is absent and the session runs on one machine, as in tests, a temporary folder takes
    its place; on a cluster its absence is an error, since executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gyre-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    if _OPEN:
        _OPEN[-1].append((files, where))
    return f"{path}/data"


def written(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut of the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
