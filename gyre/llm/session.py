"""What the operators take from the session: shared folders, and the package on the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gyre.scratch import shared_dir, written
from gyre.shipping import ship

__all__ = ["shared_dir", "shipped", "written"]


#: Rows in one Arrow batch of the Python operators at most: with texts of some KB, a few MB.
BATCH_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shipped(df: DataFrame) -> DataFrame:
    """Before Python over Arrow: send the package to the workers, and bound the rows of their batches.

    The bound is a setting of the session that plans read when they run, so it stays; a lower one is kept.
    """
    ship(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get(_ROWS)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS, str(BATCH_ROWS))
    return df
