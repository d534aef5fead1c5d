"""Size-checked broadcasts and bounded batches of the operators; tables go to the shared folder by ``operators.store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.store import clear, materialize, shared_dir  # noqa: F401

#: A side is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 1 << 19
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker, where the session doesn't say: by default it is 10,000 texts of any length.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session sends texts to workers in batches of about ``BATCH_BYTES``, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, BATCH_BYTES)
    return df


def whole_id(name: str = "doc_id") -> Column:
    """An id as a whole number; ids that are none, such as texts, read as null."""
    return F.col(name).try_cast("long").alias(name)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint if the (already materialized) table is counted to be small, else leave it to a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
