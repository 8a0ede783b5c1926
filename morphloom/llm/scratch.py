"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

from ..plans.lineage import new_path, stored

__all__ = ["bounded_batches", "give_back", "new_path", "stored"]

ARROW_BYTES = "2m"
ARROW_ROWS = 500


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small in bytes, so that a few very long texts can't fill a Python worker.

    Spark reads these settings when a plan runs, and what the operators return runs after them: so they stay set.
    """
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
