"""Size of the batches in which texts reach Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of a batch: 10,000 long texts would fill a Python worker."""
    now = spark.conf.get(_SETTING).lower().removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))
