"""Retention whenever a segment completes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.segments import is_segment
from tidemark.operators.ordering import MIN_KEEP
from tidemark.sources.archive import apply_retention
from tidemark.sources.storage import Schemes


def retention_job(
    arrivals: DataFrame, archive: str, keep: int, checkpoint: str, report: str,
    dry_run: bool = True, trigger: dict | None = None, schemes: Schemes | None = None,
) -> StreamingQuery:
    """Plan retention after each batch of completed segment names, and delete only when told to.
    The report folder holds one plan per batch, with what was deleted and what an error kept; timelines
    under the limit have nothing to delete."""
    if keep < MIN_KEEP:
        raise ValueError(f"keep must be at least {MIN_KEEP}")

    def prune(batch: DataFrame, batch_id: int) -> None:
        if batch.where(is_segment(F.col("name"))).isEmpty():
            return
        plan = apply_retention(batch.sparkSession, archive, keep, dry_run, schemes)
        plan.where(F.col("action") == "delete").write.mode("overwrite").parquet(f"{report}/batch={batch_id}")

    return (arrivals.writeStream.foreachBatch(prune).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
