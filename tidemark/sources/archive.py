"""The segment archive: listing, fetching, copying what is missing, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.segments import is_history, is_partial, is_segment, parse_segment_name
from tidemark.operators.joins import missing_segments
from tidemark.operators.ordering import MIN_KEEP, retention_plan
from tidemark.session import cut_lineage
from tidemark.sources.storage import Schemes, delete_file, list_files, read_file, store_file


def catalog_rows(files: DataFrame) -> DataFrame:
    """Catalog of files ``(name, ...)``: complete, partial and history files; others are ignored."""
    n = F.col("name")
    state = F.when(is_segment(n), "complete").when(is_partial(n), "partial").when(is_history(n), "history")
    s = parse_segment_name(n)
    history_timeline = F.when(is_history(n), F.conv(F.substring(n, 1, 8), 16, 10).cast("bigint"))
    return files.withColumn("state", state).where(F.col("state").isNotNull()).withColumns({
        "timeline": F.coalesce(s["timeline"], history_timeline), "seg_no": s["seg_no"],
        "start_lsn": s["start_lsn"], "end_lsn": s["end_lsn"]})


def scan_segment_catalog(spark: SparkSession, path: str, schemes: Schemes | None = None) -> DataFrame:
    """Listing of an archive folder and the folders in it, made by tasks; file contents are not read."""
    return catalog_rows(list_files(spark, path, schemes).select("name", "path", "length", F.col("modified").alias("modificationTime")))


def fetch_segments(spark: SparkSession, path: str, names: DataFrame, schemes: Schemes | None = None) -> DataFrame:
    """Bytes of the named segments; a name that is not in the archive yields no row. Names meet the
    listing, which has no contents, and then the tasks open only the files that are wanted."""
    listed = list_files(spark, path, schemes).select("name", "path", "length")
    wanted = listed.where(is_segment(F.col("name"))).join(names.select("name").distinct(), "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = read_file(row["path"], schemes)
                if content is not None:
                    yield pa.RecordBatch.from_pylist([{**row, "content": content}])

    return wanted.select("name", "path", "length").mapInArrow(read, "name string, path string, length bigint, content binary")


def copy_missing_segments(spark: SparkSession, archive: str, local: str, redo: str, per_timeline: bool = False,
                          schemes: Schemes | None = None) -> DataFrame:
    """Store every missing segment at or after redo under ``local``, a folder all workers reach, and
    report ``(name, fetched, error)``: fetched only if the file is there with the archive's content. A
    failed item is reported and the others go on. Running the job again, or a task again after a lost
    executor, copies nothing twice and overwrites nothing. The missing set is fixed before the first copy."""
    missing = missing_segments(scan_segment_catalog(spark, archive, schemes), scan_segment_catalog(spark, local, schemes), redo, per_timeline)
    missing = cut_lineage(missing)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    problem = store_file(f"{local.rstrip('/')}/{name}", content, schemes)
                except OSError as error:
                    problem = str(error)
                yield pa.RecordBatch.from_pylist([{"name": name, "fetched": problem is None, "error": problem}], schema=pa.schema(
                    [("name", pa.string()), ("fetched", pa.bool_()), ("error", pa.string())]))

    fetched = fetch_segments(spark, archive, missing, schemes)
    return fetched.select("name", "content").mapInArrow(store, "name string, fetched boolean, error string")


def apply_retention(spark: SparkSession, path: str, keep: int, dry_run: bool = True, schemes: Schemes | None = None) -> DataFrame:
    """Retention plan of an archive folder ``(name, action, deleted, error)``; with ``dry_run=False`` the
    workers also delete what the plan says. ``deleted`` means the file is gone; else ``error`` says what
    kept it. The plan is a fixed table before anything is deleted."""
    if keep < MIN_KEEP:
        raise ValueError(f"keep must be at least {MIN_KEEP}")
    catalog = scan_segment_catalog(spark, path, schemes).select("name", "path")
    plan = retention_plan(catalog, keep)
    if dry_run:
        return plan.select("name", "action", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("error"))
    fixed = cut_lineage(plan)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, file, action in zip(*(batch.column(c).to_pylist() for c in ("name", "path", "action"))):
                problem = None
                if action == "delete":
                    try:
                        delete_file(file, schemes)
                    except OSError as error:
                        problem = str(error)
                rows.append((name, action, action == "delete" and problem is None, problem))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()))],
                                             ["name", "action", "deleted", "error"])

    return cut_lineage(fixed.mapInArrow(prune, "name string, action string, deleted boolean, error string"))
