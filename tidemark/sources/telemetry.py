"""Text telemetry: metric snapshots, flush logs, log lines, host samples and benchmark logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.lines import MAX_LINE_BYTES, clip_line, utf8_lossy
from tidemark.session import small_side

FLUSH_COUNTERS = ("packs_uploaded", "bytes_uploaded", "blocks_claimed", "blocks_cross_deduped")


def metric_rows(lines: DataFrame) -> DataFrame:
    """Metrics of exposition text ``(snapshot, value)``: comments and blank lines skipped, a line is
    split at its last blank, the name ends before ``{`` or a blank, counters end in ``_total``."""
    pattern = r"^(.*?)[ \t]+([^ \t]*)$"
    key = F.regexp_extract("value", pattern, 1)
    name = F.regexp_extract(key, r"^([^{ ]*)", 1)
    inner = F.regexp_extract(key, r"\{(.*)\}", 1)
    labels = F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map(F.replace(inner, F.lit('"'), F.lit("")), F.lit(","), F.lit("=")))
    wanted = lines.where(~F.col("value").startswith("#") & (F.col("value") != "") & F.col("value").rlike(r"[ \t]"))
    return wanted.select(
        "snapshot", key.alias("key"), name.alias("name"), labels.alias("labels"),
        F.regexp_extract("value", pattern, 2).try_cast("double").alias("value"), name.endswith("_total").alias("is_counter"))


def read_metric_snapshots(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One snapshot per file."""
    text = spark.read.text(paths).select(F.input_file_name().alias("snapshot"), "value")
    return metric_rows(text)


def flush_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """Flush events among log lines, with their four counters; a missing counter is 0."""
    plain = F.regexp_replace(F.col(column), r"\x1b\[[0-9;]*m", "")
    found = lines.withColumn("_plain", plain).where(F.col("_plain").contains("flush complete"))

    def counter(name: str) -> Column:
        # whole blank-separated tokens name=value
        values = F.regexp_extract_all("_plain", F.lit(rf"(?:^|\s){name}=([^=\s]*)(?=\s|$)"), F.lit(1))
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v.try_cast("bigint"), F.lit(0)))

    return found.withColumns({c: counter(c) for c in FLUSH_COUNTERS}).drop("_plain")


def read_flush_log(spark: SparkSession, path: str) -> DataFrame:
    """Flush events of a log folder, one run per file."""
    text = spark.read.text(path).select(F.input_file_name().alias("run"), F.col("value").alias("line"))
    return flush_rows(text).drop("line")


def log_frames(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Frames of raw lines ``(raw BINARY, had_newline, ...)``: clipped, without line end, as text."""
    clipped = lines.withColumn("_c", clip_line(F.col("raw"), F.col("had_newline"), max_bytes))
    return clipped.withColumns({"line": utf8_lossy(F.col("_c.line")), "truncated": F.col("_c.truncated")}).drop("_c", "raw", "had_newline")


def read_log_lines(
    spark: SparkSession, path: str, stream: str, execution_id: str, streaming: bool = False,
    max_bytes: int = MAX_LINE_BYTES,
) -> DataFrame:
    """Byte lines of log files as frames ``(stream, execution_id, file, line, truncated)``. The last
    line of a file counts even without a newline. Whether it had one matters only for a line of
    exactly the limit; a batch read compares the bytes of the lines with the size of the file."""
    reader = spark.readStream if streaming else spark.read
    text = reader.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"))
    if streaming:
        marked = text.withColumn("had_newline", F.lit(True))
    else:
        placed = text.withColumn("_row", F.monotonically_increasing_id())
        spot = F.struct("_block", "_row")
        bytes_read = F.sum(F.octet_length("raw")) + F.count("*")
        open_ended = placed.groupBy("file").agg(
            F.max(F.struct(spot.alias("spot"), F.octet_length("raw").alias("size"))).alias("_last"),
            (bytes_read - F.max("_size")).alias("_over"),
        ).where((F.col("_over") == 1) & (F.col("_last.size") == max_bytes)).select("file", F.col("_last.spot").alias("_last"))
        joined = placed.join(small_side(open_ended), "file", "left")
        at_end = F.col("_last").isNotNull() & (spot == F.col("_last"))
        marked = joined.withColumn("had_newline", ~F.coalesce(at_end, F.lit(False))).drop("_row", "_last")
    framed = log_frames(marked.drop("_size", "_block"), max_bytes)
    return framed.select(F.lit(stream).alias("stream"), F.lit(execution_id).alias("execution_id"), "file", "line", "truncated")


def _number(text: Column, pattern: str, kind: str = "bigint") -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast(kind)


def parse_host_samples(raw: DataFrame, kind: str, field: str = "MemTotal") -> DataFrame:
    """Readings of collected text ``(..., kind, raw)``, one projection per kind; what is missing is
    null, never 0. Kinds: ``proc_stat``, ``meminfo`` (one ``field``), ``psi``, ``vmstat``,
    ``proc_status``, ``memory_max`` and ``cpu_max``."""
    text = F.col("raw")
    if kind == "proc_stat":
        # fields after the last ')', which ends the process name
        after = F.split(F.trim(F.regexp_extract(text, r"(?s)^.*\)(.*)$", 1)), r"\s+")
        at = lambda i: F.get(after, F.lit(i)).try_cast("bigint")
        readings = {"cpu_ticks": at(11) + at(12), "starttime": at(19)}
    elif kind == "meminfo":
        readings = {"kib": _number(text, rf"(?m)^{field}\S*\s+(\d+)")}
    elif kind == "psi":
        some = _number(text, r"(?m)^some .*?avg10=([0-9.]+)", "double")
        full = _number(text, r"(?m)^full .*?avg10=([0-9.]+)", "double")
        readings = {"some_avg10": some, "full_avg10": F.when(some.isNotNull(), F.coalesce(full, F.lit(0.0)))}
    elif kind == "vmstat":
        readings = {"refaults": _number(text, r"(?m)^workingset_refault_file (\d+)\s*$")}
    elif kind == "proc_status":
        readings = {"rss_kb": _number(text, r"(?m)^VmRSS:\s*(\d+)")}
    elif kind == "memory_max":
        readings = {"memory_bytes": _number(text, r"^\s*(\d+)\s*$")}
    elif kind == "cpu_max":
        quota, period = _number(text, r"^\s*(\d+)\s+\d+\s*$"), _number(text, r"^\s*\d+\s+(\d+)\s*$")
        readings = {"vcpus": F.when(period > 0, F.greatest(F.call_function("div", quota, period), F.lit(1)))}
    else:
        raise ValueError(f"unknown kind of sample: {kind}")
    return raw.where(F.col("kind") == kind).withColumns(readings).drop("raw", "kind")


def bench_rows(lines: DataFrame) -> DataFrame:
    """Last ``tps = x`` per run of lines ``(run, line_no, value)``; 0 for a run without one."""
    # of several on a line the last one counts
    tps = F.regexp_extract("value", r"^.*tps = ([0-9.]+)", 1)
    hit = F.when(tps != "", F.col("line_no"))
    return lines.groupBy("run").agg(
        F.coalesce(F.max_by(tps.try_cast("double"), hit), F.lit(0.0)).alias("tps"))


def read_bench_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One run per file; lines are placed by file block and by row within the reading task."""
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("run"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("line_no"),
        "value")
    return bench_rows(text)
