"""Small arithmetic used by the reports: ratios, retry delays and host sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIB = 1024 * 1024


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def retry_delay_ms(failures: Column) -> Column:
    """100 ms doubled per failure, at most eight times, never above 30 s."""
    steps = F.least(failures.cast("int"), F.lit(8))
    return F.least(F.call_function("shiftleft", F.lit(100).cast("bigint"), steps), F.lit(30_000).cast("bigint"))


def retry_delay_doubling_ms(failures: Column) -> Column:
    """The other backoff form: 100 ms doubled per failure until 30 s is reached."""
    steps = F.least(failures.cast("int"), F.lit(9))
    return F.least(F.call_function("shiftleft", F.lit(100).cast("bigint"), steps), F.lit(30_000).cast("bigint"))


def _clamp(value: Column, low, high) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("bigint")
    return F.least(F.greatest(value, as_col(low)), as_col(high))


def _div(value: Column, by: int | Column) -> Column:
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def shared_buffers_mb(ram_bytes: Column) -> Column:
    """A quarter of the RAM in MiB, at least 128."""
    return F.greatest(_div(_div(ram_bytes, MIB), 4), F.lit(128).cast("bigint"))


def fleet_sizing(hosts: DataFrame) -> DataFrame:
    """Recommended settings for a table of hosts ``(host, ram_bytes, vcpus)``; sizes in MiB."""
    ram_mb = _div(F.col("ram_bytes"), MIB)
    cores = F.col("vcpus").cast("bigint")
    sized = hosts.select(
        "host", ram_mb.alias("ram_mb"), cores.alias("vcpus"),
        shared_buffers_mb(F.col("ram_bytes")).alias("shared_buffers_mb"),
        _clamp(cores * 3, 16, 256).alias("pool_size"),
        _clamp(_div(cores, 4), 1, 8).alias("pooler_max_workers"),
    )
    ram, buffers, pool = F.col("ram_mb"), F.col("shared_buffers_mb"), F.col("pool_size")
    connection_cap = F.greatest(_div(ram, 50), F.lit(100).cast("bigint"))
    return sized.select(
        "host", "ram_mb", "vcpus", "shared_buffers_mb", "pool_size", "pooler_max_workers",
        _clamp(_div(buffers, 32), 1, 16).alias("wal_buffers_mb"),
        _clamp(pool + F.col("vcpus") * 2 + 10, 100, connection_cap).alias("max_connections"),
        F.greatest(F.col("vcpus") + 4, F.lit(8)).alias("max_worker_processes"),
        F.greatest(F.col("vcpus"), F.lit(1)).alias("max_parallel_workers"),
        _div(ram * 3, 4).alias("effective_cache_mb"),
        F.least(_div(ram, 20), F.lit(2048)).alias("maintenance_work_mb"),
        F.greatest(_div(_div(ram, 2), pool * 3), F.lit(32)).alias("work_mem_mb"),
        _clamp(_div(F.col("vcpus"), 2), 1, 4).alias("max_parallel_per_gather"),
        (_div(buffers, 2) + 32).alias("nr_hugepages"),
    )
