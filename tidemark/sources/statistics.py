"""Snapshots of server statistics tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# The statistics tables and the columns the reports read.
STAT_TABLES = {
    "replication": ("pg_stat_replication", ("application_name", "state", "sent_lsn", "flush_lsn")),
    "slots": ("pg_replication_slots", ("slot_name", "active", "restart_lsn", "confirmed_flush_lsn")),
    "activity": ("pg_stat_activity", ("pid", "backend_type", "state")),
    "tables": ("pg_stat_user_tables", ("schemaname", "relname", "n_live_tup", "n_dead_tup")),
}


def read_stat_tables(spark: SparkSession, options: dict[str, str], names: Sequence[str] = tuple(STAT_TABLES)) -> dict[str, DataFrame]:
    """Statistics by name, with the columns the reports use. ``options`` are those of the JDBC
    source; with ``path`` instead of ``url`` the tables are read from stored parquet snapshots."""
    out = {}
    for name in names:
        table, columns = STAT_TABLES[name]
        if "url" in options:
            source = spark.read.format("jdbc").options(**options, dbtable=table).load()
        else:
            source = spark.read.parquet(f"{options['path']}/{table}")
        out[name] = source.select(*columns)
    return out
