"""Change events as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.lsn import lsn_format, lsn_parse
from tidemark.functions.payload import event_json

IMAGE = T.MapType(T.StringType(), T.StringType())
EVENT_JSON_SCHEMA = T.StructType([
    T.StructField("lsn", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("schema", T.StringType()), T.StructField("table", T.StringType()),
    T.StructField("old", IMAGE), T.StructField("new", IMAGE), T.StructField("seq", T.LongType()),
    T.StructField("commit_ts", T.TimestampType()), T.StructField("types", T.MapType(T.StringType(), T.IntegerType())),
])
# Columns of the folders that write_change_events makes.
_FOLDERS = [T.StructField("in_schema", T.StringType()), T.StructField("in_table", T.StringType())]


def _shape(raw: DataFrame) -> DataFrame:
    lsn = lsn_parse(F.col("lsn"))
    # Positions rise with arrival, so they stand in for an arrival number that was not written.
    return raw.select(
        F.coalesce("seq", lsn).alias("seq"), lsn.alias("lsn"), F.col("lsn").alias("lsn_text"), "commit_ts", "op", "schema", "table", "old", "new", "types")


def read_change_events(spark: SparkSession, path: str, streaming: bool = False,
                       tables: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """JSON events of a folder, also one partitioned by schema and table, as a table or a stream:
    ``seq, lsn, lsn_text, commit_ts, op, schema, table, old, new, types``, which is what a table is
    rebuilt from. A null cell stays a null map value; a key the event does not carry stays absent.
    Events written without ``seq``, ``commit_ts`` or ``types`` have the position and nulls. ``tables``
    keeps the events of some ``(schema, table)``; folders of others are not read."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.schema(T.StructType([*EVENT_JSON_SCHEMA.fields, *_FOLDERS])).json(path)
    if tables is not None:
        # In a folder without partitions these columns are null, and the event's own fields decide.
        wanted, folder = F.lit(False), F.col("in_table").isNull()
        for schema, name in tables:
            wanted = wanted | ((F.col("schema") == schema) & (F.col("table") == name))
            folder = folder | ((F.col("in_schema") == schema) & (F.col("in_table") == name))
        raw = raw.where(folder).where(wanted)
    return _shape(raw)


def parse_change_events(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Events from a text or binary column, such as the value of a message queue record."""
    parsed = payloads.select(F.from_json(F.col(column).cast("string"), EVENT_JSON_SCHEMA).alias("e"))
    return _shape(parsed.select("e.*"))


def events_as_json(events: DataFrame, rebuildable: bool = False) -> DataFrame:
    """``(schema, table, lsn, value)`` with the event as JSON text. A ``rebuildable`` event also carries,
    after its images, its arrival number, its commit time and the types of its columns."""
    value = event_json(
        lsn_format(F.col("lsn")), F.col("op"), F.col("schema"), F.col("table"),
        F.col("old"), F.col("new"), F.col("types"))
    if rebuildable:
        absent = {"seq": F.lit(None).cast("bigint"), "commit_ts": F.lit(None).cast("timestamp")}
        known = [F.col(c) if c in events.columns else none.alias(c) for c, none in absent.items()]
        more = F.to_json(F.struct(*known, "types"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        value = F.concat(F.regexp_replace(value, r"\}\z", ","), F.substr(more, F.lit(2)))
    return events.select("schema", "table", "lsn", value.alias("value"))


def write_change_events(events: DataFrame, path: str, mode: str = "append", rebuildable: bool = False) -> None:
    """JSON lines in one folder per schema and table, ordered by position within each file, so that
    readers prune by table. ``rebuildable`` as in :func:`events_as_json`. A stream goes through ``foreachBatch`` with the same call."""
    lines = events_as_json(events, rebuildable).select(
        F.col("schema").alias("in_schema"), F.col("table").alias("in_table"), "lsn", "value")
    ordered = lines.sortWithinPartitions("in_schema", "in_table", "lsn")
    ordered.select("in_schema", "in_table", "value").write.mode(mode).partitionBy("in_schema", "in_table").text(path)
