"""Continuous capture: decode, fan out, confirm positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.filters import split_rejects
from tidemark.sources.events import events_as_json
from tidemark.session import stored_copy
from tidemark.sources.frames import RELATION_SCHEMA, dml_messages, relation_messages, resolve_events
from tidemark.streaming.monitor import observed

FRAME_SCHEMA = "seq bigint, lsn bigint, data binary"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A parquet folder as a table, or nothing while no batch has written to it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def change_stream(
    frames: DataFrame, out: str, checkpoint: str, trigger: dict | None = None,
    also: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Decode a stream of frames into an event table under ``out/events`` (and rejects under
    ``out/rejects``), both by batch. The newest descriptor of each relation is kept under
    ``out/relations``, by batch, so the next batch reads one row per relation, however long the stream
    has run. A batch that is run again overwrites its own folders."""
    spark = frames.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        known = stored_copy(relation_messages(batch), "relations")
        older = stored(spark_, f"{out}/relations", RELATION_SCHEMA + ", batch bigint")
        if older is not None:
            older = older.where(F.col("batch") < batch_id)
            known = known.unionByName(older.where(F.col("batch") == older.agg(F.max("batch")).scalar()).drop("batch"))
        newest = known.groupBy("rel_oid").agg(F.max_by(F.struct("*"), "seq").alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{out}/relations/batch={batch_id}")
        resolved = stored_copy(resolve_events(dml_messages(batch), known), "resolved")
        good, rejects = split_rejects(resolved)
        good.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        rejects.select("seq", "lsn", "op", "reject").write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        if also:
            also(spark_.read.parquet(f"{out}/events/batch={batch_id}"), batch_id)

    return (frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def fan_out(
    stream: Callable[[], DataFrame], sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str, trigger: dict | None = None,
) -> dict[str, StreamingQuery]:
    """One query with its own checkpoint per sink: every sink gets every event, and one that fails
    or lags does not hold up the others; started again it goes on with the batch it failed at. Sinks get
    ``(batch, batch id)`` and should make a repeated batch id harmless. A ``StreamMonitor`` that is
    registered counts what each of them took; a batch is kept while its sink runs, so that what is read
    several times counts once."""
    def kept(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                sink(batch, batch_id)
            finally:
                batch.unpersist()
        return write

    return {
        name: (observed(stream()).writeStream.queryName(name).foreachBatch(kept(sink))
               .option("checkpointLocation", f"{checkpoint}/{name}")
               .trigger(**(trigger or {"availableNow": True})).start())
        for name, sink in sinks.items()
    }


def json_sink(path: str, rebuildable: bool = False) -> Callable[[DataFrame, int], None]:
    """Sink of JSON lines, one folder per batch; ``rebuildable`` as in ``events_as_json``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        events_as_json(batch, rebuildable).select("value").write.mode("overwrite").text(f"{path}/batch={batch_id}")
    return write


def confirm(batch: DataFrame, batch_id: int, path: str, consumer: str) -> None:
    """Record the highest position a consumer has taken, after its batch was delivered."""
    top = batch.agg(F.max("lsn").alias("lsn"), F.count("*").alias("events"))
    row = top.where(F.col("lsn").isNotNull()).select(F.lit(consumer).alias("consumer"), "lsn", "events")
    row.write.mode("overwrite").parquet(f"{path}/consumer_name={consumer}/batch={batch_id}")


def confirmed(sink: Callable[[DataFrame, int], None], path: str, consumer: str) -> Callable[[DataFrame, int], None]:
    """A sink that confirms each batch right after writing it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        confirm(batch, batch_id, path, consumer)
    return write


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed position and delivered events per consumer."""
    rows = stored(spark, path)
    if rows is None:
        return spark.createDataFrame([], "consumer string, lsn bigint, events bigint")
    return rows.groupBy("consumer").agg(F.max("lsn").alias("lsn"), F.sum("events").alias("events"))
