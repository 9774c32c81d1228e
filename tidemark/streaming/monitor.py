"""Counters and positions of running streams, kept by a listener."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

DELIVERED = "delivered"
STATS_SCHEMA = "consumer string, starts bigint, running boolean, batch bigint, events bigint, lsn bigint, end_offset string"


def observed(events: DataFrame) -> DataFrame:
    """Events whose number and highest position each batch reports to a ``StreamMonitor``. They are
    counted as they pass: no second scan."""
    return events.observe(DELIVERED, F.count(F.lit(1)).alias("events"), F.max("lsn").alias("lsn"))


class StreamMonitor(StreamingQueryListener):
    """Totals per named stream: starts, events, highest position, newest offset.

    Register it with ``spark.streams.addListener``. Each finished batch counts once, also one that is
    run again after a restart. With ``path`` every consumer's totals are kept in one small file,
    and a monitor made later goes on from there. Progress arrives a little after a batch, so
    ``settle`` waits for streams that have ended. What a consumer has confirmed (``capture.confirm``)
    is the record to restart from; this is the view of what goes on."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self._spark, self._path = spark, path and path.rstrip("/")
        self._lock, self._names, self._totals = threading.Lock(), {}, {}
        if self._path:
            folder = self._hadoop(self._path)
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                for row in progress_of(spark, self._path).collect():
                    self._totals[row.consumer] = {**row.asDict(), "running": False}

    def _hadoop(self, path: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(path)

    def _save(self, totals: dict) -> None:
        """A file per consumer. Readers skip the hidden name; between removing the old file and moving the new
        one into place there is none for a moment."""
        if not self._path:
            return
        name = re.sub(r"[^\w-]", lambda m: f"%{ord(m[0]):x}", totals["consumer"])
        final, hidden = self._hadoop(f"{self._path}/{name}.json"), self._hadoop(f"{self._path}/_{uuid.uuid4().hex}")
        fs = final.getFileSystem(self._spark._jsc.hadoopConfiguration())
        stream = fs.create(hidden, False)
        try:
            stream.write(json.dumps(totals).encode())
        finally:
            stream.close()
        fs.delete(final, False)
        fs.rename(hidden, final)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            name = event.name or str(event.id)
            self._names[str(event.runId)] = name
            totals = self._totals.setdefault(
                name, {"consumer": name, "starts": 0, "running": False, "batch": -1, "events": 0, "lsn": None, "end_offset": None})
            totals["starts"] += 1
            totals["running"] = True

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            totals = self._totals.get(self._names.get(str(progress.runId)))
            row = progress.observedMetrics.get(DELIVERED)
            if totals is None or row is None or progress.batchId <= totals["batch"]:
                return
            totals["batch"] = progress.batchId
            totals["events"] += row["events"] or 0
            if row["lsn"] is not None:
                totals["lsn"] = max(row["lsn"], totals["lsn"] if totals["lsn"] is not None else row["lsn"])
            totals["end_offset"] = json.dumps([s.endOffset for s in progress.sources])
            self._save(totals)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            totals = self._totals.get(self._names.pop(str(event.runId), None))
            if totals is not None:
                totals["running"] = totals["consumer"] in self._names.values()
                self._save(totals)

    def settle(self, seconds: float = 60) -> None:
        """Wait until the end of every started stream has been told."""
        end = time.monotonic() + seconds
        while self._names:
            if time.monotonic() > end:
                raise TimeoutError(f"still running: {sorted(self._names.values())}")
            time.sleep(0.05)

    def consumers(self) -> DataFrame:
        """One row per stream: starts, running, newest batch, events, highest position, newest offset."""
        with self._lock:
            rows = [tuple(t[f.split()[0]] for f in STATS_SCHEMA.split(", ")) for t in self._totals.values()]
        return self._spark.createDataFrame(rows, STATS_SCHEMA)


def progress_of(spark: SparkSession, path: str) -> DataFrame:
    """The totals that a monitor keeps under a path, without the monitor."""
    return spark.read.schema(STATS_SCHEMA).json(path)
