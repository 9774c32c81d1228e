"""A table kept current from change batches: parts in levels, split by key, and a manifest that lists them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.history import fold_cells, merge_cells, table_from_cells

VERSION = re.compile(r"(\d{12})\.json")


class LiveTable:
    """A table kept current from change batches.

    A batch adds one part with its folded cells, so it costs what it brings and not the size of the
    table. As soon as a level holds ``fanout`` parts they are folded into one part of the level above:
    a cell is rewritten once per level, and a read folds at most ``fanout`` parts of each level. Parts
    are split into ``buckets`` by a hash of the key, so ``lookup`` reads the buckets of its keys only.

    Parts are never changed. A version of the table is a manifest, written last and moved into place
    whole, so a reader sees all of a batch or a fold or nothing of it. Versions before the newest
    ``keep`` and their parts are removed; a reader may go on with what it opened until then. One writer
    at a time: a version that is already there is an error. ``buckets`` and ``fanout`` are those of the
    first batch, for good.

    Cells of deleted keys are kept, as events may arrive after ones of a higher position."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 16, fanout: int = 8, keep: int = 10):
        if buckets < 1 or fanout < 2 or keep < 1:
            raise ValueError("buckets and keep must be at least 1, fanout at least 2")
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), list(key), keep
        self._new = {"version": 0, "upto": -1, "buckets": buckets, "fanout": fanout, "parts": []}

    # files of the driver: manifests only

    def _file(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(m[1]) for m in map(VERSION.fullmatch, self._names("manifest")) if m]

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds, the newest by default; before the first batch an empty one."""
        if version is None:
            known = self.versions()
            if not known:
                return dict(self._new)
            version = known[-1]
        fs, path = self._file("manifest", f"{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, parts: list[dict], upto: int) -> dict:
        after = {**before, "version": before["version"] + 1, "parts": parts, "upto": upto}
        name = f"{after['version']:012d}.json"
        fs, path = self._file("manifest", name)
        _, hidden = self._file("manifest", f"_{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        try:
            stream.write(json.dumps(after).encode())
        finally:
            stream.close()
        if fs.exists(path) or not fs.rename(hidden, path):
            fs.delete(hidden, False)
            raise RuntimeError(f"{self.path}: version {after['version']} is there already, from another writer")
        return after

    # parts

    def _bucket(self, buckets: int) -> Column:
        cells = [F.coalesce(F.col(f"k.{c}"), F.lit("")) for c in self.key]
        return F.pmod(F.xxhash64(*cells), F.lit(buckets)).cast("int")

    def _write(self, cells: DataFrame, level: int, first: int, last: int, buckets: int) -> dict:
        """A new part. Rows are gathered by bucket; the adaptive plan splits large buckets and joins small ones."""
        name = f"batches-{first}-{last}-{uuid.uuid4().hex}"
        rows = cells.withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/parts/part={name}")
        return {"name": name, "level": level, "first": first, "last": last}

    def _cells(self, parts: Sequence[dict]) -> DataFrame | None:
        """Cells of the listed parts with their bucket; a part of an empty batch holds no files."""
        held = []
        for part in parts:
            fs, path = self._file("parts", f"part={part['name']}")
            if any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(path)):
                held.append(f"{self.path}/parts/part={part['name']}")
        if not held:
            return None
        return self.spark.read.option("basePath", f"{self.path}/parts").parquet(*held).select("k", "kind", "col", "top", "bucket")

    def _folded(self, parts: Sequence[dict]) -> DataFrame | None:
        cells = self._cells(parts)
        return None if cells is None else merge_cells(cells.drop("bucket"))

    def _fold_into(self, now: dict, parts: list[dict], level: int) -> dict:
        """A version in which one part stands for ``parts``."""
        first, last = min(p["first"] for p in parts), max(p["last"] for p in parts)
        cells = self._folded(parts)
        rest = [p for p in now["parts"] if p not in parts]
        one = [] if cells is None else [self._write(cells, level, first, last, now["buckets"])]
        return self._commit(now, sorted(rest + one, key=lambda p: p["first"]), now["upto"])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Sink for ``foreachBatch``, ids rising. A batch that is in the table already changes nothing."""
        now = self.manifest()
        if batch_id <= now["upto"]:
            return
        batch = batch.persist()
        try:
            cells = fold_cells(batch, self.key, self._folded(now["parts"]))
            part = self._write(cells, 0, batch_id, batch_id, now["buckets"])
        finally:
            batch.unpersist()
        now = self._commit(now, now["parts"] + [part], batch_id)
        level = 0
        while len(full := [p for p in now["parts"] if p["level"] == level]) >= now["fanout"]:
            now = self._fold_into(now, full, level + 1)
            level += 1
        self.vacuum()

    def compact(self, upto: int | None = None) -> None:
        """Fold the parts up to a batch, all by default, into one part of the highest level."""
        now = self.manifest()
        parts = [p for p in now["parts"] if upto is None or p["last"] <= upto]
        if len(parts) > 1:
            self._fold_into(now, parts, max(p["level"] for p in now["parts"]) + 1)
        self.vacuum()

    def vacuum(self) -> None:
        """Remove versions before the newest ``keep``, and parts that no kept version lists (those of
        failed attempts too). For the writer only: to others a part that is being written looks unlisted."""
        known = self.versions()
        if not known:
            return
        listed = {p["name"] for v in known[-self.keep:] for p in self.manifest(v)["parts"]}
        gone = [("manifest", f"{v:012d}.json") for v in known[:-self.keep]]
        gone += [("parts", n) for n in self._names("parts") if n.startswith("part=") and n[len("part="):] not in listed]
        for names in gone:
            fs, path = self._file(*names)
            fs.delete(path, True)

    # readers

    def read(self, version: int | None = None) -> DataFrame:
        """The table after a version, the newest by default: key columns, image, complete."""
        now = self.manifest(version)
        if not now["version"]:
            raise FileNotFoundError(f"no batch has been applied to {self.path}")
        return self._table(self._cells(now["parts"]))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (key columns as text); only their buckets are read."""
        now = self.manifest()
        asked = keys.select(F.struct(*[F.col(c).cast("string").alias(c) for c in self.key]).alias("k")).distinct()
        cells = self._cells(now["parts"])
        if cells is None:
            return self._table(None)
        # at most as many numbers as there are buckets
        buckets = [r[0] for r in asked.select(self._bucket(now["buckets"])).distinct().collect()]
        return self._table(cells.where(F.col("bucket").isin(buckets)).join(asked, "k", "left_semi"))

    def _table(self, cells: DataFrame | None) -> DataFrame:
        if cells is None:
            columns = ", ".join(f"`{c}` string" for c in self.key)
            return self.spark.createDataFrame([], f"{columns}, image map<string,string>, complete boolean")
        return table_from_cells(merge_cells(cells.drop("bucket"))).select("k.*", "image", "complete")


def live_table(
    events: DataFrame, path: str, key: Sequence[str], checkpoint: str, trigger: dict | None = None, **options: int,
) -> StreamingQuery:
    """Keep a table current from a stream of events; ``options`` are those of ``LiveTable``."""
    table = LiveTable(events.sparkSession, path, key, **options)
    return (events.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
