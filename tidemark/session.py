"""Session helpers: session settings, scratch folders and size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when the optimiser's size estimate is below this.
BROADCAST_LIMIT_BYTES = 64 << 20
# Rows that come from no table have an estimate of this size or more.
UNKNOWN_BYTES = 1 << 60


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset, a session on this
    machine alone uses a temporary folder, which it removes at its end; on a cluster that is an error,
    because executors could not see the folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
        current = context._jsc.sc().getCheckpointDir()
    return (configured or current.get()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise through reliable checkpointing, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def source_bytes(df: DataFrame) -> int:
    """The sizes of the tables a plan reads, added up."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def stored_copy(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table written to the shared folder: computed once, and of known size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast a join side only if its size is checked. The optimiser cannot tell how far an
    aggregation or a parser shrinks its input, so where its estimate is too high the side is
    written out and the size of the files decides. A side that is too large in fact is left to a
    shuffled join, whose skewed keys AQE splits."""
    if plan_bytes(df) <= limit:
        return F.broadcast(df)
    written = stored_copy(df, "side")
    return F.broadcast(written) if plan_bytes(written) <= limit // 4 else written
