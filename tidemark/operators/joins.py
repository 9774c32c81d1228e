"""Joins between events, catalogs, snapshots and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.segments import is_segment
from tidemark.operators.filters import at_or_after_redo
from tidemark.operators.scale import neighbour, running
from tidemark.session import small_side, stored_copy

# The metrics shown first, in their order, without the exporter's prefix.
HEADLINE_METRICS = (
    "s3_batches_written_total", "s3_bytes_written_total", "s3_bytes_read_total", "s3_read_ops_total",
    "guest_bytes_written_total", "guest_write_ops_total", "cache_hits_total", "cache_misses_total",
    "write_amplification", "coalesce_ratio", "dirty_blocks",
)


# A change is compared with so many versions of its relation at most; where there are more, it is carried
# past them in one ordered scan.
FEW_VERSIONS = 16
_DESCRIPTOR = ("schema", "table", "columns")


def descriptor_versions(relations: DataFrame) -> DataFrame:
    """Descriptors ``(rel_oid, seq, schema, table, columns)`` that differ from the one before: servers
    announce the same one again and again."""
    before = neighbour(relations, ["rel_oid"], ["seq"], {"_before": F.struct(*_DESCRIPTOR)})
    return before.where(~F.col("_before").eqNullSafe(F.struct(*_DESCRIPTOR))).select("rel_oid", "seq", *_DESCRIPTOR)


def relation_intervals(versions: DataFrame) -> DataFrame:
    """Descriptor versions with the half-open arrival range in which each is the newest."""
    ranged = neighbour(versions, ["rel_oid"], ["seq"], {"to_seq": F.col("seq")}, following=True)
    return ranged.select("rel_oid", *_DESCRIPTOR, F.col("seq").alias("from_seq"), "to_seq")


def resolve_relations(dml: DataFrame, relations: DataFrame, keep_unknown: bool = False, few: int = FEW_VERSIONS,
                      blocks: int | None = None) -> DataFrame:
    """As-of join: each row change gets the newest descriptor that arrived before it. The order is
    arrival, not log position. Unknown relations are dropped, or kept with a null table.

    Relations with ``few`` versions at most are joined by range with the small table of versions, which
    moves no change. Else changes and versions are put in one order, and the newest version is handed
    on from row to row: the cost doesn't depend on how many versions a relation has. Both give the same."""
    versions = stored_copy(descriptor_versions(relations), "versions")
    most = versions.groupBy("rel_oid").count().agg(F.max("count")).first()[0] or 0
    if most > few:
        return _carried_descriptors(dml, versions, keep_unknown, blocks)
    d = dml.alias("d")
    r = small_side(relation_intervals(versions)).alias("r")
    seen = (
        (F.col("d.rel_oid") == F.col("r.rel_oid")) & (F.col("d.seq") >= F.col("r.from_seq"))
        & (F.col("r.to_seq").isNull() | (F.col("d.seq") < F.col("r.to_seq")))
    )
    joined = d.join(r, seen, "left" if keep_unknown else "inner")
    return joined.select("d.*", "r.schema", "r.table", "r.columns")


def _carried_descriptors(dml: DataFrame, versions: DataFrame, keep_unknown: bool, blocks: int | None) -> DataFrame:
    changes = dml.select("rel_oid", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("_rank"), F.struct("*").alias("_change"))
    marks = versions.select("rel_oid", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("_rank"), F.struct(*_DESCRIPTOR).alias("_mark"))
    line = changes.unionByName(marks, allowMissingColumns=True)
    seen = running(line, ["rel_oid"], ["seq", "_rank"], {"_seen": ("last", F.col("_mark"))}, blocks)
    resolved = seen.where((F.col("_rank") == 1) & (F.lit(keep_unknown) | F.col("_seen").isNotNull()))
    return resolved.select("_change.*", "_seen.*")


def missing_segments(archive: DataFrame, local: DataFrame, redo: str, per_timeline: bool = False) -> DataFrame:
    """Names of archived segments at or after redo that are not present locally."""
    wanted = at_or_after_redo(archive.where(is_segment(F.col("name"))), redo, per_timeline)
    return wanted.select("name").join(local.select("name"), "name", "left_anti")


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counters: after - before, a missing before counts 0; gauges: both values, no delta.
    Inputs ``(key, name, value, is_counter)``; every key of the later snapshot comes out."""
    b = before.select("key", F.col("value").alias("before_v"))
    joined = after.select("key", "name", "is_counter", F.col("value").alias("after_v")).join(b, "key", "left")
    start = F.coalesce(F.col("before_v"), F.lit(0).cast(dict(after.dtypes)["value"]))
    return joined.select(
        "key", "name", "is_counter", start.alias("before_v"), "after_v",
        F.when(F.col("is_counter"), F.col("after_v") - start).alias("delta"),
    )


def metric_rank(name: Column) -> Column:
    """Place among the headline metrics from 1; null for the others. The exporter's prefix, up to
    the first underscore, does not count."""
    known = F.array(*[F.lit(m) for m in HEADLINE_METRICS])
    plain = F.regexp_replace(name, "^[^_]*_", "")
    return F.nullif(F.array_position(known, plain), F.lit(0).cast("bigint"))


def counter_rate(samples: DataFrame, blocks: int | None = None, every_sample: bool = False) -> DataFrame:
    """Growth of cumulative counters ``(host, pid, tick, cpu_ticks)`` between consecutive ticks of
    a host. A pid counts only if it is in both ticks; a falling counter counts 0. With
    ``every_sample`` the others come out too, with null growth."""
    ticks = samples.select("host", "tick").distinct()
    ticks = neighbour(ticks, ["host"], ["tick"], {"prev_tick": F.col("tick")}, blocks=blocks)
    mine = neighbour(
        samples, ["host", "pid"], ["tick"],
        {"_tick": F.col("tick"), "_cpu": F.col("cpu_ticks")}, blocks=blocks,
    )
    placed = mine.join(ticks, ["host", "tick"])
    both = F.col("_tick") == F.col("prev_tick")
    growth = F.greatest(F.col("cpu_ticks") - F.col("_cpu"), F.lit(0).cast("bigint"))
    kept = placed if every_sample else placed.where(both)
    return kept.select("host", "pid", "tick", "prev_tick", F.when(both, growth).alias("delta_ticks"))


def reconcile_identities(saved: DataFrame, live: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Saved ``(name, pid, starttime)`` against live ``(pid, starttime)``: adopted when both agree,
    dead when the pid is gone, recycled when it started at another time."""
    l = live.select("pid", F.col("starttime").alias("live_starttime"))
    state = (
        F.when(F.col("live_starttime").isNull(), "dead")
        .when(F.col("live_starttime") == F.col("starttime"), "adopted").otherwise("recycled")
    )
    return saved.join(l, "pid", "left").select("name", "pid", "starttime", "live_starttime", *extra, state.alias("state"))


def caught_up(slots: DataFrame, target: int | DataFrame) -> DataFrame:
    """Whether each consumer's flushed position has reached the target: a number, or a one-row
    aggregate ``(target)`` read as a scalar subquery."""
    goal = F.lit(target).cast("bigint") if isinstance(target, int) else target.select("target").scalar()
    return slots.withColumn("target", goal).withColumn("caught_up", F.col("flush_lsn") >= F.col("target"))


def compare_variants(scores: DataFrame, baseline: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Percent change of each variant's metrics against the baseline mean (of the same group)."""
    means = [F.avg(m).alias(f"_base_{m}") for m in metrics]
    if by:
        joined = scores.join(small_side(baseline.groupBy(*by).agg(*means)), list(by))
    else:
        base = baseline.agg(*means)
        joined = scores.withColumns({f"_base_{m}": base.select(f"_base_{m}").scalar() for m in metrics})
    pct = {f"{m}_pct": (F.col(m) - F.col(f"_base_{m}")) / F.col(f"_base_{m}") * 100 for m in metrics}
    return joined.withColumns(pct).drop(*[f"_base_{m}" for m in metrics])
