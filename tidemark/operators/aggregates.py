"""Aggregations: stream counters, scoreboards, exact percentiles, coverage and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.arithmetic import safe_ratio
from tidemark.functions.lsn import lsn_format
from tidemark.functions.segments import SEGMENT_BYTES, is_history, is_partial, is_segment, parse_segment_name, segment_name_of, segment_no
from tidemark.operators.scale import running
from tidemark.session import small_side

MIB = 1024 * 1024


def stream_stats(events: DataFrame, runs: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row of runtime counters: events, reconnects (runs after the first), the highest flushed
    position (``0/00000000`` when none) and live subscribers."""
    e = events.agg(F.count("*").alias("events_total"), F.coalesce(F.max("lsn"), F.lit(0).cast("bigint")).alias("_lsn"))
    r = runs.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("reconnects_total"))
    s = subscribers.agg(F.count("*").alias("subscribers"))
    return e.select(
        "events_total", r.select("reconnects_total").scalar().alias("reconnects_total"),
        lsn_format(F.col("_lsn")).alias("last_flush_lsn"), s.select("subscribers").scalar().alias("subscribers"),
    )


def running_stats(consumers: DataFrame) -> DataFrame:
    """The same counters of a running system, from the rows of a ``StreamMonitor``: every consumer sees
    every event, so the one that is ahead gives events and position, and starts after the first of each
    are reconnects."""
    return consumers.agg(
        F.coalesce(F.max("events"), F.lit(0)).cast("bigint").alias("events_total"),
        F.coalesce(F.sum(F.greatest(F.col("starts") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("reconnects_total"),
        lsn_format(F.coalesce(F.max("lsn"), F.lit(0).cast("bigint"))).alias("last_flush_lsn"),
        F.count_if("running").alias("subscribers"))


def flush_scoreboard(flush: DataFrame, guest: DataFrame | None = None, after_line: str | None = None) -> DataFrame:
    """Per run: sums of the flush counters, flush cycles, write amplification, coalescing and pack
    fill. ``guest`` holds ``(run, guest_bytes, guest_ops)``. With ``after_line`` naming a line-number
    column of ``guest``, only flushes after that line of the run count."""
    if guest is None:
        guest = flush.select("run").distinct().select(
            "run", F.lit(0).cast("bigint").alias("guest_bytes"), F.lit(0).cast("bigint").alias("guest_ops"))
    if after_line:
        marks = small_side(guest.select("run", F.col(after_line).alias("_mark")))
        flush = flush.join(marks, "run", "left").where(F.col("_mark").isNull() | (F.col("line_no") > F.col("_mark")))
    sums = flush.groupBy("run").agg(
        F.sum("packs_uploaded").alias("packs"), F.sum("bytes_uploaded").alias("s3_bytes"),
        F.sum("blocks_claimed").alias("blocks"), F.sum("blocks_cross_deduped").alias("deduped"),
        F.count("*").alias("flushes"),
    )
    zero = F.lit(0).cast("bigint")
    return sums.join(guest.select("run", "guest_bytes", "guest_ops"), "run", "left").select(
        "run", "packs", "s3_bytes", "blocks", "deduped", "flushes",
        safe_ratio(F.col("s3_bytes"), F.coalesce("guest_bytes", zero)).alias("write_amp"),
        safe_ratio(F.coalesce("guest_ops", zero), F.col("packs")).alias("coalesce_ratio"),
        safe_ratio(F.col("blocks"), F.col("packs")).alias("pack_fill"),
    )


def index_percentiles(df: DataFrame, by: str, column: str, percents: Sequence[int] = (50, 95, 99), blocks: int | None = None) -> DataFrame:
    """Per group the values at index ``n * q / 100`` (0-based, floored) of the sorted samples, and
    the maximum. Equal values are counted before the shuffle, then a running count finds the value
    that covers each index; no group is ever collected."""
    counted = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_n"))
    ranked = running(counted, [by], [column], {"_upto": ("sum", F.col("_n"))}, blocks)
    totals = counted.groupBy(by).agg(F.sum("_n").alias("n"))
    joined = ranked.join(small_side(totals), by)

    def at(q: int) -> Column:
        index = F.call_function("div", F.col("n") * q, F.lit(100))
        return F.max(F.when((F.col("_upto") - F.col("_n") <= index) & (index < F.col("_upto")), F.col(column)))

    return joined.groupBy(by).agg(
        F.max("n").alias("n"), *[at(q).alias(f"p{q}") for q in percents], F.max(column).alias("max"))


def noise_floor(baseline: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), min_runs: int = 3) -> DataFrame:
    """Mean of each metric over the baseline runs and the largest relative distance from it; null
    floors where there are fewer than ``min_runs`` runs. The largest distance is at the smallest or
    the greatest value, so one aggregation is enough."""
    aggs: list[Column] = [F.count("*").alias("runs")]
    for m in metrics:
        mean = F.avg(m)
        spread = F.greatest(F.max(m) - mean, mean - F.min(m)) / F.abs(mean)
        aggs += [mean.alias(f"{m}_mean"), F.when(F.count("*") >= min_runs, spread).alias(f"{m}_floor")]
    return baseline.groupBy(*by).agg(*aggs)


def ship_decision(variants: DataFrame, floors: DataFrame, metric: str, by: Sequence[str] = (), lower_is_better: bool = True) -> DataFrame:
    """``ship``, ``no-ship`` or ``noise`` for each variant: a change counts only beyond the floor."""
    mean, floor = F.col(f"{metric}_mean"), F.col(f"{metric}_floor")
    change = (F.col(metric) - mean) / mean
    better = change < 0 if lower_is_better else change > 0
    verdict = F.when(floor.isNull(), None).when(F.abs(change) <= floor, "noise").when(better, "ship").otherwise("no-ship")
    picked = floors.select(*by, mean, floor)
    if by:
        joined = variants.join(small_side(picked), list(by))
    else:
        joined = variants.withColumns({c: picked.select(c).scalar() for c in picked.columns})
    return joined.withColumn("change", change).withColumn("decision", verdict)


def soak_check(samples: DataFrame) -> DataFrame:
    """Per run: resident memory below twice its minimum, open files below the minimum + 10, and in
    every sample at most one partial segment and lag below 64 MiB."""
    low = F.greatest(F.min("rss_kb"), F.lit(1))
    checks = samples.groupBy("run").agg(
        F.min("rss_kb").alias("min_rss_kb"), F.max("rss_kb").alias("max_rss_kb"),
        (F.max("rss_kb") < low * 2).alias("rss_ok"), (F.max("fds") < F.min("fds") + 10).alias("fds_ok"),
        F.bool_and(F.col("partials") <= 1).alias("partials_ok"),
        F.bool_and(F.col("lag_bytes") < 64 * MIB).alias("lag_ok"),
    )
    return checks.withColumn("passed", F.col("rss_ok") & F.col("fds_ok") & F.col("partials_ok") & F.col("lag_ok"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Per timeline: complete segments, first and last name and the position after the last one;
    and on every row the overall resume point, from the greatest name of all timelines."""
    segments = catalog.where(is_segment(F.col("name")))
    best = segments.agg(F.max("name").alias("name")).select(parse_segment_name(F.col("name"))["end_lsn"].alias("e")).scalar()
    per_timeline = segments.groupBy(F.substring("name", 1, 8).alias("_tl")).agg(
        F.count("*").alias("segments"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
    last = parse_segment_name(F.col("last_name"))
    return per_timeline.select(
        last["timeline"].alias("timeline"), "segments", "first_name", "last_name",
        last["end_lsn"].alias("high_lsn"), best.alias("resume_lsn"))


def file_kinds(names: DataFrame) -> DataFrame:
    """Kind of every archive file: segment, partial, history or other."""
    n = F.col("name")
    kind = F.when(is_segment(n), "segment").when(is_partial(n), "partial").when(is_history(n), "history").otherwise("other")
    return names.withColumn("kind", kind)


def active_sessions(activity: DataFrame, own_pid: int | None = None) -> DataFrame:
    """Per snapshot: client sessions that are not idle and not the observer's own. A snapshot that
    could not be taken (null ``pid`` only) counts null, which is not 0."""
    busy = (F.col("backend_type") == "client backend") & (F.col("state") != "idle")
    if own_pid is not None:
        busy = busy & (F.col("pid") != own_pid)
    reached = F.count("pid") > 0
    return activity.groupBy("snapshot").agg(F.when(reached, F.count_if(busy)).alias("active"))


def divergence_report(flush: DataFrame, dead_before: DataFrame, dead_after: DataFrame, baseline: str) -> DataFrame:
    """Per profile: bytes and packs written while idle, dead rows before and after, and the bytes
    relative to the baseline profile."""
    written = flush.groupBy("profile").agg(F.sum("bytes_uploaded").alias("bytes"), F.sum("packs_uploaded").alias("packs"))
    dead = lambda t, name: t.groupBy("profile").agg(F.sum("n_dead_tup").alias(name))
    base = written.where(F.col("profile") == baseline).select("bytes").scalar()
    joined = written.join(dead(dead_before, "dead_before"), "profile", "left").join(dead(dead_after, "dead_after"), "profile", "left")
    return joined.withColumn("bytes_ratio", safe_ratio(F.col("bytes"), base))


def pooler_cost(runs: DataFrame, ticks_per_second: int = 100) -> DataFrame:
    """Cores used, microseconds per transaction, cores per pooler, and scaling efficiency against
    the one-pooler run of the same series ``(series, poolers, ticks0, ticks1, t0, t1, tps)``."""
    cores = (F.col("ticks1") - F.col("ticks0")) / ticks_per_second / (F.col("t1") - F.col("t0"))
    costed = runs.withColumn("cores", cores)
    single = costed.where(F.col("poolers") == 1).groupBy("series").agg(F.max("tps").alias("_single"))
    return costed.join(small_side(single), "series", "left").select(
        "series", "poolers", "tps", "cores",
        F.when(F.col("tps") > 0, F.col("cores") * 1e6 / F.col("tps")).alias("us_per_txn"),
        (F.col("cores") / F.col("poolers")).alias("per_pooler"),
        (F.col("tps") / (F.col("_single") * F.col("poolers"))).alias("efficiency"),
    )


def segment_pieces(chunks: DataFrame) -> DataFrame:
    """Byte ranges ``(timeline, start_lsn, n_bytes)`` cut at segment ends: rows
    ``(timeline, seg_no, from_off, to_off)`` with offsets inside the segment. Rows without a
    timeline are rejected. A range of any length is cut into as many pieces as it spans."""
    end = F.col("start_lsn") + F.col("n_bytes")
    valid = chunks.where(F.col("timeline").isNotNull() & (F.col("n_bytes") > 0))
    spread = valid.select(
        F.col("timeline").cast("bigint").alias("timeline"), "start_lsn", end.alias("_end"),
        F.explode(F.sequence(segment_no(F.col("start_lsn")), segment_no(end - 1))).alias("seg_no"))
    base = F.col("seg_no") * SEGMENT_BYTES
    return spread.select(
        "timeline", "seg_no",
        (F.greatest("start_lsn", base) - base).cast("int").alias("from_off"),
        (F.least("_end", base + SEGMENT_BYTES) - base).cast("int").alias("to_off"))


def segment_coverage(chunks: DataFrame) -> DataFrame:
    """Per segment: distinct bytes held, first and last position, ``sealed`` (its end was reached)
    and ``covered`` (every byte is there). Ranges with the same start are merged before the
    shuffle, so a segment sent over and over costs at most one row per distinct start per task."""
    pieces = segment_pieces(chunks).groupBy("timeline", "seg_no", "from_off").agg(F.max("to_off").alias("to_off"))
    # at most one row per byte offset of a 16 MiB segment
    before = (Window.partitionBy("timeline", "seg_no").orderBy("from_off")
              .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.coalesce(F.max("to_off").over(before), F.lit(0))
    fresh = F.greatest(F.col("to_off") - F.greatest(F.col("from_off"), reach), F.lit(0))
    held = pieces.withColumn("_fresh", fresh).groupBy("timeline", "seg_no").agg(
        F.sum("_fresh").alias("bytes"), F.min("from_off").alias("_lo"), F.max("to_off").alias("_hi"))
    base = F.col("seg_no") * SEGMENT_BYTES
    return held.select(
        "timeline", "seg_no", segment_name_of(F.col("seg_no"), F.col("timeline")).alias("name"), "bytes",
        (base + F.col("_lo")).alias("first_lsn"), (base + F.col("_hi")).alias("last_lsn"),
        (F.col("_hi") == SEGMENT_BYTES).alias("sealed"), (F.col("bytes") == SEGMENT_BYTES).alias("covered"))


def service_availability(probes: DataFrame, by: str = "phase") -> DataFrame:
    """Successes, failures and error rate of probes around an event."""
    counts = probes.groupBy(by).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
    return counts.withColumn("error_rate", safe_ratio(F.col("fail"), F.col("ok") + F.col("fail")))
