"""Backlogs, heartbeats, lag, restarts and pressure: time-ordered checks without feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.arithmetic import retry_delay_ms
from tidemark.operators.ordering import saturating_growth
from tidemark.operators.scale import neighbour, running, scan

MIB = 1024 * 1024

# Pending events a subscriber may hold, idle seconds before a heartbeat, lag that is
# flagged, log a slot may retain, and seconds after which a process counts as stable.
BACKLOG_CAP = 64
HEARTBEAT_SECONDS = 30
LAG_LIMIT = 64 * MIB
SLOT_CAP = 4096 * MIB
STABLE_SECONDS = 60


def subscriber_backlog(events: DataFrame, progress: DataFrame, cap: int = BACKLOG_CAP, blocks: int | None = None) -> DataFrame:
    """Events after each subscriber's position, and whether the subscriber is dropped for holding
    more than ``cap``. Events per position and subscriber marks are counted in one running sum, so
    no event meets every subscriber. Inputs ``events(lsn)``, ``progress(subscriber, lsn)``."""
    per_lsn = events.groupBy("lsn").agg(F.count("*").alias("_n")).select(
        "lsn", "_n", F.lit(None).cast(dict(progress.dtypes)["subscriber"]).alias("subscriber"), F.lit(0).alias("_mark"))
    marks = progress.select("lsn", F.lit(0).cast("bigint").alias("_n"), "subscriber", F.lit(1).alias("_mark"))
    line = per_lsn.unionByName(marks)
    counted = running(line, [], ["lsn", "_mark", "subscriber"], {"_upto": ("sum", F.col("_n"))}, blocks)
    total = events.agg(F.count("*")).scalar()
    pending = F.col("_total") - F.col("_upto")
    return counted.where(F.col("_mark") == 1).withColumn("_total", total).select(
        "subscriber", "lsn", pending.alias("pending"), (pending > cap).alias("pruned"))


def idle_heartbeats(
    events: DataFrame, source: str = "source", ts: str = "ts", seconds: int = HEARTBEAT_SECONDS,
    order: tuple[str, ...] = (), blocks: int | None = None,
) -> DataFrame:
    """A row ``(source, ts)`` after every ``seconds`` without data, up to just before the next
    event. ``order`` lists tie-breakers for equal times."""
    ahead = neighbour(events, [source], [ts, *order], {"_next": F.col(ts)}, following=True, blocks=blocks)
    step = F.make_dt_interval(secs=F.lit(seconds))
    micro = F.expr("interval 1 microsecond")
    idle = ahead.where(F.col("_next") > F.col(ts) + step)
    return idle.select(source, F.explode(F.sequence(F.col(ts) + step, F.col("_next") - micro, step)).alias("ts"))


def replication_lag(
    stats: DataFrame, limit: int = LAG_LIMIT, slot_cap: int = SLOT_CAP, blocks: int | None = None,
) -> DataFrame:
    """Per sample ``(slot, tick, current_lsn, flush_lsn, restart_lsn)``: lag and whether it is over
    the limit, retained log and whether it is over the slot cap, and whether the restart position
    stood still while the log grew."""
    before = neighbour(stats, ["slot"], ["tick"], {
        "_restart": F.col("restart_lsn"), "_current": F.col("current_lsn")}, blocks=blocks)
    lag = F.col("current_lsn") - F.col("flush_lsn")
    retained = F.col("current_lsn") - F.col("restart_lsn")
    pinned = (F.col("restart_lsn") == F.col("_restart")) & (F.col("current_lsn") > F.col("_current"))
    return before.select(
        *stats.columns, lag.alias("lag_bytes"), (lag > limit).alias("lagging"),
        retained.alias("retained_bytes"), (retained > slot_cap).alias("over_cap"),
        F.coalesce(pinned, F.lit(False)).alias("pinned"))


def crash_loops(runs: DataFrame, stable_seconds: int = STABLE_SECONDS, blocks: int | None = None) -> DataFrame:
    """Per process run ``(process, seq, ran_s)``: restarts since the last stable run and the delay
    before the next start. A run of ``stable_seconds`` resets the streak."""
    stable = F.when(F.col("ran_s") >= stable_seconds, F.col("_rn"))
    marked = scan(runs, ["process"], ["seq"], blocks).number("_rn").running({"_stable": ("max", stable)}).done()
    streak = F.col("_rn") - F.coalesce(F.col("_stable"), F.lit(0).cast("bigint"))
    return marked.select(*runs.columns, streak.alias("restart_streak"), retry_delay_ms(streak).alias("delay_ms"))


def pressure_feed(samples: DataFrame, seconds: int = HEARTBEAT_SECONDS, now: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Pressure samples ``(host, ts, some_avg10, full_avg10, refaults)`` with the growth of the
    refault counter and whether the host then fell silent for more than ``seconds``. The last
    sample of a host is compared with ``now``, if given."""
    placed = scan(samples, ["host"], ["ts"], blocks).neighbour({"_before_refaults": F.col("refaults")})
    ahead = placed.neighbour({"_next": F.col("ts")}, following=True).done()
    ahead = ahead.withColumn("refaults_increase", saturating_growth("refaults"))
    until = F.coalesce("_next", now) if now is not None else F.col("_next")
    silent = until > F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    return ahead.select(*samples.columns, "refaults_increase", F.coalesce(silent, F.lit(False)).alias("disconnected"))
