"""Ordered analysis of catalogs, events and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.lsn import lsn_parse
from tidemark.functions.segments import SEGMENT_BYTES, is_segment, parse_segment_name, segment_no_of_name
from tidemark.operators.joins import metric_rank
from tidemark.operators.scale import neighbour, row_numbers, running, scan
from tidemark.session import small_side

# Fixed value: the smallest number of segments a retention job may be set to keep.
MIN_KEEP = 8


def complete_segments(catalog: DataFrame) -> DataFrame:
    return catalog.where(is_segment(F.col("name")))


def list_segments(catalog: DataFrame) -> DataFrame:
    """Names of complete segments, ascending (a range-partitioned sort)."""
    return complete_segments(catalog).select("name").orderBy("name")


def highest_segment(catalog: DataFrame) -> DataFrame:
    """The greatest name of a complete segment; null for an empty catalog."""
    return complete_segments(catalog).agg(F.max("name").alias("name"))


def retention_plan(catalog: DataFrame, keep: int) -> DataFrame:
    """``keep`` or ``delete`` for each complete segment: the ``keep`` greatest names of each timeline
    stay, compared as text; rows that repeat a name share its action. Partial and history files are
    never in the plan. A blocked scan numbers the names, and all rows compare with the name at ``keep``."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    segments = complete_segments(catalog).withColumn("_tl", F.substring("name", 1, 8))
    # 22 digits in text order: a name's 16 characters after the timeline as two numbers
    digits = F.translate(F.substring("name", 9, 16), "abcdef", "GHIJKL")
    place = lambda at, n: -F.conv(F.substring(digits, at, n), 22, 10).cast("bigint")
    placed = segments.select("_tl", "name", place(1, 14).alias("_high"), place(15, 2).alias("_low")).distinct()
    ranked = row_numbers(placed, ["_tl"], ["_high", "_low"], "_rank")
    cutoff = ranked.where(F.col("_rank") <= keep).groupBy("_tl").agg(F.min("name").alias("_cutoff"))
    action = F.when(F.col("name") < F.col("_cutoff"), "delete").otherwise("keep")
    return segments.join(small_side(cutoff), "_tl").select(*catalog.columns, action.alias("action"))


def replay_horizon(catalog: DataFrame, redo: str) -> DataFrame:
    """One row: how far replay can go from redo on its timeline before the first missing segment.
    A gap stalls replay; segments behind it are not reachable. A segment ends a run when its
    successor is not in the catalog: every segment also speaks for its predecessor, so one
    aggregation by segment number finds the ends, without an ordered scan."""
    mine = complete_segments(catalog).where(
        (F.upper(F.substring("name", 1, 8)) == redo[:8].upper()) & (F.upper("name") >= redo.upper()))
    told = F.array(F.struct(F.lit(0).alias("back"), F.lit(True).alias("here")), F.struct(F.lit(1).alias("back"), F.lit(False).alias("here")))
    named = mine.select(segment_no_of_name(F.col("name")).alias("no"), F.inline(told))
    known = named.groupBy((F.col("no") - F.col("back")).alias("no")).agg(
        F.bool_or("here").alias("here"), F.bool_or(~F.col("here")).alias("followed"))
    here = F.col("here")
    run = known.agg(
        F.min(F.when(here & ~F.col("followed"), F.col("no"))).alias("run_end"),
        F.min(F.when(here, F.col("no"))).alias("lowest"), F.count_if(here).alias("available"))
    start = parse_segment_name(F.lit(redo))
    first = start["seg_no"]
    last = F.when(F.col("lowest") == first, F.col("run_end"))
    reachable = F.coalesce(last - first + 1, F.lit(0).cast("bigint"))
    return run.select(
        start["timeline"].alias("timeline"), first.alias("redo_seg"), last.alias("last_reachable"),
        (F.coalesce(last, first - 1) + 1).alias("first_missing"),
        reachable.alias("reachable"), (F.col("available") - reachable).alias("unreachable"),
    )


def order_violations(events: DataFrame, source: str = "source", arrival: str = "seq", blocks: int | None = None) -> DataFrame:
    """Events whose position is below that of the event which arrived before them."""
    with_previous = neighbour(events, [source], [arrival], {"prev_lsn": F.col("lsn")}, blocks=blocks)
    return with_previous.where(F.col("lsn") < F.col("prev_lsn"))


def saturating_growth(column: str) -> Column:
    """Growth since ``_before_<column>``, at least 0; null when either is null."""
    growth = F.col(column) - F.col(f"_before_{column}")
    return F.when(growth.isNotNull(), F.greatest(growth, F.lit(0).cast("bigint")))


def counter_increase(
    samples: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str],
    blocks: int | None = None,
) -> DataFrame:
    """Saturating growth of cumulative counters since the sample before; null stays null."""
    before = neighbour(samples, group, order, {f"_before_{c}": F.col(c) for c in columns}, blocks=blocks)
    grown = {f"{c}_increase": saturating_growth(c) for c in columns}
    return before.withColumns(grown).drop(*[f"_before_{c}" for c in columns])


def flush_progress(messages: DataFrame, slot: str = "slot", arrival: str = "seq", blocks: int | None = None) -> DataFrame:
    """Highest write and flush position after each message. Data and keepalive messages advance
    both, also those that decode to no event."""
    return running(messages, [slot], [arrival], {
        "write_lsn": ("max", F.col("lsn")), "flush_lsn": ("max", F.col("lsn")),
    }, blocks)


def parse_history(history: DataFrame) -> DataFrame:
    """Lines of history files ``(timeline, line)`` to ``(timeline, parent_tli, switch_lsn)``; blank
    and comment lines are skipped."""
    pattern = r"^\s*(\d+)\s+([0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8})"
    return history.where(F.col("line").rlike(pattern)).select(
        "timeline", F.regexp_extract("line", pattern, 1).try_cast("bigint").alias("parent_tli"),
        lsn_parse(F.regexp_extract("line", pattern, 2)).alias("switch_lsn"),
    )


def timeline_ranges(history: DataFrame, latest: int | None = None) -> DataFrame:
    """Half-open position range in which each timeline is the one to follow to the latest
    timeline. History rows ``(timeline, parent_tli, switch_lsn)``: the file of a timeline lists
    all its ancestors with the position where each was left."""
    mine = history if latest is None else history.where(F.col("timeline") == latest)
    # one entry per ancestor of a timeline
    left = F.array_sort(F.collect_list(F.struct("switch_lsn", F.col("parent_tli").alias("tl"))))
    newest = mine.groupBy("timeline").agg(left.alias("left")).orderBy(F.desc("timeline")).limit(1)
    zero, open_end = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

    def stretch(tl: Column, start: Column, end: Column) -> Column:
        return F.struct(tl.alias("timeline"), start.alias("from_lsn"), end.alias("to_lsn"))

    before = lambda i: F.when(i > 0, F.get("left", i - 1)["switch_lsn"]).otherwise(zero)
    ancestors = F.transform("left", lambda a, i: stretch(a["tl"], before(i), a["switch_lsn"]))
    tail = F.array(stretch(F.col("timeline"), F.element_at("left", -1)["switch_lsn"], open_end))
    return newest.select(F.inline(F.concat(ancestors, tail)))


def timeline_path(catalog: DataFrame, history: DataFrame, latest: int | None = None) -> DataFrame:
    """Segments to replay, following ancestors up to their switch points and then the child. The
    segment that holds a switch point is taken from the child, which starts with a copy of it. A timeline
    without a history file has no ancestors: it is all of the path if it is asked for, or, where no
    timeline has a file, if it is the catalog's oldest."""
    ranges = timeline_ranges(history, latest)
    if ranges.isEmpty():  # one row per ancestor
        alone = F.lit(latest).cast("bigint") if latest is not None else F.conv(F.min(F.substring("name", 1, 8)), 16, 10).cast("bigint")
        whole = [F.lit(0).cast("bigint").alias("from_lsn"), F.lit(None).cast("bigint").alias("to_lsn")]
        ranges = complete_segments(catalog).agg(F.count("*"), alone.alias("timeline")).select("timeline", *whole)
    ranges = ranges.withColumn("prefix", F.lpad(F.hex("timeline"), 8, "0"))
    ranges = small_side(ranges.select("prefix", "from_lsn", "to_lsn"))
    end = (segment_no_of_name(F.col("name")) + 1) * F.lit(SEGMENT_BYTES)
    named = complete_segments(catalog).withColumns({"end_lsn": end, "prefix": F.upper(F.substring("name", 1, 8))})
    on_path = (F.col("end_lsn") > F.col("from_lsn")) & (F.col("to_lsn").isNull() | (F.col("end_lsn") <= F.col("to_lsn")))
    return named.join(ranges, "prefix").where(on_path).select(
        *catalog.columns, (F.col("end_lsn") - SEGMENT_BYTES).alias("start_lsn"), "end_lsn")


def hot_streak(
    samples: DataFrame, group: Sequence[str], order: Sequence[str], hot: Column, blocks: int | None = None,
) -> DataFrame:
    """Length of the run of consecutive hot samples that ends at each row; 0 where it is not hot."""
    cold = F.when(~F.coalesce(hot, F.lit(False)), F.col("_rn"))
    placed = scan(samples, group, order, blocks).number("_rn").running({"_cold": ("max", cold)}).done()
    streak = F.col("_rn") - F.coalesce(F.col("_cold"), F.lit(0).cast("bigint"))
    return placed.withColumn("streak", streak).drop("_rn", "_cold")


def rank_metrics(delta: DataFrame) -> DataFrame:
    """Headline metrics first in their fixed order, the others after, by name and key."""
    ranked = delta.withColumn("rank", metric_rank(F.col("name")))
    return ranked.orderBy(F.col("rank").asc_nulls_last(), "name", "key")
