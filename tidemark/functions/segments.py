"""Segment file names of the log archive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.lsn import HIGH_WORD

SEGMENT_BYTES = 16 * 1024 * 1024
SEGMENTS_PER_WORD = HIGH_WORD // SEGMENT_BYTES


def _hex8(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 8, "0")


def segment_name(pos: Column, timeline: Column, naming: str = "by_word") -> Column:
    """Name of the segment holding a position. ``by_word`` puts the high word of the position
    in the middle; ``flat`` splits the running segment number at bit 32 instead."""
    return segment_name_of(segment_no(pos), timeline, naming)


def segment_no(pos: Column) -> Column:
    """Running number of the segment holding a position."""
    return F.call_function("div", pos, F.lit(SEGMENT_BYTES))


def segment_name_of(seg_no: Column, timeline: Column, naming: str = "by_word") -> Column:
    """Name from a running segment number (position divided by the segment size)."""
    per_word = {"by_word": SEGMENTS_PER_WORD, "flat": HIGH_WORD}[naming]
    seg_no = seg_no.cast("bigint")
    low = F.pmod(seg_no, F.lit(per_word))
    high = F.call_function("div", seg_no, F.lit(per_word))
    return F.concat(_hex8(timeline), _hex8(high), _hex8(low))


def segment_no_of_name(name: Column) -> Column:
    """Running segment number of a name already known to be one."""
    part = lambda at: F.conv(F.substring(name, at, 8), 16, 10).try_cast("bigint")
    return part(9) * F.lit(SEGMENTS_PER_WORD) + part(17)


def is_segment(name: Column) -> Column:
    return name.rlike("^[0-9A-Fa-f]{24}$")


def is_partial(name: Column) -> Column:
    return name.endswith(".partial")


def is_history(name: Column) -> Column:
    return name.rlike("^[0-9A-Fa-f]{8}\\.history$")


def parse_segment_name(name: Column) -> Column:
    """Struct of timeline, hi, lo, seg_no, start_lsn and end_lsn; reads both naming forms.
    A ``.partial`` suffix is accepted. Null for any other text."""
    part = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("bigint")
    hi, lo = part(9), part(17)
    start = hi * F.lit(HIGH_WORD) + lo * F.lit(SEGMENT_BYTES)
    fields = F.struct(
        part(1).alias("timeline"), hi.alias("hi"), lo.alias("lo"),
        (hi * F.lit(SEGMENTS_PER_WORD) + lo).alias("seg_no"),
        start.alias("start_lsn"), (start + F.lit(SEGMENT_BYTES)).alias("end_lsn"),
    )
    return F.when(name.rlike("^[0-9A-Fa-f]{24}(\\.partial)?$"), fields)
