"""Streams whose rows depend on earlier ones: segment assembly, heartbeats, limits and advice.

The decision rules are the ones of the batch operators; here their state lives in the state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.segments import SEGMENT_BYTES, segment_name_of
from tidemark.operators.advice import MEMORY_OUTPUT, SCALE_OUTPUT, memory_rule, scale_rule
from tidemark.operators.aggregates import segment_pieces
from tidemark.operators.ratelimit import BURST_LINES, RATE_LINES_PER_SECOND, spend


SETTLE_SECONDS = 3600
# Neighbouring segments whose states are kept together: one call of the store for all of them.
SEGMENTS_AT_ONCE = 256


class SegmentState(StatefulProcessor):
    """Merged byte ranges of neighbouring segments; never the bytes.

    The state of a group is a map from segment to its ranges and the time it is due. The ranges of a
    covered segment go at once; what stays is a mark that keeps redelivered bytes from opening it again,
    until ``settle_ms`` after the last of them. A segment that gets no bytes for ``give_up_ms`` is given
    up: its ranges go, and a row with ``expired`` tells what was there. Without ``give_up_ms`` there are
    no timers: marks and open segments stay. A group's timer stands at the first time one of its segments
    is due."""

    def __init__(self, settle_ms: int, give_up_ms: int | None):
        self._settle, self._give_up = settle_ms, give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._segments = handle.getValueState("segments", "text string, timer bigint")

    def _load(self) -> tuple[dict, int | None]:
        text, timer = self._segments.get() if self._segments.exists() else ("{}", None)
        return {int(seg_no): held for seg_no, held in json.loads(text).items()}, timer

    def _keep(self, segments: dict, timer: int | None, fired: bool = False) -> None:
        due = min((d for _, d in segments.values() if d is not None), default=None)
        if timer is not None and timer != due and not fired:
            self._handle.deleteTimer(timer)
        if due is not None and (fired or timer != due):
            self._handle.registerTimer(due)
        if segments:
            self._segments.update((json.dumps(segments), due))
        else:
            self._segments.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segments, timer = self._load()
        fresh: dict[int, list] = {}
        for part in rows:
            for seg_no, low, high in zip(part["seg_no"].tolist(), part["from_off"].tolist(), part["to_off"].tolist()):
                fresh.setdefault(seg_no, []).append((low, high))
        now, out = timerValues.getCurrentProcessingTimeInMs() if self._give_up is not None else 0, []
        for seg_no, pieces in fresh.items():
            known, _ = segments.get(seg_no, ([], None))
            # no ranges: the mark of a covered segment
            covered = seg_no in segments and not known
            if not covered:
                before = _coverage(known)
                known = merge_ranges(known, pieces)
                after = _coverage(known)
                covered = after["covered"]
                if after["sealed"] and after != before:
                    out.append({"timeline": key[0], "seg_no": seg_no, **after, "expired": False})
            due = None if self._give_up is None else now + (self._settle if covered else self._give_up)
            segments[seg_no] = ([] if covered else known, due)
        self._keep(segments, timer)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        segments, timer = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = {seg_no: segments.pop(seg_no)[0] for seg_no, (_, due) in list(segments.items()) if due is not None and due <= now}
        self._keep(segments, timer, fired=True)
        if any(over.values()):
            yield pd.DataFrame([{"timeline": key[0], "seg_no": seg_no, **_coverage(known), "expired": True}
                                for seg_no, known in over.items() if known])

    def close(self) -> None:
        pass


def merge_ranges(known: list, fresh: list) -> list:
    """Union of half-open ranges, sorted, touching ones joined."""
    out: list[list[int]] = []
    for low, high in sorted([*map(tuple, known), *fresh]):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _coverage(ranges: list) -> dict:
    held = sum(high - low for low, high in ranges)
    return {"bytes": held, "sealed": bool(ranges) and ranges[-1][1] == SEGMENT_BYTES, "covered": held == SEGMENT_BYTES}


def assemble_segments(chunks: DataFrame, give_up_seconds: int | None = None, settle_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Stream of segment states: a row when a segment's end is reached, another one whenever bytes that
    were missing arrive later, and one with ``expired`` when it is given up, its end reached or not. The
    newest row of a segment is its state.

    The store holds the ranges of open segments and a mark of covered ones, ``SEGMENTS_AT_ONCE`` neighbours
    in one state, as calls of the store and groups in Python cost more than what is done in them. With ``give_up_seconds``, for
    streams that run on, both leave it after that time, or ``settle_seconds``, without new bytes; later
    bytes begin a new segment. A run over what is available would not end then, as Spark plans a further
    batch for timers that may fall due; without it nothing expires."""
    timed = give_up_seconds is not None
    pieces = segment_pieces(chunks).withColumn("_group", F.floor(F.col("seg_no") / SEGMENTS_AT_ONCE))
    assembled = pieces.groupBy("timeline", "_group").transformWithStateInPandas(
        statefulProcessor=SegmentState(settle_seconds * 1000, give_up_seconds * 1000 if timed else None),
        outputStructType="timeline bigint, seg_no bigint, bytes bigint, sealed boolean, covered boolean, expired boolean",
        outputMode="Update", timeMode="ProcessingTime" if timed else "None")
    return assembled.withColumn("name", segment_name_of(F.col("seg_no"), F.col("timeline")))


class RuleState(StatefulProcessor):
    """A decision rule with its state kept per group. Rows of one micro-batch are put in order."""

    def __init__(self, rule: Callable, order: list[str], keep: list[str], names: list[str]):
        self._rule, self._order, self._keep, self._names = rule, order, keep, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self._order, kind="stable")
        state = json.loads(self._state.get()[0]) if self._state.exists() else None
        columns, state = self._rule(batch, state)
        self._state.update((json.dumps(state),))
        yield batch[self._keep].assign(**{n: columns[n] for n in self._names})

    def close(self) -> None:
        pass


def _rule_stream(rows: DataFrame, group: str, order: list[str], rule: Callable, outputs: str) -> DataFrame:
    keep = rows.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    names = [o.split()[0] for o in outputs.split(", ")]
    return rows.groupBy(group).transformWithStateInPandas(
        statefulProcessor=RuleState(rule, order, keep, names),
        outputStructType=f"{fields}, {outputs}", outputMode="Append", timeMode="None")


def limit_rule(rows: pd.DataFrame, state: dict | None, rate: int, burst: int):
    """Token bucket with the count of lines dropped since the last one that passed."""
    passed, bucket = spend(rows["at_us"].tolist(), state and state["bucket"], rate, burst)
    dropped, notices = (state or {}).get("dropped", 0), []
    for ok in passed:
        notices.append(dropped if ok else 0)
        dropped = 0 if ok else dropped + 1
    return {"passed": passed, "notice": notices}, {"bucket": bucket, "dropped": dropped}


def rate_limit_stream(lines: DataFrame, rate: int = RATE_LINES_PER_SECOND, burst: int = BURST_LINES) -> DataFrame:
    """Streaming form of the line limit; micro-batches arrive in time order per stream."""
    rule = lambda rows, state: limit_rule(rows, state, rate, burst)
    return _rule_stream(lines, "stream", ["at_us", "seq"], rule, "passed boolean, notice bigint")


def scale_decision_stream(ticks: DataFrame, max_workers: int) -> DataFrame:
    """Streaming form of the scaling advice over ticks ``(host, tick, at_s, live, cores)``."""
    rule = lambda rows, state: scale_rule(rows, state, max_workers)
    return _rule_stream(ticks, "host", ["at_s"], rule, SCALE_OUTPUT)


def retune_advice_stream(memory: DataFrame) -> DataFrame:
    return _rule_stream(memory, "host", ["at_s", "seq"], memory_rule, MEMORY_OUTPUT)


class IdleState(StatefulProcessor):
    """A timer per source, moved on by every event and by every heartbeat."""

    def __init__(self, seconds: int):
        self._ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._due = handle.getValueState("due", "ms bigint")

    def _arm(self, now: int) -> None:
        if self._due.exists():
            self._handle.deleteTimer(self._due.get()[0])
        self._due.update((now + self._ms,))
        self._handle.registerTimer(now + self._ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self._due.clear()
        self._arm(due)
        yield pd.DataFrame([{"source": key[0], "at_ms": due}])

    def close(self) -> None:
        pass


def heartbeat_stream(events: DataFrame, source: str = "source", seconds: int = 30) -> DataFrame:
    """A row per source after every ``seconds`` of processing time without an event."""
    keyed = events.select(F.col(source).cast("string").alias("source"))
    return keyed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=IdleState(seconds), outputStructType="source string, at_ms bigint",
        outputMode="Append", timeMode="ProcessingTime")


class PressureState(StatefulProcessor):
    """Growth of the refault counter per host, and a timer that reports a silent host."""

    def __init__(self, seconds: int):
        self._ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "refaults bigint, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last, due = self._last.get() if self._last.exists() else (None, None)
        grown = []
        for value in batch["refaults"].tolist():
            value = None if pd.isna(value) else int(value)
            grown.append(None if value is None or last is None else max(value - last, 0))
            last = value
        if due is not None:
            self._handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self._ms
        self._handle.registerTimer(due)
        self._last.update((last, due))
        yield pd.DataFrame({
            "host": key[0], "ts": batch["ts"], "some_avg10": batch["some_avg10"], "full_avg10": batch["full_avg10"],
            "refaults_increase": pd.Series(grown, index=batch.index, dtype="object"), "disconnected": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([{"host": key[0], "ts": None, "some_avg10": None, "full_avg10": None,
                             "refaults_increase": None, "disconnected": True}])

    def close(self) -> None:
        pass


def pressure_stream(samples: DataFrame, seconds: int = 30) -> DataFrame:
    """Pressure samples as they come, and one row when a host has been silent for ``seconds``."""
    host_type = dict(samples.dtypes)["host"]
    return samples.groupBy("host").transformWithStateInPandas(
        statefulProcessor=PressureState(seconds),
        outputStructType=f"host {host_type}, ts timestamp, some_avg10 double, full_avg10 double, "
                         "refaults_increase bigint, disconnected boolean",
        outputMode="Append", timeMode="ProcessingTime")
