"""Token-bucket limit of log lines.

Tokens are counted in whole millionths, so refills never round and a decision does not depend on
how many earlier refills were summed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.decisions import apply_rule, rule_ends
from tidemark.operators.scale import BLOCK, scan

# Lines per second and burst depth.
RATE_LINES_PER_SECOND = 500
BURST_LINES = 1000
NOTICE_TEXT = "[dropped %d log lines]"

TOKEN = 1_000_000


def spend(times_us: list[int], state: dict | None, rate: int, burst: int) -> tuple[list[bool], dict | None]:
    """Which lines pass, for arrival times in order, from a full bucket or a kept state."""
    full = burst * TOKEN
    tokens, last = (state["tokens"], state["at"]) if state else (full, times_us[0] if times_us else 0)
    passed = []
    for at in times_us:
        tokens = min(tokens + (at - last) * rate, full)
        last = at
        ok = tokens >= TOKEN
        if ok:
            tokens -= TOKEN
        passed.append(ok)
    return passed, {"tokens": tokens, "at": last}


def _likely_states(cut: DataFrame, group: list[str], order: list[str], rate: int, burst: int) -> DataFrame:
    """Entry state of every block without running the blocks one after another.

    A bucket that may lose its last fraction of a token follows ``clamp(x + c, low, high)``; such
    steps compose into one triple per block. It stays within one token below the real bucket, and
    the real bucket's fraction is known from the time since it was last full, so both together
    give the real value whenever that time is known; the caller verifies and repairs the rest."""
    full, top = burst * TOKEN, (burst - 1) * TOKEN
    keys = [*group, BLOCK]
    key_types = ",".join(f"{k}:{dict(cut.dtypes)[k]}" for k in keys)

    def summarise(rows: pd.DataFrame, state: dict | None):
        times = rows["at_us"].tolist()
        if state is None:
            state = {"first": times[0], "last": times[0], "shift": 0, "low": 0, "high": top, "floor": 0, "full_at": None}
            times = times[1:]
        shift, low, high, floor, last, full_at = (state[k] for k in ("shift", "low", "high", "floor", "last", "full_at"))
        for at in times:
            refill = (at - last) * rate
            step = refill - TOKEN
            shift += step
            low, high = min(max(low + step, 0), top), min(max(high + step, 0), top)
            if floor + refill >= full:
                full_at = at
            floor = min(max(floor + step, 0), top)
            last = at
        return {}, {"first": state["first"], "last": last, "shift": shift, "low": low, "high": high, "floor": floor, "full_at": full_at}

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(BLOCK)
        out, level, last, full_at = [], None, None, None
        for part in map(json.loads, rows["_exit"]):
            if level is None:
                out.append(None)
                level, full_at = top, part["first"]
            else:
                short = (full + (last - full_at) * rate - level) % TOKEN
                out.append(json.dumps({"tokens": level + short, "at": last}))
                refill = (part["first"] - last) * rate
                if level + refill >= full:
                    full_at = part["first"]
                level = min(max(level + refill - TOKEN, 0), top)
            level = min(max(level + part["shift"], part["low"]), part["high"])
            last = part["last"]
            full_at = full_at if part["full_at"] is None else part["full_at"]
        return rows[keys].assign(_entry=out)

    per_block = rule_ends(cut.withColumn("_entry", F.lit(None).cast("string")), keys, order, summarise)
    # one row per block of a group
    return per_block.groupBy(*group).applyInPandas(chain, f"struct<{key_types},_entry:string>")


def rate_limit(
    lines: DataFrame, rate: int = RATE_LINES_PER_SECOND, burst: int = BURST_LINES,
    group: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("at_us", "seq"),
    blocks: int | None = None,
) -> DataFrame:
    """Lines ``(stream, seq, at_us, ...)`` with ``passed`` and, on the first line that passes after
    drops, ``notice``: how many were dropped. Drops at the end of a stream are never reported."""
    def rule(rows: pd.DataFrame, state: dict | None):
        passed, end = spend(rows["at_us"].tolist(), state, rate, burst)
        return {"passed": passed}, end

    keys, by = list(group), list(order)
    slim = lines.select(*dict.fromkeys([*keys, *by]))
    decided = apply_rule(scan(slim, keys, by, blocks), rule, "passed boolean",
                         first_guess=lambda cut: _likely_states(cut, keys, by, rate, burst))
    newest_pass = F.when(F.col("passed"), F.col("_rn"))
    before = (decided.number("_rn").running({"_newest": ("max", newest_pass)})
              .neighbour({"_before": F.col("_newest")}).done())
    dropped = F.col("_rn") - F.coalesce(F.col("_before"), F.lit(0).cast("bigint")) - 1
    verdict = before.select(*keys, *[o for o in by if o not in keys], "passed",
                            F.when(F.col("passed"), dropped).otherwise(F.lit(0).cast("bigint")).alias("notice"))
    if set(lines.columns) == set(slim.columns):
        return verdict
    return lines.join(verdict, list(dict.fromkeys([*keys, *by])))


def limited_stream(limited: DataFrame, group: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("at_us", "seq"),
                   text: str = NOTICE_TEXT) -> DataFrame:
    """What is sent on: passing lines, each preceded by a notice row if lines were dropped before
    it. Rows ``(stream, at_us, seq, part, line, dropped_count)``; ``part`` 0 is the notice."""
    note = F.struct(F.lit(0).alias("part"), F.replace(F.lit(text), F.lit("%d"), F.col("notice").cast("string")).alias("line"),
                    F.col("notice").alias("dropped_count"))
    line = F.struct(F.lit(1).alias("part"), F.col("line"), F.lit(0).cast("bigint").alias("dropped_count"))
    rows = F.when(F.col("notice") > 0, F.array(note, line)).otherwise(F.array(line))
    return limited.where("passed").select(*group, *order, F.inline(rows))
