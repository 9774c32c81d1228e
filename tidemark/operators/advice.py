"""Scaling and memory advice: rules that depend on their own last action."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.decisions import Summary, apply_rule
from tidemark.operators.filters import keep_rule, keep_summary
from tidemark.operators.joins import counter_rate
from tidemark.operators.scale import scan

MIB = 1024 * 1024

# Fixed values of the scaling rule: cores per worker, ticks in a row and seconds between actions.
UP_CORES, UP_TICKS, UP_COOLDOWN = 0.75, 2, 30
DOWN_CORES, DOWN_TICKS, DOWN_COOLDOWN = 0.5, 6, 60

# Fixed values of the memory rule: buffer ratio, seconds of quiet and seconds between restarts.
RESTART_RATIO, SETTLE_SECONDS, RESTART_INTERVAL = 1.25, 90, 120
RELOAD_PERCENT = 5

SCALE_OUTPUT = "action string, at_ceiling boolean"
MEMORY_OUTPUT = "reload boolean, restart boolean, buffers_from_mb bigint, buffers_to_mb bigint"


# Streak of hot ticks, streak of cold ticks (both up to their thresholds), time of the last action or None.
_Scaling = tuple[int, int, float | None]


def scale_step(state: _Scaling, at: float, live, cores, max_workers: int) -> tuple[_Scaling, str, bool | None]:
    """One tick. The state leaves out what can decide nothing any more: streak lengths beyond the
    thresholds and an action longer ago than both cooldowns."""
    hot, cold, acted = state
    action, ceiling = "hold", None
    if live and not pd.isna(cores):
        each = cores / live
        idle_for = math.inf if acted is None else at - acted
        hot = hot + 1 if each > UP_CORES else 0
        cold = cold + 1 if live > 1 and cores / (live - 1) < DOWN_CORES else 0
        if hot >= UP_TICKS and live < max_workers and idle_for >= UP_COOLDOWN:
            action = "up"
        elif cold >= DOWN_TICKS and idle_for >= DOWN_COOLDOWN:
            action = "down"
        if action != "hold":
            hot, cold, acted = 0, 0, at
        ceiling = bool(live >= max_workers and each > UP_CORES)
    if acted is not None and at - acted >= max(UP_COOLDOWN, DOWN_COOLDOWN):
        acted = None
    return (min(hot, UP_TICKS), min(cold, DOWN_TICKS), acted), action, ceiling


def scale_rule(rows: pd.DataFrame, state: dict | None, max_workers: int) -> tuple[dict[str, list], dict]:
    """Ticks ``(at_s, live, cores)`` in order; null ``cores`` is a tick without an earlier sample."""
    now: _Scaling = (state["hot"], state["cold"], state["acted"]) if state else (0, 0, None)
    actions, ceilings = [], []
    for at, live, cores in zip(rows["at_s"].tolist(), rows["live"].tolist(), rows["cores"].tolist()):
        now, action, ceiling = scale_step(now, at, live, cores, max_workers)
        actions.append(action)
        ceilings.append(ceiling)
    return {"action": actions, "at_ceiling": ceilings}, dict(zip(("hot", "cold", "acted"), now))


def scale_summary(max_workers: int) -> Summary:
    """The scaling rule by blocks. A block may be entered with any streaks, and with an action so long
    ago that no cooldown counts, or since one of a few stretches of time: within a stretch, all times
    pass both cooldowns at the same ticks. The block runs from all these states at once; states that
    become equal go on as one, and after a cooldown hardly any differ."""
    longest = max(UP_COOLDOWN, DOWN_COOLDOWN)

    def of(rows: pd.DataFrame) -> dict:
        ticks = list(zip(rows["at_s"].tolist(), rows["live"].tolist(), rows["cores"].tolist()))
        start = ticks[0][0]
        # An action at one of these times, or before it but after the last one, has cooled down at the same ticks.
        cuts = sorted({at - wait for at, _, _ in ticks for wait in (UP_COOLDOWN, DOWN_COOLDOWN) if at < start + longest} | {start})
        entries = [(hot, cold, acted) for hot in range(UP_TICKS + 1) for cold in range(DOWN_TICKS + 1) for acted in [None, *range(len(cuts))]]
        # The time of the entry's own action is kept as its cut until the action is replaced or forgotten.
        now = {(hot, cold, None if acted is None else cuts[acted], acted is not None): [n] for n, (hot, cold, acted) in enumerate(entries)}
        for at, live, cores in ticks:
            after: dict[tuple, list[int]] = {}
            for (hot, cold, acted, own), members in now.items():
                state, action, _ = scale_step((hot, cold, acted), at, live, cores, max_workers)
                after.setdefault((*state, own and action == "hold" and state[2] is not None), []).extend(members)
            now = after
        ends, of_entry = [], [0] * len(entries)
        for (hot, cold, acted, own), members in now.items():
            for n in members:
                of_entry[n] = len(ends)
            ends.append([hot, cold, None if own else acted, own])
        return {"cuts": cuts, "ends": ends, "of": of_entry}

    def follow(made: dict, state: dict | None) -> dict:
        state = state or {"hot": 0, "cold": 0, "acted": None}
        cuts = made["cuts"]
        place = 0 if state["acted"] is None else 1 + min(bisect_left(cuts, state["acted"]), len(cuts) - 1)
        n = (state["hot"] * (DOWN_TICKS + 1) + state["cold"]) * (len(cuts) + 1) + place
        hot, cold, acted, own = made["ends"][made["of"][n]]
        return {"hot": hot, "cold": cold, "acted": state["acted"] if own else acted}

    return Summary(of, follow, ("at_s", "live", "cores"))


def scale_ticks(samples: DataFrame, ticks_per_second: int = 100, tick_seconds: int = 5, blocks: int | None = None) -> DataFrame:
    """One row per host and tick: live workers, and cores used since the tick before by workers
    that were there at both ticks."""
    rate = counter_rate(samples, blocks, every_sample=True)
    used = rate.groupBy("host", "tick", "prev_tick").agg(
        F.count_distinct("pid").alias("live"), F.coalesce(F.sum("delta_ticks"), F.lit(0).cast("bigint")).alias("_used"))
    elapsed = (F.col("tick") - F.col("prev_tick")) * tick_seconds
    return used.select(
        "host", "tick", (F.col("tick") * tick_seconds).alias("at_s"), "live",
        F.when(elapsed > 0, F.col("_used") / ticks_per_second / elapsed).alias("cores"))


def scale_decisions(samples: DataFrame, max_workers: int, ticks_per_second: int = 100, tick_seconds: int = 5,
                    blocks: int | None = None) -> DataFrame:
    """Advice per host and tick from cumulative CPU counters ``(host, pid, tick, cpu_ticks)``."""
    ticks = scale_ticks(samples, ticks_per_second, tick_seconds, blocks)
    rule = lambda rows, state: scale_rule(rows, state, max_workers)
    decided = apply_rule(scan(ticks, ["host"], ["at_s"], blocks), rule, SCALE_OUTPUT, summary=scale_summary(max_workers))
    taken = F.when(F.col("action") != "hold", F.col("action"))
    decided = decided.running({"last_action": ("last", taken)}).done()
    hundredths = lambda c: F.floor(c * 100 + 0.5) / 100
    return decided.select(
        "host", "tick", "live", hundredths(F.col("cores")).alias("aggregate_cores"),
        hundredths(F.col("cores") / F.col("live")).alias("per_worker_cores"), "action", "at_ceiling", "last_action")


def buffers_mb(ram_bytes: int) -> int:
    return max(ram_bytes // MIB // 4, 128)


def buffers_moved_enough(tuned_ram: int, new_ram: int) -> bool:
    ratio = buffers_mb(new_ram) / buffers_mb(tuned_ram)
    return ratio >= RESTART_RATIO or ratio <= 1 / RESTART_RATIO


def memory_rule(rows: pd.DataFrame, state: dict | None) -> tuple[dict[str, list], dict]:
    """Samples ``(at_s, ram_bytes)`` in order; the first one is what the server was started with.
    Times so long ago that every wait is over are left out of the state."""
    out: dict[str, list] = {"reload": [], "restart": [], "buffers_from_mb": [], "buffers_to_mb": []}
    state = dict(state) if state else None
    for at, ram in zip(rows["at_s"].tolist(), rows["ram_bytes"].tolist()):
        if state is None:
            state = {"seen": ram, "tuned": ram, "moved": at, "restarted": None}
        reload = abs(ram - state["seen"]) * 100 > state["seen"] * RELOAD_PERCENT
        if reload:
            state.update(seen=ram, moved=at)
        before = buffers_mb(state["tuned"])
        restart = (
            buffers_moved_enough(state["tuned"], state["seen"])
            and (state["moved"] is None or at - state["moved"] >= SETTLE_SECONDS)
            and (state["restarted"] is None or at - state["restarted"] >= RESTART_INTERVAL)
        )
        if restart:
            state.update(tuned=state["seen"], restarted=at)
        for name, wait in (("moved", SETTLE_SECONDS), ("restarted", RESTART_INTERVAL)):
            if state[name] is not None and at - state[name] >= wait:
                state[name] = None
        out["reload"].append(reload)
        out["restart"].append(restart)
        out["buffers_from_mb"].append(before)
        out["buffers_to_mb"].append(buffers_mb(state["tuned"]))
    return out, state


class _Restarts:
    """Rows of a block with the RAM last reloaded: which restarts follow from which. Rows are grouped in
    stretches of one value, and only rows that had quiet for long enough count."""

    def __init__(self, at: list, ram: list, quiet: list):
        self.rows = [(a, r) for a, r, q in zip(at, ram, quiet) if q]
        self.times = [a for a, _ in self.rows]
        self.starts = [i for i, (_, r) in enumerate(self.rows) if i == 0 or self.rows[i - 1][1] != r]
        self.known: dict[int, int] = {}

    def first(self, tuned: int, since: float | None, after: int = 0) -> int:
        """The first row from ``after`` on that restarts what was tuned for that RAM at that time, or -1."""
        at = after if since is None else max(after, bisect_left(self.times, since + RESTART_INTERVAL))
        stretch = bisect_right(self.starts, at) - 1
        while at < len(self.rows):
            if buffers_moved_enough(tuned, self.rows[at][1]):
                return at
            stretch += 1
            at = self.starts[stretch] if stretch < len(self.starts) else len(self.rows)
        return -1

    def end(self, i: int) -> int:
        """The last restart that follows from one at row i."""
        path = []
        while i not in self.known:
            path.append(i)
            following = self.first(self.rows[i][1], self.rows[i][0], i + 1)
            if following < 0:
                self.known[i] = i
                break
            i = following
        last = self.known[i]
        self.known.update(dict.fromkeys(path, last))
        return last


def restart_rule(rows: pd.DataFrame, state: dict | None) -> tuple[dict[str, list], dict]:
    """Samples ``(at_s, ram_bytes, seen, moved_at)`` in order; the first one is what the server was started
    with. A restart longer ago than the interval is left out of the state."""
    out: dict[str, list] = {"restart": [], "buffers_from_mb": [], "buffers_to_mb": []}
    state = dict(state) if state else None
    for at, ram, seen, moved in zip(*(rows[c].tolist() for c in ("at_s", "ram_bytes", "seen", "moved_at"))):
        state = state or {"tuned": ram, "restarted": None}
        before = buffers_mb(state["tuned"])
        restart = (
            buffers_moved_enough(state["tuned"], seen) and at - moved >= SETTLE_SECONDS
            and (state["restarted"] is None or at - state["restarted"] >= RESTART_INTERVAL)
        )
        if restart:
            state.update(tuned=seen, restarted=at)
        if state["restarted"] is not None and at - state["restarted"] >= RESTART_INTERVAL:
            state["restarted"] = None
        out["restart"].append(restart)
        out["buffers_from_mb"].append(before)
        out["buffers_to_mb"].append(buffers_mb(state["tuned"]))
    return out, state


def restart_summary() -> Summary:
    """The restart rule by blocks: the rows at which an entry state may restart first, and where each of
    them leads. These are all quiet rows up to one interval after the start (a restart before the block
    may still hold up any of them), and after that the first quiet row of each stretch of one value."""
    def of(rows: pd.DataFrame) -> dict:
        at, seen = rows["at_s"].tolist(), rows["seen"].tolist()
        made = _Restarts(at, seen, [a - m >= SETTLE_SECONDS for a, m in zip(at, rows["moved_at"].tolist())])
        late = bisect_right(made.times, at[0] + RESTART_INTERVAL)
        stops = sorted({*range(min(late + 1, len(made.rows))), *made.starts})
        ends = [made.rows[made.end(i)] for i in stops]
        return {"first": rows["ram_bytes"].tolist()[0], "last_at": at[-1], "stops": [[*made.rows[i], *e] for i, e in zip(stops, ends)]}

    def follow(made: dict, state: dict | None) -> dict:
        state = state or {"tuned": made["first"], "restarted": None}
        free = -math.inf if state["restarted"] is None else state["restarted"] + RESTART_INTERVAL
        for at, seen, end_at, end_seen in made["stops"]:
            if at >= free and buffers_moved_enough(state["tuned"], seen):
                state = {"tuned": end_seen, "restarted": end_at}
                break
        over = state["restarted"] is not None and made["last_at"] - state["restarted"] >= RESTART_INTERVAL
        return {"tuned": state["tuned"], "restarted": None if over else state["restarted"]}

    return Summary(of, follow, ("at_s", "ram_bytes", "seen", "moved_at"))


def retune_advice(memory: DataFrame, order: tuple[str, ...] = ("at_s", "seq"), blocks: int | None = None) -> DataFrame:
    """Advice per host and memory sample ``(host, seq, at_s, ram_bytes)``: reload on a move of more
    than 5 %; restart only for a real change of the buffers, after quiet, and not too often. The moves
    are the five percent rule; what was last reloaded, and when, is handed on from row to row; only the
    restarts depend on their own last decision."""
    rows = scan(memory, ["host"], order, blocks)
    if rows.blocks == 1:  # nothing to hand on between blocks
        return apply_rule(rows, memory_rule, MEMORY_OUTPUT).done()

    def keep(part: pd.DataFrame, state: dict | None) -> tuple[dict[str, list], dict]:
        out, state = keep_rule(part, state, "ram_bytes", RELOAD_PERCENT)
        return {"_kept": out["kept"]}, state

    rows = apply_rule(rows, keep, "_kept boolean", summary=keep_summary("ram_bytes", RELOAD_PERCENT))
    rows = rows.number("_rn").running({"seen": ("last", F.when(F.col("_kept"), F.col("ram_bytes"))),
                                       "moved_at": ("last", F.when(F.col("_kept"), F.col("at_s")))})
    rows = rows.map(lambda df: df.withColumn("reload", F.col("_kept") & (F.col("_rn") > 1)).drop("_kept", "_rn"))
    done = apply_rule(rows, restart_rule, "restart boolean, buffers_from_mb bigint, buffers_to_mb bigint", summary=restart_summary()).done()
    return done.select(*memory.columns, "reload", "restart", "buffers_from_mb", "buffers_to_mb")
