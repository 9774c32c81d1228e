"""Filters over events, messages and catalogs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.decisions import Summary, apply_rule
from tidemark.operators.scale import scan
from tidemark.session import small_side

# Message tags of the row changes, and the payloads that are not events.
DML_TAGS = ("I", "U", "D")
CONTROL_PAYLOADS = ("ready", "heartbeat")


def publication_filter(events: DataFrame, membership: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Events of published tables. A list of ``(schema, table)`` becomes a predicate the file
    source can push down; a table ``(schema, table, from_lsn, to_lsn)`` with half-open ranges
    (null end: still published) applies membership as it was at each event."""
    if not isinstance(membership, DataFrame):
        wanted = F.lit(False)
        for schema, table in membership:
            wanted = wanted | ((F.col("schema") == schema) & (F.col("table") == table))
        return events.where(wanted)
    m = small_side(membership).alias("m")
    e = events.alias("e")
    inside = (
        (F.col("e.schema") == F.col("m.schema")) & (F.col("e.table") == F.col("m.table"))
        & (F.col("e.lsn") >= F.col("m.from_lsn"))
        & (F.col("m.to_lsn").isNull() | (F.col("e.lsn") < F.col("m.to_lsn")))
    )
    return e.join(m, inside, "left_semi")


def since_lsn(events: DataFrame, confirmed: int) -> DataFrame:
    """Events after the confirmed position; reaches the scan as a pushed filter."""
    return events.where(F.col("lsn") > confirmed)


def dml_only(frames: DataFrame) -> DataFrame:
    """Row-change messages; other tags and empty messages are dropped before any parsing."""
    return frames.where(F.substring("data", 1, 1).cast("string").isin(*DML_TAGS))


def split_rejects(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events and rejects, by the ``reject`` reason the resolver left (null: good)."""
    good = resolved.where(F.col("reject").isNull()).drop("reject")
    return good, resolved.where(F.col("reject").isNotNull())


def at_or_after_redo(catalog: DataFrame, redo: str, per_timeline: bool = False) -> DataFrame:
    """Segments whose whole name is at or after the redo segment's name. Whole names compare the
    timeline first, so all of a later timeline passes; ``per_timeline`` keeps the redo's own only."""
    kept = catalog.where(F.col("name") >= redo)
    return kept.where(F.substring("name", 1, 8) == redo[:8]) if per_timeline else kept


def drop_control_payloads(pushes: DataFrame) -> DataFrame:
    return pushes.where(~F.col("payload").isin(*CONTROL_PAYLOADS))


def keep_rule(rows: pd.DataFrame, state: dict | None, column: str, pct: int) -> tuple[dict[str, list], dict]:
    """Which values differ by more than ``pct`` percent from the last kept one."""
    kept = state["kept"] if state else None
    flags = []
    for value in rows[column].tolist():
        moved = kept is None or abs(value - kept) * 100 > kept * pct
        if moved:
            kept = value
        flags.append(moved)
    return {"kept": flags}, {"kept": kept}


class _Moves:
    """Where values of a block move away from a kept one. Up and down are strict records: the first value
    to leave a band around any number is one of them."""

    CHUNK = 512

    def __init__(self, values: Sequence, pct: int):
        self.x, self.pct = np.asarray(values), pct
        heads = np.arange(0, len(self.x), self.CHUNK)
        self.most, self.least = np.maximum.reduceat(self.x, heads), np.minimum.reduceat(self.x, heads)
        self.known: dict[int, int] = {}

    def _left(self, kept, low, high):
        """Whether numbers (or the range from low to high) are outside of the band around ``kept``."""
        return ((high - kept) * 100 > kept * self.pct) | ((kept - low) * 100 > kept * self.pct)

    def next(self, i: int) -> int:
        """The first row after i that is kept if row i was, or -1."""
        kept, at = self.x[i], i + 1
        stop = min(len(self.x), (at // self.CHUNK + 1) * self.CHUNK)
        while at < len(self.x):
            out = self._left(kept, self.x[at:stop], self.x[at:stop])
            if out.any():
                return at + int(out.argmax())
            chunk = -(-stop // self.CHUNK)
            ahead = self._left(kept, self.least[chunk:], self.most[chunk:])
            if not ahead.any():
                return -1
            at = (chunk + int(ahead.argmax())) * self.CHUNK
            stop = min(len(self.x), at + self.CHUNK)
        return -1

    def end(self, i: int) -> int:
        """The last row that is kept if row i is."""
        path = []
        while i not in self.known:
            path.append(i)
            following = self.next(i)
            if following < 0:
                self.known[i] = i
                break
            i = following
        last = self.known[i]
        self.known.update(dict.fromkeys(path, last))
        return last

    def records(self, up: bool) -> np.ndarray:
        best = np.maximum.accumulate(self.x) if up else np.minimum.accumulate(self.x)
        return np.flatnonzero(np.r_[True, best[1:] != best[:-1]])


def keep_summary(column: str, pct: int) -> Summary:
    """The five percent rule by blocks: for each record its value, its row and the value the block ends
    with when that row is kept. The state a block is entered in is kept by the first record outside of
    its band; a block without one passes it on."""
    def of(rows: pd.DataFrame) -> dict:
        moves = _Moves(rows[column].to_numpy(), pct)
        out = {}
        for name, up in (("up", True), ("down", False)):
            at = moves.records(up)
            out[name] = [moves.x[at].tolist(), at.tolist(), [moves.x[moves.end(i)].item() for i in at.tolist()]]
        return out

    def follow(made: dict, state: dict | None) -> dict:
        if state is None:
            return {"kept": made["up"][2][0]}
        kept, firsts = state["kept"], []
        for name, sign in (("up", 1), ("down", -1)):
            values, rows, ends = made[name]
            place = bisect_left(values, True, key=lambda x: (x - kept) * sign * 100 > kept * pct)
            if place < len(values):
                firsts.append((rows[place], ends[place]))
        return {"kept": min(firsts)[1]} if firsts else state

    return Summary(of, follow, (column,))


def significant_change(
    series: DataFrame, column: str, group: Sequence[str], order: Sequence[str], pct: int = 5,
    blocks: int | None = None,
) -> DataFrame:
    """Rows whose value moved by more than ``pct`` percent from the last kept one; the first row of
    a group is its reference. A value equal to the one before it is never kept, so repeats are
    dropped before the chain runs. Values are numbers; rows with a null are left out."""
    series = series.where(F.col(column).isNotNull())
    moved = F.col("_before").isNull() | (F.col("_before") != F.col(column))
    rule = lambda rows, state: keep_rule(rows, state, column, pct)
    steps = scan(series, group, order, blocks).neighbour({"_before": F.col(column)})
    steps = steps.map(lambda df: df.where(moved).drop("_before"))
    return apply_rule(steps, rule, "kept boolean", summary=keep_summary(column, pct)).done().where("kept").drop("kept")
