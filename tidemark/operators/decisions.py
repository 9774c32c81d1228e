"""Running a decision rule whose next step depends on its own last decision.

Such a rule is a chain, so a group cannot simply be split. A rule with a summary is split in two
passes: each block of a group is summarised, by itself, as a map from every state it may be entered
in to the state it ends in; the maps are followed from block to block, which gives each block's entry
state; then every block runs from there.

A rule without a summary is run from guessed states instead; the state each block ends in becomes the
entry state of the next one, and only blocks whose entry state changed are run again, until nothing
changes. By induction over the blocks both equal one run over the whole group. Rows reach a rule in
order and in Arrow batches, so no task holds a whole block; a summary sees the block's own columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.scale import BLOCK, UNCUT, Scan
from tidemark.session import cut_lineage, stored_copy

# rule(rows in order, state or None for a fresh start) -> (output columns, end state)
Rule = Callable[[pd.DataFrame, dict | None], tuple[dict[str, list], dict]]


@dataclass(frozen=True)
class Summary:
    """``of(rows of a block)`` is a map that can be written as JSON; ``follow(map, state)`` is the state the
    block ends in when entered in a state (None: a fresh start). ``columns`` are all that ``of`` reads."""

    of: Callable[[pd.DataFrame], dict]
    follow: Callable[[dict, dict | None], dict]
    columns: tuple[str, ...]


def _stretches(batch: pd.DataFrame, keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Pieces of a sorted batch with equal keys."""
    fresh = pd.Series(False, index=batch.index)
    for k in keys:
        before = batch[k].shift()
        fresh |= (batch[k] != before) & ~(batch[k].isna() & before.isna())
    for _, piece in batch.groupby(fresh.cumsum().to_numpy(), sort=False):
        yield piece


def _key_of(piece: pd.DataFrame, keys: Sequence[str]) -> tuple:
    return tuple(None if pd.isna(v) else v for v in piece[list(keys)].iloc[0])


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def rule_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule) -> DataFrame:
    """State each group of rows ends in: ``(keys, _entry, _exit)``, states as JSON text. Rows carry
    their entry state in ``_entry``."""
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _entry string, _exit string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, head = None, None, None
        for batch in batches:
            ended = []
            for piece in _stretches(batch, keys):
                key = _key_of(piece, keys)
                if head is None or key != current:
                    if head is not None:
                        ended.append(head.assign(_exit=json.dumps(state)))
                    current, head = key, piece[[*keys, "_entry"]].head(1)
                    entry = head["_entry"].iloc[0]
                    state = json.loads(entry) if entry else None
                _, state = rule(piece, state)
            if ended:
                yield pd.concat(ended)
        if head is not None:
            yield head.assign(_exit=json.dumps(state))

    return _in_order(df, keys, order).mapInPandas(run, schema)


def block_maps(df: DataFrame, keys: Sequence[str], order: Sequence[str], summary: Summary) -> DataFrame:
    """``(keys, _map)``: one row per block, its summary as JSON text."""
    keys = list(keys)
    needed = list(dict.fromkeys([*keys, *order, *summary.columns]))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _map string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []

        def made() -> pd.DataFrame:
            block = pd.concat(held)
            return block[keys].head(1).assign(_map=json.dumps(summary.of(block[list(summary.columns)])))

        for batch in batches:
            for piece in _stretches(batch, keys):
                key = _key_of(piece, keys)
                if held and key != current:
                    yield made()
                    held = []
                current = key
                held.append(piece)
        if held:
            yield made()

    return _in_order(df.select(*needed), keys, order).mapInPandas(run, schema)


def followed(maps: DataFrame, group: Sequence[str], summary: Summary) -> DataFrame:
    """``(group, block, _entry)`` from the maps of the blocks, which are read one after the other."""
    keys = [*group, BLOCK]
    types = dict(maps.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _entry string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            entries = []
            for place, text in enumerate(batch["_map"].tolist()):
                key = _key_of(batch.iloc[place:place + 1], group) if group else ()
                if key != current:
                    current, state = key, None
                entries.append(None if state is None else json.dumps(state))
                state = summary.follow(json.loads(text), state)
            yield batch[keys].assign(_entry=entries)

    dealt = maps.repartition(*group) if group else maps.coalesce(1)
    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def _rule_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, outputs: str) -> DataFrame:
    """The rows with the rule's output columns, each group started from its ``_entry``. The input
    columns pass through as they are; only the rule sees them as pandas values."""
    keys = list(keys)
    added = to_arrow_schema(T.StructType.fromDDL(outputs))
    kept = [c for c in df.columns if c != "_entry"]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, None, False
        for batch in batches:
            values: dict[str, list] = {name: [] for name in added.names}
            for piece in _stretches(batch.to_pandas(), keys):
                key = _key_of(piece, keys)
                if not started or key != current:
                    current, started = key, True
                    entry = piece["_entry"].iloc[0]
                    state = json.loads(entry) if entry else None
                columns, state = rule(piece, state)
                for name in values:
                    values[name].extend(columns[name])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(values[f.name], type=f.type) for f in added]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added.names])

    return _in_order(df, keys, order).mapInArrow(run, schema)


def apply_rule(
    rows: Scan, rule: Rule, outputs: str, first_guess: Callable[[DataFrame], DataFrame] | None = None,
    summary: Summary | None = None,
) -> Scan:
    """Add the rule's ``outputs`` (a DDL list) to a scan, by way of its ``summary``. Without one,
    ``first_guess`` may turn the rows of cut groups into ``(group, block, _entry)``, likely entry states
    of their blocks as JSON text."""
    keys = [*rows.group, BLOCK]
    fresh = F.lit(None).cast("string")
    if rows.blocks == 1:
        return rows.map(lambda df: _rule_rows(df.withColumn("_entry", fresh), keys, rows.order, rule, outputs))

    # the rounds read the rows several times: store them once instead of deriving them again
    rows = rows.map(lambda df: stored_copy(df, "scan"))
    large = rows.df.where(F.col(BLOCK) != UNCUT)

    if summary is not None:
        entries = stored_copy(followed(stored_copy(block_maps(large, keys, rows.order, summary), "maps"), rows.group, summary), "entries")
        return rows.map(lambda df: _rule_rows(df.join(F.broadcast(entries), keys, "left"), keys, rows.order, rule, outputs))

    def run_from(entries: DataFrame) -> DataFrame:
        return cut_lineage(rule_ends(large.join(entries, keys), keys, rows.order, rule))

    guessed = first_guess(large) if first_guess else large.select(*keys).distinct().withColumn("_entry", fresh)
    exits = run_from(guessed)
    # one row per block of a group
    following = Window.partitionBy(*rows.group).orderBy(BLOCK)
    while True:
        linked = exits.withColumn("_next", F.lag("_exit").over(following))
        changed = cut_lineage(linked.where(~F.col("_next").eqNullSafe(F.col("_entry"))).select(
            *keys, F.col("_next").alias("_entry")))
        if changed.isEmpty():
            break
        exits = cut_lineage(exits.join(changed.select(*keys), keys, "left_anti").unionByName(run_from(changed)))
    settled = exits.select(*keys, "_entry")
    return rows.map(lambda df: _rule_rows(df.join(settled, keys, "left"), keys, rows.order, rule, outputs))
