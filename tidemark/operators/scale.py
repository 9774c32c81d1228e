"""Ordered scans over groups of any size.

A window partitioned by a slot, stream, host or timeline puts a whole group in one task, and one
group may hold a third of all rows. The scans here deal the rows out by range of their whole order
(group columns, then order columns), so a block holds about as many rows as any other whatever the
groups and ties are. Only groups that lie in several blocks are cut; the window runs per (group,
block), and one summary row per block is carried across. Small inputs use one block, which is the
plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import UNKNOWN_BYTES, plan_bytes, source_bytes, stored_copy

BLOCK = "_block"
BLOCKS_CONF = "spark.tidemark.scanBlocks"
BLOCK_BYTES = 64 << 20

# Block number of the rows of groups that are not cut.
UNCUT = -1

_SCAN = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a),
}


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The input and the number of blocks for it: its size over the block size, 1 at least. The size is
    that of the sources where the optimiser guesses more (it takes a join for a product); rows whose
    size nobody knows are stored, which tells it. The setting ``spark.tidemark.scanBlocks`` overrides it."""
    fixed = df.sparkSession.conf.get(BLOCKS_CONF, "")
    if fixed:
        return df, max(1, int(fixed))
    size = min(plan_bytes(df), source_bytes(df))
    if size >= UNKNOWN_BYTES:
        df = stored_copy(df, "sized")
        size = plan_bytes(df)
    return df, 1 + size // block_bytes


def _cut_groups(dealt: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that lie in more than one block. Blocks are ranges of the group columns first, so such a
    group is the first or the last one of each of its blocks: two candidates per block."""
    one = F.struct(*group)
    ends = dealt.groupBy(BLOCK).agg(F.array_distinct(F.array(F.min(one), F.max(one))).alias("_ends"))
    spread = ends.select(F.explode("_ends").alias("_g")).groupBy("_g").count().where("count > 1")
    return spread.select(*[F.col("_g")[g].alias(f"_cut_{g}") for g in group], F.lit(True).alias("_cut"))


def with_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str], blocks: int | None = None) -> tuple[DataFrame, int]:
    """Add the block number, from 0, or UNCUT for rows of groups that lie in one block. Block numbers
    rise with the order. The dealt rows are stored: sampling might cut them elsewhere the next time."""
    df, wanted = (df, blocks) if blocks else block_count(df)
    if wanted <= 1:
        return df.withColumn(BLOCK, F.lit(UNCUT)), 1
    dealt = df.repartitionByRange(wanted, *[F.col(c).asc_nulls_first() for c in dict.fromkeys([*group, *order])])
    dealt = stored_copy(dealt.withColumn(BLOCK, F.spark_partition_id()), "blocks")
    if not group:
        return dealt, wanted
    # at most two rows per block
    cut = F.broadcast(_cut_groups(dealt, group))
    same = [F.col(g).eqNullSafe(F.col(f"_cut_{g}")) for g in group]
    marked = dealt.join(cut, same, "left").withColumn(BLOCK, F.when(F.col("_cut"), F.col(BLOCK)).otherwise(F.lit(UNCUT)))
    return marked.drop("_cut", *[f"_cut_{g}" for g in group]), wanted


def _orders(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(o).desc() if descending else F.col(o).asc() for o in order]


@dataclass(frozen=True)
class Scan:
    """Rows in order within groups. Steps of one scan share the same blocks, shuffle and sort.

    All of ``order`` together is unique within a group; its columns may have any type that sorts."""

    df: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]
    blocks: int

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Scan:
        """Add or drop columns; the rows and the group and order columns stay."""
        return replace(self, df=change(self.df))

    def _carry(self, carried: DataFrame) -> DataFrame:
        """Attach block summaries, as many as cut groups have blocks; rows of uncut groups have none."""
        keys = [*self.group, BLOCK]
        renamed = F.broadcast(carried).select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                                 *[c for c in carried.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        return self.df.join(renamed, same, "left").drop(*[f"_k_{k}" for k in keys])

    def running(self, outputs: dict[str, tuple[str, Column]]) -> Scan:
        """Running aggregates up to and including each row. ``outputs`` maps a name to ``(kind,
        column)``, kind one of sum, max, min, last (newest non-null)."""
        inputs = {f"_in_{o}": c for o, (_, c) in outputs.items()}
        given = self.df.withColumns(inputs)
        local = (Window.partitionBy(*self.group, BLOCK).orderBy(*_orders(self.order))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        scanned = given.withColumns({o: _SCAN[k](F.col(f"_in_{o}")).over(local) for o, (k, _) in outputs.items()})
        if self.blocks > 1:
            position = F.struct(*self.order)
            total = {**_SCAN, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), position))}
            per_block = given.where(F.col(BLOCK) != UNCUT).groupBy(*self.group, BLOCK).agg(
                *[total[k](F.col(f"_in_{o}")).alias(f"_b_{o}") for o, (k, _) in outputs.items()])
            # one row per block of a group
            before = Window.partitionBy(*self.group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
            carried = per_block.select(
                *self.group, BLOCK,
                *[_SCAN[k](F.col(f"_b_{o}")).over(before).alias(f"_p_{o}") for o, (k, _) in outputs.items()],
            )
            scanned = replace(self, df=scanned)._carry(carried).withColumns(
                {o: _MERGE[k](F.col(f"_p_{o}"), F.col(o)) for o, (k, _) in outputs.items()}
            ).drop(*[f"_p_{o}" for o in outputs])
        return replace(self, df=scanned.drop(*inputs))

    def number(self, name: str) -> Scan:
        """Position of each row within its group, from 1."""
        return self.running({name: ("sum", F.lit(1).cast("bigint"))})

    def neighbour(self, outputs: dict[str, Column], following: bool = False) -> Scan:
        """Values of the previous row of the group (or the following one), null at the end."""
        inputs = {f"_in_{o}": c for o, c in outputs.items()}
        given = self.df.withColumns(inputs)
        local = Window.partitionBy(*self.group, BLOCK).orderBy(*_orders(self.order, following))
        shifted = {o: F.lag(f"_in_{o}").over(local) for o in outputs}
        if self.blocks == 1:
            return replace(self, df=given.withColumns(shifted).drop(*inputs))
        scanned = given.withColumns({**shifted, "_edge": F.row_number().over(local) == 1})
        edge = F.min_by if following else F.max_by
        per_block = given.where(F.col(BLOCK) != UNCUT).groupBy(*self.group, BLOCK).agg(edge(F.struct(*inputs), F.struct(*self.order)).alias("_b"))
        # one row per block of a group
        across = Window.partitionBy(*self.group).orderBy(*_orders([BLOCK], following))
        carried = per_block.select(*self.group, BLOCK, F.lag("_b").over(across).alias("_p")).where(F.col("_p").isNotNull())
        joined = replace(self, df=scanned)._carry(carried)
        merged = joined.withColumns(
            {o: F.when(F.col("_edge"), F.col(f"_p._in_{o}")).otherwise(F.col(o)) for o in outputs})
        return replace(self, df=merged.drop("_p", "_edge", *inputs))

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK)


def scan(df: DataFrame, group: Sequence[str], order: Sequence[str], blocks: int | None = None) -> Scan:
    cut, n = with_blocks(df, group, order, blocks)
    return Scan(cut, tuple(group), tuple(order), n)


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str],
    outputs: dict[str, tuple[str, Column]], blocks: int | None = None,
) -> DataFrame:
    return scan(df, group, order, blocks).running(outputs).done()


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, blocks: int | None = None) -> DataFrame:
    return scan(df, group, order, blocks).number(name).done()


def neighbour(
    df: DataFrame, group: Sequence[str], order: Sequence[str], outputs: dict[str, Column],
    following: bool = False, blocks: int | None = None,
) -> DataFrame:
    return scan(df, group, order, blocks).neighbour(outputs, following).done()
