"""Set comparisons of catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def catalog_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one listing has, with the side; empty when the listings are equal. Counts per
    distinct row are combined before the shuffle, and a row listed more often on one side comes
    out once per surplus copy."""
    columns = a.columns
    sides = a.withColumn("_d", F.lit(1)).unionByName(b.select(*columns).withColumn("_d", F.lit(-1)))
    surplus = sides.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    copies = F.array_repeat(F.when(F.col("_d") > 0, "only_a").otherwise("only_b"), F.abs("_d").cast("int"))
    return surplus.select(*columns, F.explode(copies).alias("side"))


def survivors(before: DataFrame, after: DataFrame, on: str = "name") -> DataFrame:
    """Names listed before and gone after; empty when everything survived."""
    return before.select(on).distinct().join(after.select(on), on, "left_anti")
