"""Joining two tables on the similarity of their texts' trigram sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.extras import trigrams
from tidemark.session import stored_copy

# Sizes and shares are compared with this much tolerance: 0.3 * 10 must not round up to 4.
_EPSILON = 1e-9
# Texts of a side that meet under a trigram in one group at most; more are dealt in blocks.
TEXTS_AT_ONCE = 1024
# Entries of a matrix of texts by trigrams in a task.
ENTRIES_AT_ONCE = 1 << 22


def _at_least(value: Column) -> Column:
    return F.ceil(value - _EPSILON).cast("int")


def _code(gram: Column) -> Column:
    """A trigram as one number: its three code points, 21 bits each."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("bigint")
    return at(1) * F.lit(1 << 42) + at(2) * F.lit(1 << 21) + at(3)


def _ranked_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """``(text, side, grams, prefix)``: grams from the rarest to the commonest of both sides, ``prefix``
    as many of the first as two similar sets can't all miss. The order is the same for every text."""
    spread = sets.select("text", "side", F.explode("grams").alias("gram"))
    counts = spread.groupBy("gram").agg(F.count("*").alias("n"))
    # as many entries as the text has trigrams
    ordered = spread.join(counts, "gram").groupBy("text", "side").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    size = F.size("grams")
    return ordered.select("text", "side", F.transform("grams", lambda g: g["gram"]).alias("grams"),
                          (size - _at_least(size * F.lit(threshold)) + 1).alias("prefix"))


def similar_texts(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs ``(left_text, right_text, similarity)`` of the distinct texts of two one-column tables whose
    trigram sets share at least ``threshold`` of the trigrams of both.

    Two such sets share one of the rarest trigrams of each (their prefixes, taken in one order of
    rarity), so texts meet only under a shared prefix trigram. A trigram of many texts is dealt in blocks
    of bounded size. The whole sets of the two blocks that meet are counted as a product of matrices, and
    only similar pairs leave the task, each from the rarest trigram they share. Texts that are null or
    hold no trigram match nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def side(df: DataFrame, name: str) -> DataFrame:
        texts = df.select(F.col(df.columns[0]).cast("string").alias("text")).where("text is not null").distinct()
        return texts.select("text", F.lit(name).alias("side"), trigrams(F.col("text")).alias("grams")).where(F.size("grams") > 0)

    sets = stored_copy(_ranked_sets(side(left, "l").unionByName(side(right, "r")), threshold), "sets")
    posted = sets.select("text", "side", F.transform("grams", _code).alias("codes"), F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("place", "gram"))
    posted = posted.withColumn("gram", _code(F.col("gram")))
    found = posted.groupBy("gram").agg(F.count_if(F.col("side") == "l").alias("n_l"), F.count_if(F.col("side") == "r").alias("n_r"))
    blocks = found.where("n_l > 0 AND n_r > 0").select("gram", *[F.ceil(F.col(n) / TEXTS_AT_ONCE).alias(n) for n in ("n_l", "n_r")])

    def dealt(name: str) -> DataFrame:
        """The posted rows of a side in blocks, each copied for every block of the other side."""
        own, other = ("l", "r") if name == "l" else ("r", "l")
        rows = posted.where(F.col("side") == name).join(blocks, "gram").withColumn(own, F.pmod(F.xxhash64("text"), F.col(f"n_{own}")))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1)))
        # new columns, as both sides come from the same rows
        return rows.select(*[F.col(c).alias(c) for c in ("gram", "l", "r", "text", "codes", "place")]).repartition(parts, "gram", "l", "r")

    # a number that holds: these rows are few bytes and much work
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (dealt(name).groupBy("gram", "l", "r") for name in ("l", "r"))
    return a.cogroup(b).applyInArrow(_meet(float(threshold)), "left_text string, right_text string, similarity double")


def _meet(threshold: float):
    """Similar pairs of two blocks of texts that have a trigram in their prefixes. A pair that shares a
    rarer one as well is left to that: both sets are in one order, so it stands before this one in both."""
    schema = pa.schema([("left_text", pa.string()), ("right_text", pa.string()), ("similarity", pa.float64())])

    def entries(rows: pa.Table, vocabulary: np.ndarray):
        """Text number, column and whether it stands before the shared trigram, of each entry in the vocabulary."""
        codes = rows["codes"].combine_chunks()
        sizes = np.diff(codes.offsets.to_numpy())
        values, text = codes.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        early = at < rows["place"].to_numpy()[text]
        column = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        known = vocabulary[column] == values
        return sizes, text[known], column[known], early[known]

    def matrices(side, low: int, high: int, width: int):
        _, text, column, early = side
        first, last = np.searchsorted(text, [low, high])
        whole, before = (np.zeros((high - low, width), dtype=np.float32) for _ in range(2))
        whole[text[first:last] - low, column[first:last]] = 1
        before[text[first:last] - low, column[first:last]] = early[first:last]
        return whole, before

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        vocabulary = np.intersect1d(*(x["codes"].combine_chunks().flatten().to_numpy() for x in (left, right)))
        a, b = entries(left, vocabulary), entries(right, vocabulary)
        step, found = max(1, min(TEXTS_AT_ONCE, ENTRIES_AT_ONCE // len(vocabulary))), []
        for i in range(0, left.num_rows, step):
            whole_a, before_a = matrices(a, i, min(i + step, left.num_rows), len(vocabulary))
            for j in range(0, right.num_rows, step):
                whole_b, before_b = matrices(b, j, min(j + step, right.num_rows), len(vocabulary))
                shared = (whole_a @ whole_b.T).astype(np.float64)
                similarity = shared / (a[0][i:i + step, None] + b[0][None, j:j + step] - shared)
                x, y = np.nonzero((similarity >= threshold - _EPSILON) & (before_a @ before_b.T == 0))
                found.append((x + i, y + j, similarity[x, y]))
        x, y, score = (np.concatenate(c) for c in zip(*found))
        return pa.table([left["text"].take(pa.array(x)), right["text"].take(pa.array(y)), pa.array(score)], schema=schema)

    return meet


def trigram_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float = 0.3) -> DataFrame:
    """Rows of both tables whose texts are similar, with ``similarity``. Texts are compared once however
    often they occur; the columns of the two tables must have different names."""
    taken = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if taken:
        raise ValueError(f"columns of both tables: {sorted(taken)}")
    pairs = stored_copy(similar_texts(left.select(left_on), right.select(right_on), threshold), "pairs")
    pairs = pairs.select(F.col("left_text").alias("_left_text"), F.col("right_text").alias("_right_text"), "similarity")
    joined = left.join(pairs, F.col(left_on).cast("string") == F.col("_left_text"))
    return joined.join(right, F.col(right_on).cast("string") == F.col("_right_text")).select(*left.columns, *right.columns, "similarity")
