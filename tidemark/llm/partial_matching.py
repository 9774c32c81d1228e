"""Prediction by partial matching: code lengths of texts under a byte-context trie of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.batches import bound_batches
from tidemark.llm.words import mix, row_chunks, text_buffers, word_chunks
from tidemark.session import stored_copy

ORDER = 4
# Texts are dealt to blocks of so many bytes on average; a block's distinct byte runs and words meet the trie in joins.
BLOCK_BYTES = 16 << 20
WORD, RUN = 0, 1
_END = np.array([0x1D8E4E27C47D124F], np.uint64)


def _byte_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, codes, rows): every byte after its ORDER predecessors, as one number.

    A text begins after ORDER zero bytes and ends with one, which is predicted too.
    """
    data, offsets = text_buffers(column)
    for first, last in row_chunks(offsets):
        sizes = np.diff(offsets[first:last + 1])
        begins = np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
        padded = np.zeros(int((sizes + ORDER + 1).sum()), np.int64)
        rows = np.repeat(np.arange(last - first), sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded[begins[rows] + ORDER + place] = data[offsets[first]:offsets[last]]
        codes = np.zeros(max(0, len(padded) - ORDER), np.int64)
        for i in range(ORDER + 1):
            codes = (codes << 8) | padded[i:i + len(codes)]
        rows = np.repeat(np.arange(last - first), sizes + 1)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
        yield first, last, codes[begins[rows] + place], rows + first


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, tokens, rows): word hashes, and one end for each row."""
    for first, last, words, rows in word_chunks(column):
        ends = np.arange(first, last)
        yield first, last, np.r_[words, np.repeat(mix(_END), len(ends))].view(np.int64), np.r_[rows, ends]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _distinct(column: pa.Array, learns: np.ndarray, of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units of the texts with their counts in those that the model learns from."""
    parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for _, _, units, rows in of(column):
        taught = learns[rows]
        for own, counted in ((units[taught], True), (units[~taught], False)):
            keys, n = np.unique(own, return_counts=True)
            parts.append((keys, n if counted else np.zeros(len(keys), np.int64)))
            size += len(keys)
        if size > 2_000_000:
            parts = [_merge(parts)]
            size = 0
    return _merge(parts)


def _count_units(table: pa.Table) -> pa.Table:
    learns = table.column("learns").to_numpy()
    text = table.column("text").combine_chunks()
    made = []
    for kind, of in ((WORD, _tokens), (RUN, _byte_runs)):
        keys, n = _distinct(text, learns, of)
        block = pa.array(np.full(len(keys), table.column("block")[0].as_py()), pa.int64())
        made.append(pa.table({"block": block, "kind": pa.array(np.full(len(keys), kind), pa.int32()), "key": pa.array(keys), "n": pa.array(n)}))
    return pa.concat_tables(made)


def _score_block(texts: pa.Table, values: pa.Table) -> pa.Table:
    column = texts.column("text").combine_chunks()
    totals = {}
    for kind, of in ((WORD, _tokens), (RUN, _byte_runs)):
        own = values.filter(pa.array(values.column("kind").to_numpy() == kind)) if values.num_rows else values
        keys, value = own.column("key").to_numpy(), own.column("value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        total, known, n = (np.zeros(len(column)) for _ in range(3))
        for first, last, units, rows in of(column):
            got, rows, size = value[np.searchsorted(keys, units)], rows - first, last - first
            total[first:last] = np.bincount(rows, weights=got, minlength=size)
            known[first:last] = np.bincount(rows, weights=got > 0, minlength=size)
            n[first:last] = np.bincount(rows, minlength=size)
        totals[kind] = total, known, n
    words, runs = totals[WORD], totals[RUN]
    return pa.table({
        "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(words[2].astype(np.int64)),
        "n_known": pa.array(words[1].astype(np.int64)), "word_sum": pa.array(words[0]), "score": pa.array(runs[0])})


def _suffix(key: str, order: int) -> Column:
    """The byte with its nearest ``order`` predecessors."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def _context(column: Column) -> Column:
    return F.shiftright(column, 8)


def trie_codes(runs: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each byte after its ORDER predecessors, for runs (key long, n long).

    n counts the run in the training texts; n = 0 is a run that only other texts hold. Escapes have the
    weight of the distinct successors (method C), and what a longer context has seen is excluded from
    the shorter ones. A longer context's successors all follow the shorter one too, so the excluded set
    at each order is the next longer context's successors alone, and sums over it are taken per context.
    """
    grams = {ORDER: runs.where("n > 0")}
    for order in range(ORDER - 1, -1, -1):
        grams[order] = stored_copy(grams[order + 1].groupBy(_suffix("key", order).alias("key")).agg(F.sum("n").alias("n")), f"order{order}")
    contexts = {}
    for order in range(ORDER, -1, -1):
        own = grams[order].withColumn("context", _context(F.col("key")))
        if order:
            shorter = grams[order - 1].select(F.col("key").alias("short_key"), F.col("n").alias("short_n"))
            own = own.join(shorter, _suffix("key", order - 1) == F.col("short_key"))
        else:
            own = own.withColumn("short_n", F.lit(0))
        contexts[order] = own.groupBy("context").agg(F.sum("n").alias(f"t{order}"), F.count("*").alias(f"d{order}"), F.sum("short_n").alias(f"e{order}"))
    for order in range(ORDER, 0, -1):  # weights at the shorter context after an escape from this one
        parent = contexts[order - 1].select(F.col("context").alias("parent"), f"t{order - 1}", f"d{order - 1}")
        above = F.col("context").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
        left = F.col(f"d{order - 1}") - F.col(f"d{order}")
        contexts[order] = stored_copy(contexts[order].join(parent, above == F.col("parent")).select(
            "context", f"t{order}", f"d{order}", left.alias(f"x{order}"), (F.col(f"t{order - 1}") - F.col(f"e{order}") + left).alias(f"a{order}")),
            f"contexts{order}")

    seen = runs.where("n > 0").join(contexts[ORDER].withColumnRenamed("context", "c"), _context(F.col("key")) == F.col("c")).select(
        "key", F.log10(F.col("n") / (F.col(f"t{ORDER}") + F.col(f"d{ORDER}"))).alias("value"))
    new = runs.where("n = 0").select("key")
    for order in range(ORDER, 0, -1):
        table = contexts[order].withColumnRenamed("context", f"c{order}")
        new = new.join(table, _context(_suffix("key", order)) == F.col(f"c{order}"), "left").drop(f"c{order}")
        if order < ORDER:
            new = new.join(grams[order].select(F.col("key").alias(f"k{order}"), F.col("n").alias(f"n{order}")),
                           _suffix("key", order) == F.col(f"k{order}"), "left").drop(f"k{order}")
    root = contexts[0].select("t0", "d0")
    new = new.join(grams[0].select(F.col("key").alias("k0"), F.col("n").alias("n0")), _suffix("key", 0) == F.col("k0"), "left").drop("k0")
    new = new.withColumn("t0", F.lit(root.select("t0").scalar())).withColumn("d0", F.lit(root.select("d0").scalar()))

    def step(order: int) -> Column:
        """log10 probability from this order downward, entered without exclusions."""
        below = entered(order - 1)
        found = F.log10(F.col(f"n{order}") / (F.col(f"t{order}") + F.col(f"d{order}"))) if order < ORDER else F.lit(None).cast("double")
        escape = F.log10(F.col(f"d{order}") / (F.col(f"t{order}") + F.col(f"d{order}"))) + below
        onward = step(order - 1) if order else F.lit(-np.log10(256.0))
        return F.when(F.col(f"d{order}").isNull(), onward).otherwise(F.coalesce(found, escape))

    def entered(order: int) -> Column:
        """The same after an escape from the next longer context, whose successors are excluded."""
        if order < 0:
            return -F.log10(F.lit(256.0) - F.col("d0"))
        a, x = F.col(f"a{order + 1}"), F.col(f"x{order + 1}")
        escape = F.when(a > 0, F.log10(x / a)).otherwise(F.lit(0.0)) + entered(order - 1)
        return F.coalesce(F.log10(F.col(f"n{order}") / a), escape)

    return seen.unionByName(new.select("key", step(ORDER).alias("value")))


def score_texts(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    ``learns`` tells the rows that the model is pretrained on; held_out is its opposite. score is the
    log10 probability of all bytes of the text and its end; base_score that of its words and end under
    add-one counts of the training words. A null text is an empty one and a null id stays null; rows that
    repeat are scored alike, and other columns are ignored. With nothing to learn from every byte
    has probability 1/256. An empty table gives no rows.

    The trie is a table of byte runs with counts, grown with the corpus and never whole in one place:
    each block of texts asks it, in joins, for the runs it holds.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         F.coalesce(learns, F.lit(False)).alias("learns"))
    bound_batches(docs.sparkSession)
    size = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    source = source.withColumn("held_out", ~F.col("learns")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(blocks)))
    counted = source.select("block", "learns", "text").groupBy("block").applyInArrow(_count_units, "block long, kind int, key long, n long")
    units = stored_copy(counted, "units")
    words = units.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n"))
    n, v = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    runs = stored_copy(units.where(F.col("kind") == RUN).groupBy("key").agg(F.sum("n").alias("n")), "runs")
    values = words.select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value")).unionByName(
        trie_codes(runs).select(F.lit(RUN).alias("kind"), "key", "value"))
    asked = units.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    scored = source.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _score_block, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, word_sum double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         (F.col("word_sum") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score")
