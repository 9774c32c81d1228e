"""Repeated runs of lines, found with a suffix array over line ids built by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.batches import bound_batches
from tidemark.llm.near_dedup import _whole_groups
from tidemark.llm.words import row_chunks, span_hashes, spans, text_buffers
from tidemark.session import stored_copy

MIN_WORDS = 50
_DOC = ["doc_id", "text_key"]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that has words: its place among these, its place among all lines, its id and words."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        for first, last in row_chunks(offsets):
            low = offsets[first]
            piece, bounds = data[low:offsets[last]], offsets[first:last + 1] - low
            starts, ends = spans(piece, bounds)
            if not len(starts):
                continue
            breaks = np.flatnonzero(piece == 10)
            line = np.searchsorted(breaks, starts)
            row = np.searchsorted(bounds, starts, side="right") - 1
            begins = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
            finish = np.r_[begins[1:], len(starts)]
            row, line = row[begins], line[begins] - np.searchsorted(breaks, bounds[row[begins]])
            place = np.arange(len(row)) - np.searchsorted(row, row)
            part = batch.slice(first, last - first).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(place, pa.int32()), pa.array(line, pa.int32()),
                 pa.array(span_hashes(piece, starts[begins], ends[finish - 1], fold=False).view(np.int64)),
                 pa.array(finish - begins, pa.int32())], [*_DOC, "idx", "pos", "line", "words"])


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated lines with enough words; for each line the number of lines that have
    enough words from it onward and up to it, or 0."""
    for table in _whole_groups(batches):
        doc, key, idx, words = (table.column(c).to_numpy() for c in ("doc_id", "text_key", "idx", "words"))
        cut = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (idx[1:] != idx[:-1] + 1)]
        begins = np.flatnonzero(cut)
        of = np.cumsum(cut) - 1
        last = np.r_[begins[1:], len(idx)][of]
        after = np.cumsum(words, dtype=np.int64)
        before = after - words
        end = np.searchsorted(after, before + least)
        start = np.searchsorted(before, after - least, side="right") - 1
        rows = np.arange(len(idx))
        onward = np.where(end < last, end - rows + 1, 0)
        upto = np.where(start >= begins[of], rows - start + 1, 0)
        enough = np.bincount(of, weights=words)[of] >= least
        out = table.select([*_DOC, "idx", "pos", "line"]).append_column("stretch", pa.array(idx[begins][of], pa.int32()))
        out = out.append_column("onward", pa.array(onward, pa.int32())).append_column("upto", pa.array(upto, pa.int32()))
        yield from out.filter(pa.array(enough)).combine_chunks().to_batches()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, removed array of line numbers) of the documents that hold later copies.

    docs: doc_id, text_key (identity of the text), text. Lines that occur once end a stretch and drop
    out. Suffixes of the stretches are ranked by 1, 2, 4 ... lines: each round ranks the pairs of ranks
    in one range-sorted table, so ranks order the suffixes as a suffix array does, and suffixes of equal
    rank form the interval whose common prefix has that many lines. Any run of lines is named by the
    ranks of its first and last 2^k lines. Of each interval of runs with ``min_words`` words, all but
    the first in order of (doc_id, text_key, line) are removed, where they don't overlap the first.
    Shortest runs from each line onward and up to each line together cover every longer run.
    """
    lines = stored_copy(docs.mapInArrow(_lines, "doc_id long, text_key long, idx int, pos int, line long, words int"), "lines")
    # Stored, and rows that repeat fall together only after the next shuffle: so the join may split a very common line.
    again = stored_copy(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "again")
    windowed = (lines.join(again, "line").select(*_DOC, "idx", "pos", "line", "words")
                .repartition(*_DOC).dropDuplicates().sortWithinPartitions(*_DOC, "idx")
                .mapInArrow(lambda batches: _windows(batches, min_words), "doc_id long, text_key long, idx int, pos int, line long, "
                            "stretch int, onward int, upto int"))
    suffixes = stored_copy(windowed.withColumnRenamed("line", "rank0"), "suffixes")
    longest = suffixes.agg(F.max(F.greatest("onward", "upto"))).first()[0] or 0
    level = 0
    while 2 << level <= longest:
        of_pair, name = [f"rank{level}", "next"], f"rank{level + 1}"
        following = F.lead(of_pair[0], 1 << level).over(Window.partitionBy(*_DOC, "stretch").orderBy("idx"))
        paired = suffixes.withColumn("next", following)
        ranked = (paired.select(*of_pair).distinct().repartitionByRange(*of_pair).sortWithinPartitions(*of_pair)
                  .withColumn(name, F.monotonically_increasing_id()))
        ranked = stored_copy(ranked, "ranks").select(F.col(of_pair[0]).alias("a"), F.col("next").alias("b"), name)
        suffixes = stored_copy(paired.join(ranked, (F.col(of_pair[0]) == F.col("a")) & F.col("next").eqNullSafe(F.col("b")))
                               .drop("a", "b", "next"), "suffixes")
        level += 1

    runs = (suffixes.where("onward > 0").select(*_DOC, F.col("idx").alias("start"), F.col("onward").alias("lines"))
            .unionByName(suffixes.where("upto > 0").select(*_DOC, (F.col("idx") - F.col("upto") + 1).alias("start"),
                                                            F.col("upto").alias("lines"))).distinct())
    runs = runs.withColumn("level", F.length(F.bin("lines")) - 1)
    ranks = suffixes.select(*_DOC, "idx", F.array(*[f"rank{i}" for i in range(level + 1)]).alias("ranks"))
    tail = (F.col("start") + F.col("lines") - F.expr("shiftleft(1, level)")).alias("idx")
    runs = runs.join(ranks.withColumnRenamed("idx", "start"), [*_DOC, "start"]).select(
        *_DOC, "start", "lines", "level", F.col("ranks")[F.col("level")].alias("head"), tail)
    runs = runs.join(ranks, [*_DOC, "idx"]).select(*_DOC, "start", "lines", "head", F.col("ranks")[F.col("level")].alias("tail"))
    runs = stored_copy(runs, "runs")
    firsts = runs.groupBy("lines", "head", "tail").agg(
        F.min(F.struct(*_DOC, "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    elsewhere = ((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.text_key") != F.col("text_key"))
                 | (F.col("start") >= F.col("first.start") + F.col("lines")))
    later = runs.join(firsts, ["lines", "head", "tail"]).where(elsewhere)
    gone = later.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("idx")).distinct()
    return (gone.join(suffixes.select(*_DOC, "idx", "pos"), [*_DOC, "idx"])
            .groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("removed")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                        removed_col: str = "removed_lines") -> DataFrame:
    """The rows with later copies of line runs cut out of their text, and the line numbers removed.

    Compared are lines without the white space around them; blank lines separate nothing and stay.
    Rows with a null id or text, and texts without words, are unchanged (removed_lines is empty). Equal
    rows count as one document and are cut alike. Other columns pass through, whatever their names, but
    for one called like ``removed_col``, which is replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    key = F.xxhash64(F.col(text_col))
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    removed = repeated_lines(source, min_words).select(
        F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("removed").alias("_cut_lines"))
    joined = docs.drop(removed_col).join(removed, (docs[id_col] == F.col("_cut_id")) & (key == F.col("_cut_key")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut_lines"))
    text = F.when(F.col("_cut_lines").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return (joined.withColumn(text_col, text)
            .withColumn(removed_col, F.coalesce("_cut_lines", F.array().cast("array<int>")))
            .drop("_cut_id", "_cut_key", "_cut_lines"))
