"""Benchmark items in training texts: block-max WAND over a BM25 index, then checked overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.batches import bound_batches
from tidemark.llm.words import mix, row_starts, shingle_hashes, word_chunks
from tidemark.session import stored_copy

K1, B = 1.2, 0.75
# Share of an item's own score that a passage must reach, and of the shingles of question and answer it must hold.
SCORE, OVERLAP = 0.6, 0.5
SHINGLE = 5
BLOCK, GROUPS = 32, 64
# Half a passage holds any item of its part; longer items have parts with a step of twice, four times ... as many words.
PASSAGE_STEP = 64
# An index part holds so many postings on average; a task takes one part after the other over the same texts.
PART_POSTINGS = 500_000
_SLACK = 1e-9


@dataclass
class Part:
    """Inverted index of some items: for each term its postings (item, impact) in order of items, with
    the last item and the largest impact of each BLOCK of them, and the largest of all. Items are also
    dealt in order to GROUPS groups of ``width`` items; a term has its largest impact for each of its groups."""

    terms: np.ndarray
    starts: list[int]
    items: list[int]
    impacts: list[float]
    block_starts: list[int]
    last_items: list[int]
    maxima: list[float]
    term_maxima: np.ndarray
    width: int
    group_starts: np.ndarray
    groups: np.ndarray
    group_maxima: np.ndarray
    keys: np.ndarray
    sizes: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    step: int


def question_and_answer(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last third of an item's words is its answer, the rest its question; each has SHINGLE words
    at least, and an item with fewer words is both as a whole."""
    third = len(words) // 3
    return words[:max(SHINGLE, len(words) - third)], words[-max(SHINGLE, third):]


def _key(words: np.ndarray) -> int:
    """A number for a sequence of words."""
    spread = mix(words ^ mix(np.arange(len(words), dtype=np.uint64)))
    return int(np.add.reduce(spread, initial=np.uint64(len(words)), keepdims=True).view(np.int64)[0])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item a key of its words, its distinct words with counts, its length and the shingles of its two parts."""
    for batch in batches:
        of = [np.zeros(0, np.uint64)] * batch.num_rows
        for first, last, words, rows in word_chunks(batch.column(1)):
            at = row_starts(rows, first, last)
            for i in range(last - first):
                of[first + i] = words[at[i]:at[i + 1]]
        split = [question_and_answer(w) for w in of]
        counted = [np.unique(w, return_counts=True) for w in of]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([_key(w) for w in of], pa.int64()), pa.array([len(w) for w in of], pa.int32()),
            pa.array([t.view(np.int64) for t, _ in counted], pa.list_(pa.int64())), pa.array([n for _, n in counted], pa.list_(pa.int64())),
            *[pa.array([shingle_hashes(w[i], SHINGLE).view(np.int64) for w in split], pa.list_(pa.int64())) for i in (0, 1)],
        ], ["item_id", "key", "length", "terms", "counts", "question", "answer"])


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The items' words, stored. Rows without an id or without words are left out: nothing can repeat them."""
    words = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    return stored_copy(words.mapInArrow(_item_words, "item_id long, key long, length int, terms array<long>, counts array<long>, "
                                        "question array<long>, answer array<long>").where("length > 0"), "items")


def build_index(table: DataFrame) -> Iterator[Part]:
    """Parts of the index over the distinct texts of an item table, each of about PART_POSTINGS postings.

    Impacts are BM25 weights as shares of the text's own score, with counts over all distinct texts, so
    items that repeat change nothing. A part holds texts of like length: its step is PASSAGE_STEP, doubled
    until the texts fit.
    """
    texts = stored_copy(table.drop("item_id").dropDuplicates(["key"]), "texts")
    n, mean = texts.agg(F.count("*"), F.avg("length")).first()
    if not n:
        return
    texts = texts.withColumn("doubled", F.greatest(F.lit(0), F.ceil(F.log2(F.col("length") / PASSAGE_STEP))).cast("int"))
    frequency = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("pair.counts")
    weighted = (texts.select("key", "length", F.explode(F.arrays_zip("terms", "counts")).alias("pair"))
                .select("key", F.col("pair.terms").alias("term"), (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))).alias("w"))
                .join(frequency, "term").select("key", "term", (F.col("w") * idf).alias("w")))
    own = weighted.groupBy("key").agg(F.sum("w").alias("own"))
    impacts = stored_copy(weighted.join(own, "key").select("key", "term", (F.col("w") / F.col("own")).alias("impact")), "impacts")
    for group in texts.groupBy("doubled").agg(F.sum(F.size("terms")).alias("postings")).orderBy("doubled").collect():
        parts = -(-group.postings // PART_POSTINGS)
        for number in range(parts):
            own_texts = texts.where((F.col("doubled") == group.doubled) & (F.pmod(F.xxhash64("key"), F.lit(parts)) == number))
            chosen = own_texts.orderBy("key").select("key", "length", "question", "answer").collect()
            if chosen:
                yield _part(chosen, impacts.join(own_texts.select("key"), "key").toArrow(), PASSAGE_STEP << group.doubled)


def _part(chosen: list, table: pa.Table, step: int) -> Part:
    keys = np.array([r.key for r in chosen], np.int64)
    item = np.searchsorted(keys, table.column("key").to_numpy())
    term, impact = table.column("term").to_numpy().view(np.uint64), table.column("impact").to_numpy()
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], impact[order]
    terms, starts = np.unique(term, return_index=True)
    starts = np.r_[starts, len(term)]
    blocks = -(-np.diff(starts) // BLOCK)
    block_starts = np.r_[0, np.cumsum(blocks)]
    heads = np.repeat(starts[:-1], blocks) + BLOCK * (np.arange(block_starts[-1]) - np.repeat(block_starts[:-1], blocks))
    ends = np.minimum(heads + BLOCK, np.repeat(starts[1:], blocks))
    width = -(-len(keys) // GROUPS)
    of_term, group = np.repeat(np.arange(len(terms)), np.diff(starts)), item // width
    begins = np.flatnonzero(np.r_[True, (of_term[1:] != of_term[:-1]) | (group[1:] != group[:-1])])
    return Part(terms, starts.tolist(), item.tolist(), impact.tolist(), block_starts.tolist(), item[ends - 1].tolist(),
                np.maximum.reduceat(impact, heads).tolist(), np.maximum.reduceat(impact, starts[:-1]),
                width, np.searchsorted(of_term[begins], np.arange(len(terms) + 1)), group[begins], np.maximum.reduceat(impact, begins), keys,
                [min(SHINGLE, r.length) for r in chosen], [np.array(r.question, np.int64).view(np.uint64) for r in chosen],
                [np.array(r.answer, np.int64).view(np.uint64) for r in chosen], step)


def block_max_wand(part: Part, terms: list[int], score: float, next_open: list[int] | None = None) -> list[tuple[int, float]]:
    """(item, total) of all items whose impacts on the terms (places in part.terms) add up to ``score``.

    next_open: for each group itself, or the next one that may hold such an item; others are jumped over.

    Cursors, one for each term, are kept in order of their items. The pivot is the first item that the
    largest impacts of the terms up to it could lift to the score; if the maxima of the blocks that hold
    it can't, all cursors move behind the first of these blocks. Else the cursors before it catch up, and
    once all are there its impacts are added up.
    """
    bar, found = score - _SLACK, []
    items, impacts, last_items, maxima = part.items, part.impacts, part.last_items, part.maxima
    # Item at the cursor, its place, the end of the postings; the block it has come to, the end of the blocks; the largest impact.
    cursors = [[items[part.starts[t]], part.starts[t], part.starts[t + 1], part.block_starts[t], part.block_starts[t + 1], float(part.term_maxima[t])]
               for t in terms]
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, 0
        for pivot, cursor in enumerate(cursors):
            bound += cursor[5]
            if bound >= bar:
                break
        if bound < bar:
            break
        item = cursors[pivot][0]
        if next_open is not None and next_open[item // part.width] != item // part.width:
            target = next_open[item // part.width] * part.width
            for cursor in cursors:
                if cursor[0] < target:
                    cursor[1] = bisect_left(items, target, cursor[1], cursor[2])
                    cursor[0] = items[cursor[1]] if cursor[1] < cursor[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
            continue
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, target = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(part.keys)
        for cursor in cursors[:pivot + 1]:
            while cursor[3] < cursor[4] and last_items[cursor[3]] < item:
                cursor[3] += 1
            if cursor[3] < cursor[4]:
                bound += maxima[cursor[3]]
                target = min(target, last_items[cursor[3]] + 1)
        if bound >= bar:
            target = item
            if cursors[0][0] == item:
                target = item + 1
                total = sum(impacts[c[1]] for c in cursors[:pivot + 1])
                if total >= bar:
                    found.append((item, total))
        for cursor in cursors[:pivot + 1]:
            if cursor[0] < target:
                cursor[1] = bisect_left(items, target, cursor[1], cursor[2])
                cursor[0] = items[cursor[1]] if cursor[1] < cursor[2] else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _expand(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions starts[w] .. starts[w + 1] for every w, and the entry each one comes from."""
    count = starts[which + 1] - starts[which]
    entry = np.repeat(np.arange(len(which)), count)
    return starts[which][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count), entry


def _retrieve(part: Part, words: np.ndarray, rows: np.ndarray, at: np.ndarray, first: int, score: float) -> tuple[np.ndarray, list]:
    """(first passage of each row, (passage, item, score) of every passage and item that reach the score).

    The largest impacts of a passage's terms are added up for each group of items first; only passages
    with a group that may reach the score are searched, and in them only such groups.
    """
    step, place = part.step, np.arange(len(words)) - at[rows - first]
    passages = np.maximum(1, -(-np.diff(at) // step))
    base = np.cumsum(passages) - passages
    own = base[rows - first] + place // step
    term = np.searchsorted(part.terms, words)
    term[term == len(part.terms)] = 0
    known = part.terms[term] == words
    earlier = known & (place >= step)
    pairs = np.unique(np.r_[own[known] * len(part.terms) + term[known], (own[earlier] - 1) * len(part.terms) + term[earlier]])
    passage, term = pairs // len(part.terms), pairs % len(part.terms)
    spots, entry = _expand(part.group_starts, term)
    bound = np.bincount(passage[entry] * GROUPS + part.groups[spots], weights=part.group_maxima[spots], minlength=int(passages.sum()) * GROUPS)
    open_ = (bound >= score - _SLACK).reshape(-1, GROUPS)
    found = []
    for number in np.flatnonzero(open_.any(1)).tolist():
        low, high = np.searchsorted(passage, [number, number + 1])
        places = np.where(open_[number], np.arange(GROUPS), GROUPS)
        following = np.minimum.accumulate(places[::-1])[::-1].tolist()
        found += [(number, item, total) for item, total in block_max_wand(part, term[low:high].tolist(), score, following)]
    return base, found


def _share(part: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(part, held).mean()) if len(part) else 1.0


_HIT = {"doc_id": pa.int64(), "key": pa.int64(), "start_word": pa.int64(), "score": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
FOUND = "doc_id long, key long, start_word long, score double, question_overlap double, answer_overlap double"


def _search(batches: Iterator[pa.RecordBatch], parts: list, score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, words, rows in word_chunks(batch.column(1)):
            at, out = row_starts(rows, first, last), []
            for shared in parts:
                part: Part = shared.value
                base, found = _retrieve(part, words, rows, at, first, score)
                held: dict[tuple[int, int], np.ndarray] = {}
                for passage, item, total in found:
                    row = int(np.searchsorted(base, passage, side="right")) - 1
                    low = int(at[row] + (passage - base[row]) * part.step)
                    of = (passage, part.sizes[item])
                    if of not in held:
                        window = words[low:min(int(at[row + 1]), low + 2 * part.step)]
                        held = {k: v for k, v in held.items() if k[0] == passage} | {of: shingle_hashes(window, of[1])}
                    out.append((ids[first + row].as_py(), int(part.keys[item]), low - int(at[row]), total,
                                _share(part.questions[item], held[of]), _share(part.answers[item], held[of])))
            columns = list(zip(*out)) if out else [[]] * len(_HIT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _HIT.values())], list(_HIT))


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, start_word, score, question_overlap, answer_overlap, contaminated) of each document
    and item whose passage reaches ``score`` of the item's own BM25 score; the best passage counts.

    Passages are half overlapping stretches that hold any copy of an item whole (128 words; more for
    longer items only). All parts of the index are searched in one pass over the documents.
    contaminated: the passage holds OVERLAP of the shingles of question and answer each; an item of fewer
    than SHINGLE words is one shingle, which the passage must hold. Items are searched by their distinct
    texts, so repeated items are found as often as single ones, and different texts under one id are
    searched apart (the better one counts). Items without id, or whose text is null, empty or blank, are
    never found. Null and empty documents and rows with a null id give nothing; rows that repeat an id
    count as one document; other columns are ignored; no items or no rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    table = item_table(items)
    parts = [spark.sparkContext.broadcast(part) for part in build_index(table)]
    found = source.mapInArrow(lambda batches: _search(batches, parts, score), FOUND) if parts else spark.createDataFrame([], FOUND)
    quality = F.struct((F.col("question_overlap") + F.col("answer_overlap")).alias("overlap"), "score", (-F.col("start_word")).alias("place"),
                       "start_word", "question_overlap", "answer_overlap")
    best = found.groupBy("doc_id", "key").agg(F.max(quality).alias("best"))
    best = best.join(table.select("key", "item_id").distinct(), "key").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", "best.start_word", "best.score", "best.question_overlap", "best.answer_overlap").withColumn(
        "contaminated", (F.col("question_overlap") >= OVERLAP) & (F.col("answer_overlap") >= OVERLAP))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that hold no benchmark item; columns pass through. Rows with a null id stay."""
    bad = benchmark_hits(docs, items, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(stored_copy(bad, "leaks"), docs[id_col] == F.col("_leak"), "left_anti")
