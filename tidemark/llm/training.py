"""What the two classifiers share: bounded labelled samples, byte statistics, columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.batches import bound_batches

# Classes of bytes whose shares describe a text; bytes of letters beyond ASCII are class 1.
_CLASSES = ("other", "beyond", "upper", "lower", "digit", "space", "newline", "stop", "exclaim", "question", "comma", "symbol", "pipe", "bracket")
_CLASS_OF = np.zeros(256, np.int64)
for _name, _bytes in (
        ("beyond", range(128, 256)), ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"),
        ("newline", b"\n"), ("stop", b".:;"), ("exclaim", b"!"), ("question", b"?"), ("comma", b","), ("symbol", b"#$%&*@^~+=_<>/\\"),
        ("pipe", b"|"), ("bracket", b"()[]{}")):
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)


def byte_shares(data: np.ndarray) -> np.ndarray:
    """Shares of the classes of bytes in one text."""
    return np.bincount(_CLASS_OF[data], minlength=len(_CLASSES)) / max(1, len(data))


def byte_class(name: str) -> int:
    return _CLASSES.index(name)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows outside the held-out fold, by order of a hash of the id.

    docs: doc_id, text. The bound on the labels makes them small enough to broadcast, so texts aren't shuffled.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(
        F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"), folds, fold))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    return docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())


def with_column(docs: DataFrame, text_col: str, name: str, kind: T.DataType,
                of: Callable[[pa.Array], Iterator[pa.Array]]) -> DataFrame:
    """The rows with one more column, which ``of`` gives for a text column in consecutive pieces."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for made in of(batch.column(at)):
                part = batch.slice(first, len(made))
                first += len(made)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the rows don't use yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
