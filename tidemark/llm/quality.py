"""Quality of texts: a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.training import byte_shares, labelled_sample, with_column
from tidemark.llm.words import row_starts, text_buffers, word_chunks
from tidemark.session import stored_copy

SAMPLE = 10_000
HASHED = 1 << 12
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-5
# A small sample is gone through more often, until so many batches have been seen.
LEAST_STEPS = 800
_STATISTICS = 21


def word_part(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with square roots of their counts, scaled to length 1."""
    index, counts = np.unique((words % np.uint64(HASHED)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts)
    return index, values / max(1.0, float(np.sqrt((values ** 2).sum())))


def statistics(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares of classes of bytes, and figures of words and lines."""
    n = max(1, len(words))
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1, np.int64)
    lines = 1 + int((data == 10).sum())
    return np.r_[byte_shares(data), np.log1p(len(words)), np.log1p(len(data)), len(data) / n, len(counts) / n, counts.max() / n,
                 np.log1p(len(words) / lines), np.log1p(lines)]


@dataclass
class QualityModel:
    """Weights of the machine, and mean and spread of the statistics; only a constant where labels are too few."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    constant: float | None = None

    def score(self, data: np.ndarray, words: np.ndarray) -> float:
        """Linear time: the pairwise part is half of the squares of sums less the sums of squares."""
        index, values = self.inputs(data, words)
        rows = self.factors[index] * values[:, None]
        margin = self.intercept + values @ self.linear[index] + 0.5 * ((rows.sum(0) ** 2) - (rows ** 2).sum(0)).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))

    def inputs(self, data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, values = word_part(words)
        scaled = np.clip((statistics(data, words) - self.mean) / self.spread, -4, 4) / 2
        return np.r_[index, HASHED + np.arange(_STATISTICS)], np.r_[values, scaled]


def _pieces(of, kind: pa.DataType):
    """A column made from each text's bytes and word hashes."""
    def run(column: pa.Array) -> Iterator[pa.Array]:
        data, offsets = text_buffers(column)
        for first, last, words, rows in word_chunks(column):
            at = row_starts(rows, first, last)
            yield pa.array([of(data[offsets[first + i]:offsets[first + i + 1]], words[at[i]:at[i + 1]]) for i in range(last - first)], kind)
    return run


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1,
                  bound: int = SAMPLE) -> QualityModel:
    """docs: doc_id, text. Learns from at most ``bound`` labelled rows outside the held-out fold."""
    sample = stored_copy(labelled_sample(docs, labels, label, folds, fold, bound), "sample")
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    none = np.zeros(0)
    if min(ones, n - ones) < 5:
        return QualityModel(0.0, none, none, none, none, ones / n if n else 0.5)
    measured = with_column(sample.select("text"), "text", "s", T.ArrayType(T.DoubleType()), _pieces(statistics, pa.list_(pa.float64())))
    moments = measured.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    mean, spread = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])
    blank = QualityModel(0.0, none, none, mean, spread)
    kind = pa.struct([("i", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))])
    seen = with_column(sample.select("label", "text"), "text", "x", T.StructType([
        T.StructField("i", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))]),
        _pieces(lambda data, words: dict(zip("iv", blank.inputs(data, words))), kind))
    inputs = seen.select("label", "x.i", "x.v").toArrow()  # at most ``bound`` rows of sparse numbers
    intercept, linear, factors = _fit(inputs)
    return QualityModel(intercept, linear, factors, mean, spread)


def _fit(inputs: pa.Table) -> tuple[float, np.ndarray, np.ndarray]:
    """Minimise the logistic loss by Adam on shuffled batches of the sample."""
    label = inputs.column("label").to_numpy()
    lists = inputs.column("i").combine_chunks()
    begin, index = lists.offsets.to_numpy(), lists.values.to_numpy()
    value = inputs.column("v").combine_chunks().values.to_numpy()
    rng = np.random.default_rng(5)
    weights = np.zeros((HASHED + _STATISTICS + 1, FACTORS + 1))  # column 0: linear, the last row: intercept
    weights[:-1, 1:] = rng.normal(0, 0.05, (HASHED + _STATISTICS, FACTORS))
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for low in range(0, len(order), BATCH):
            rows = order[low:low + BATCH]
            sizes = begin[rows + 1] - begin[rows]
            starts = np.cumsum(sizes) - sizes
            at = np.repeat(begin[rows] - starts, sizes) + np.arange(sizes.sum())
            i, x, of = index[at], value[at][:, None], np.repeat(np.arange(len(rows)), sizes)
            terms = weights[i] * x
            sums = np.add.reduceat(terms, starts)
            margin = weights[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2) - np.add.reduceat(terms[:, 1:] ** 2, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]) / len(rows)
            slope = np.empty_like(terms)
            slope[:, :1] = x
            slope[:, 1:] = x * (sums[of, 1:] - terms[:, 1:])
            gradient = DECAY * weights
            np.add.at(gradient, i, error[of][:, None] * slope)
            gradient[-1, 0] += error.sum()
            step += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
            weights -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return float(weights[-1, 0]), weights[:-1, 0], weights[:-1, 1:]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1, higher where label 1 is likelier. A null text scores as an empty
    one; other columns pass through (one called like ``score_col`` is replaced). Without enough labels
    every row scores their share of ones, or 0.5 without any."""
    docs = docs.drop(score_col)
    if model.constant is not None:
        return docs.withColumn(score_col, F.lit(float(model.constant)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_column(docs, text_col, score_col, T.DoubleType(),
                       _pieces(lambda data, words: shared.value.score(data, words), pa.float64()))
