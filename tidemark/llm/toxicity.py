"""Toxicity of texts: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.near_dedup import signature
from tidemark.llm.training import byte_class, byte_shares, free_name, labelled_sample, with_column
from tidemark.llm.words import row_starts, shingle_hashes, text_buffers, word_chunks
from tidemark.session import stored_copy

SAMPLE = 12_000
# The trees learn from the bounded sample in so many tasks, however many partitions the session deals rows to.
TREE_TASKS = 4
# A term of the lexicon occurs in so many toxic texts of the sample, with log odds of so much.
LEAST_TEXTS, LEAST_ODDS = 2, 2.0
_PREFIXES = (4, 5)
_NEAR = 3
_WORD = re.compile(r"[^\W\d_]+")
# A match begins where a run of letters begins, and the run is never taken back: linear in the length of a text.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$!0134578][^\W_][^\s]*")
# Words of address in the second person.
_SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_UNMASK = str.maketrans("013457@$!8", "oieastasib", "*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _terms(words: list[str]) -> set[str]:
    """Words and their beginnings (with a star)."""
    found = set(words)
    for n in _PREFIXES:
        found |= {w[:n] + "*" for w in words if len(w) > n}
    return found


def features(text: str, shares: np.ndarray, lexicon: dict[str, float]) -> list[float]:
    """Densities of the lexicon, nearness to the second person, capitals, punctuation, obfuscation, size."""
    words = _words(text)
    n = max(1, len(words))
    get = lexicon.get
    weights = [get(w) or (get(w[:5] + "*") or get(w[:4] + "*") if len(w) > 4 else None) for w in words]
    hits = [i for i, w in enumerate(weights) if w]
    own = [weights[i] for i in hits]
    exact = sum(words[i] in lexicon for i in hits)
    second = [i for i, w in enumerate(words) if w in _SECOND]
    close = sum(any(abs(i - j) <= _NEAR for j in second) for i in hits) if len(second) <= 50 else sum(
        bool(_SECOND.intersection(words[max(0, i - _NEAR):i + _NEAR + 1])) for i in hits)
    masked = _MASKED.findall(text.lower())
    unmasked = [get(w) or 0.0 for m in masked for w in _WORD.findall(m.translate(_UNMASK))]
    return [
        float(len(hits)), len(hits) / n, sum(own) / n, sum(own), max(own, default=0.0), float(exact), exact / n,
        float(len({words[i] for i in hits})), float(close), close / n, len(second) / n,
        float(sum(w > 0 for w in unmasked)), max(unmasked, default=0.0), len(masked) / n,
        float(shares[byte_class("upper")]), float(shares[byte_class("exclaim")]), float(shares[byte_class("question")]),
        float(shares[byte_class("stop")] + shares[byte_class("comma")]), float(shares[byte_class("symbol")]),
        float(shares[byte_class("digit")]), float(np.log1p(len(words))), len(set(words)) / n]


def _feature_pieces(lexicon) -> "callable":
    def of(column: pa.Array) -> Iterator[pa.Array]:
        known = lexicon.value
        data, offsets = text_buffers(column)
        for low in range(0, len(column), 256):
            rows = range(low, min(low + 256, len(column)))
            texts = column.slice(low, len(rows)).to_pylist()
            yield pa.array([features(t or "", byte_shares(data[offsets[i]:offsets[i + 1]]), known) for i, t in zip(rows, texts)],
                           pa.list_(pa.float64()))
    return of


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = list(_terms(_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.float64())], ["term", "label"])


def _one_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, rows in word_chunks(batch.column(1)):
            at = row_starts(rows, first, last)
            low = np.stack([signature(shingle_hashes(words[at[i]:at[i + 1]], 2))[:2] for i in range(last - first)]).astype(np.int64)
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low[:, 0]), pa.array(low[:, 1])], [*batch.schema.names, "low1", "low2"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of (text, label) rows with their log odds for label 1: all that LEAST_TEXTS and LEAST_ODDS
    admit, which the bounded sample limits.

    Copies and most near copies count once: of rows (doc_id, label, text) with the same smallest shingle the
    one with the smallest doc_id is kept.
    """
    single = sample.select("label", "text", "doc_id").mapInArrow(_one_of_copies, "label double, text string, doc_id long, low1 long, low2 long")
    for low in ("low1", "low2"):
        single = single.groupBy(low).agg(F.min(F.struct("doc_id", "label", "text", *{"low1", "low2"} - {low})).alias("kept")).select(low, "kept.*")
    single = stored_copy(single.select("text", "label"), "single")
    toxic, total = single.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (total - toxic + 1))
    counted = single.mapInArrow(_sample_terms, "term string, label double").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")).where(F.col("toxic") >= LEAST_TEXTS)
    best = counted.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy("term")
    return {row.term: float(row.odds) for row in best.collect()}


class ToxicityModel:
    """Lexicon, trees and calibration; or the share of label 1 alone, where labels are too few to learn from."""

    def __init__(self, lexicon, trees, curve, constant: float | None = None):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2,
                   bound: int = SAMPLE) -> ToxicityModel:
    """docs: doc_id, text. Learns from at most ``bound`` labelled rows outside the held-out fold.

    Two fifths teach the lexicon, two fifths the trees and one fifth the calibration, so that no part
    trusts what another has merely memorised.
    """
    spark = docs.sparkSession
    sample = stored_copy(labelled_sample(docs, labels, label, folds, fold, bound).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))), "sample")
    counts = {(row.late, row.label): row.n for row in sample.groupBy(
        (F.col("part") == 4).alias("late"), "label").agg(F.count("*").alias("n")).collect()}
    ones, n = sum(k for (_, c), k in counts.items() if c == 1.0), sum(counts.values())
    if min(ones, n - ones) < 5 or len({c for late, c in counts if late}) < 2 or len({c for late, c in counts if not late}) < 2:
        return ToxicityModel(None, None, None, ones / n if n else 0.0)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(sample.where("part < 2")))
    seen = with_column(sample.where("part >= 2").select("doc_id", "text", "label", "part"), "text", "f", T.ArrayType(T.DoubleType()), _feature_pieces(lexicon))
    seen = stored_copy(seen.select("doc_id", "label", "part", "f"), "features")
    # The trees draw rows by their place: a fixed place for every row makes the model the same in every run.
    seen = seen.repartition(TREE_TASKS, "doc_id").coalesce(TREE_TASKS).sortWithinPartitions("doc_id", "label", "f").withColumn("features", array_to_vector("f"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=30, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=11
                          ).fit(seen.where("part < 4").select("label", "features"))
    margins = trees.transform(seen.where("part = 4")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(stored_copy(margins, "margins"))
    return ToxicityModel(lexicon, trees, curve)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1. A null text scores as an empty one; all other columns pass through
    (one called like ``score_col`` is replaced). Without enough labels every row scores their share of ones."""
    docs = docs.drop(score_col)
    if model.trees is None:
        return docs.withColumn(score_col, F.lit(float(model.constant)))
    names = {c: free_name(docs, "tox_" + c) for c in ("list", "vector", "raw", "probability", "prediction", "margin")}
    out = with_column(docs, text_col, names["list"], T.ArrayType(T.DoubleType()), _feature_pieces(model.lexicon))
    trees = model.trees.setFeaturesCol(names["vector"]).setRawPredictionCol(names["raw"]).setProbabilityCol(
        names["probability"]).setPredictionCol(names["prediction"])
    out = trees.transform(out.withColumn(names["vector"], array_to_vector(names["list"])))
    out = out.withColumn(names["margin"], vector_to_array(names["raw"])[1])
    out = model.curve.setFeaturesCol(names["margin"]).setPredictionCol(score_col).transform(out)
    return out.drop(*names.values())
