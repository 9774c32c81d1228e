"""Nearest vectors, trigram similarity, slow statements and range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.scale import neighbour

# Fixed value: statements of this many milliseconds or more are slow.
SLOW_MS = 1000

# Up to this many query vectors are sent to the tasks; more are dealt in blocks of half as many.
QUERIES_AT_ONCE = 4096
# Vectors that meet a block of queries in one task, about.
VECTORS_AT_ONCE = 1 << 16


def knn(
    df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine",
    id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query",
) -> DataFrame:
    """Exact nearest ``k`` vectors of every query: ``(query_id, id, distance, rank)``, ties by id.

    Few queries go to every task, which multiplies its batches with the query matrix and keeps ``k``
    candidates per query; the vectors stay where they are. More than ``QUERIES_AT_ONCE`` queries stay
    distributed: they are dealt into blocks by hash, the vectors into slots, and each block meets each
    slot in one group of bounded size. Either way ``k`` rows per query and task or slot are ranked.
    Null vectors on either side take no part, nor do distances that are no number."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    id_type, q_type = dict(df.dtypes)[id_col], dict(queries.dtypes)[query_id]
    schema = f"{query_id} {q_type}, {id_col} {id_type}, distance double"
    df = df.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
    queries = queries.select(query_id, query_vec).where(F.col(query_vec).isNotNull())
    rows = queries.limit(QUERIES_AT_ONCE + 1).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(rows) <= QUERIES_AT_ONCE:
        ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
        found = df.mapInPandas(_nearest_in_task(ids, matrix, k, metric, id_col, vec_col, query_id), schema)
    else:
        blocks = -(-2 * queries.count() // QUERIES_AT_ONCE)
        slots = max(1, -(-df.count() // VECTORS_AT_ONCE))

        def dealt(rows: DataFrame, mine: str, parts: int, other: str, copies: int) -> DataFrame:
            return rows.withColumn(mine, F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).withColumn(
                other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

        def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or held.empty:
                return pd.DataFrame({query_id: [], id_col: [], "distance": []})
            matrix = np.stack(asked[query_vec].to_numpy()).astype(np.float64)
            nearest = _nearest_in_task(asked[query_id].to_numpy(), matrix, k, metric, id_col, vec_col, query_id)
            steps = max(1, (1 << 24) // len(asked))
            return pd.concat(nearest(held.iloc[i:i + steps] for i in range(0, len(held), steps)), ignore_index=True)

        found = dealt(queries, "_block", blocks, "_slot", slots).groupBy("_block", "_slot").cogroup(
            dealt(df, "_slot", slots, "_block", blocks).groupBy("_block", "_slot")).applyInPandas(meet, schema)
    nearest = Window.partitionBy(query_id).orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _nearest_in_task(ids, matrix, k, metric, id_col, vec_col, query_id):
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_ids: np.ndarray | None = None
        best: np.ndarray | None = None
        for batch in batches:
            if batch.empty:
                continue
            vectors = np.stack(batch[vec_col].to_numpy()).astype(np.float64)
            dots = matrix @ vectors.T
            if metric == "cosine":
                scale = np.outer(norms, np.linalg.norm(vectors, axis=1))
                distance = 1 - np.divide(dots, scale, out=np.full_like(dots, np.nan), where=scale > 0)
            else:
                squares = (norms ** 2)[:, None] - 2 * dots + (vectors ** 2).sum(axis=1)[None, :]
                distance = np.sqrt(np.maximum(squares, 0))
            these = np.broadcast_to(batch[id_col].to_numpy(), distance.shape)
            if best is not None:
                distance, these = np.hstack([best, distance]), np.hstack([best_ids, these])
            order = np.lexsort((these, distance), axis=1)[:, :k]
            best = np.take_along_axis(distance, order, axis=1)
            best_ids = np.take_along_axis(these, order, axis=1)
        if best is not None:
            width = best.shape[1]
            rows = pd.DataFrame({query_id: np.repeat(np.array(ids), width), id_col: best_ids.ravel(), "distance": best.ravel()})
            yield rows[rows["distance"].notna()]
    return run


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words of a text, each padded with two blanks in front and
    one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(df: DataFrame, column: str, pattern: str, threshold: float = 0.3) -> DataFrame:
    """Rows whose text shares at least ``threshold`` of the trigrams of both texts with the pattern."""
    mine, wanted = F.col("_grams"), trigrams(F.lit(pattern))
    shared = F.size(F.array_intersect(mine, wanted))
    similarity = shared / (F.size(mine) + F.size(wanted) - shared)
    scored = df.withColumn("_grams", trigrams(F.col(column))).withColumn("similarity", similarity)
    return scored.where(F.col("similarity") >= threshold).drop("_grams")


def normalise_statement(text: Column) -> Column:
    """Statement text with string and number literals replaced by ``?`` and blanks folded."""
    out = F.regexp_replace(text, "'(?:[^']|'')*'", "?")
    out = F.regexp_replace(out, r"\b\d+(?:\.\d+)?\b", "?")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def slow_queries(lines: DataFrame, column: str = "line", slow_ms: float = SLOW_MS) -> DataFrame:
    """Slow statements by normalised text: calls, total, mean and greatest duration. A plain text
    search leaves out most lines before any expression runs."""
    reports = lines.where(F.col(column).contains(" LOG:  duration: ")).select(F.col(column).alias("line"))
    logged = r"(?s) LOG:  duration: ([0-9.]+) ms  (?:statement|execute [^:]*): (.*)$"
    duration = F.regexp_extract("line", logged, 1).try_cast("double")
    slow = reports.where(duration >= slow_ms).select(
        normalise_statement(F.regexp_extract("line", logged, 2)).alias("statement"), duration.alias("ms"))
    return slow.groupBy("statement").agg(
        F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))


def partition_report(
    df: DataFrame, column: str, interval: str = "month", retain: int | None = None,
) -> DataFrame:
    """Range partitions of a time column: rows, bounds, empty partitions before each one, and
    whether retention by ``retain`` newest intervals has expired it. Rows are counted first; the
    ordered step sees one row per partition."""
    start = F.date_trunc(interval, F.col(column))
    parts = df.where(F.col(column).isNotNull()).groupBy(start.alias("part_start")).agg(
        F.count("*").alias("rows"), F.min(column).alias("first_value"), F.max(column).alias("last_value"))
    unit = {"hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}[interval]
    months = {"month": 1, "year": 12}.get(interval)
    before = neighbour(parts, [], ["part_start"], {"_before": F.col("part_start")})
    if months:
        number = lambda c: F.call_function("div", F.year(c) * 12 + F.month(c) - 1, F.lit(months))
        end = F.col("part_start") + F.make_ym_interval(months=F.lit(months))
    else:
        width = {"hour": 3600, "day": 86_400, "week": 604_800}[interval]
        # Mondays: 1970-01-05 is 345600 s after the epoch
        shift = 345_600 if unit == "weeks" else 0
        number = lambda c: F.call_function("div", F.unix_seconds(c) - shift, F.lit(width))
        end = F.col("part_start") + F.make_dt_interval(secs=F.lit(width))
    gap = number(F.col("part_start")) - number(F.col("_before")) - 1
    report = before.withColumns({"part_end": end, "gap_before": F.coalesce(gap, F.lit(0)).cast("bigint")})
    if retain is not None:
        newest = parts.agg(F.max("part_start").alias("m")).select(number(F.col("m"))).scalar()
        report = report.withColumn("expired", number(F.col("part_start")) <= newest - retain)
    return report.drop("_before")


def write_partitioned(df: DataFrame, path: str, column: str, interval: str = "month", mode: str = "append") -> None:
    """Parquet folders per range partition; rows of one partition are spread over many files."""
    dated = df.withColumn("part", F.date_format(F.date_trunc(interval, F.col(column)), "yyyy-MM-dd-HH"))
    dated.write.mode(mode).partitionBy("part").parquet(path)


def drop_expired(report: DataFrame) -> Sequence[str]:
    """Folder names of expired partitions; as many as the table has partitions."""
    names = report.where("expired").select(F.date_format("part_start", "yyyy-MM-dd-HH").alias("p"))
    return [f"part={r.p}" for r in names.toLocalIterator()]
