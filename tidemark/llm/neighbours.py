"""Nearest vectors by beam search in robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import stored_copy

SHARD_ROWS, QUERY_ROWS = 4096, 1024
DEGREE, BEAM, RELAX = 32, 64, 1.2
_BATCH = 128


def _distances(vectors: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own nodes; -1 as a node is infinitely far."""
    gap = vectors[nodes] - queries[:, None, :]
    out = np.einsum("qnd,qnd->qn", gap, gap)
    out[nodes < 0] = np.inf
    return out


def beam_search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, squared distances, visited nodes) for each query: the beam's nodes, nearest first, -1 where short.

    In each step every query expands its nearest node that is not expanded yet, and keeps the nearest ``beam``.
    """
    n = len(queries)
    nodes = np.full((n, beam), -1)
    nodes[:, 0] = start
    far = np.full((n, beam), np.inf)
    far[:, 0] = _distances(vectors, nodes[:, :1], queries)[:, 0]
    done = nodes < 0
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column stands for -1
    seen[:, start] = seen[:, -1] = True
    every, visited = np.arange(n), []
    while len(every):
        pick = np.where(done[every], np.inf, far[every]).argmin(1)
        open_ = ~done[every, pick]
        every, pick = every[open_], pick[open_]
        if not len(every):
            break
        done[every, pick] = True
        own = np.full(n, -1)
        own[every] = nodes[every, pick]
        visited.append(own)
        fresh = graph[own[every]]
        fresh = np.where(seen[every[:, None], fresh], -1, fresh)
        seen[every[:, None], fresh] = True
        nodes_all = np.concatenate([nodes[every], fresh], 1)
        far_all = np.concatenate([far[every], _distances(vectors, fresh, queries[every])], 1)
        done_all = np.concatenate([done[every], fresh < 0], 1)
        best = np.argsort(far_all, axis=1, kind="stable")[:, :beam]
        nodes[every], far[every], done[every] = (np.take_along_axis(x, best, 1) for x in (nodes_all, far_all, done_all))
    return nodes, far, np.stack(visited, 1) if visited else np.zeros((n, 0), np.int64)


def robust_prune(vectors: np.ndarray, point: int, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Nearest first, each kept neighbour removes candidates that it is ``relax`` times nearer to than the point is."""
    candidates = candidates[(candidates >= 0) & (candidates != point)]
    own = ((vectors[candidates] - vectors[point]) ** 2).sum(1)
    order = np.argsort(own, kind="stable")
    candidates, own = candidates[order], own[order]
    between = vectors[candidates]
    squares = (between ** 2).sum(1)
    between = squares[:, None] + squares[None, :] - 2 * between @ between.T
    alive, kept = np.ones(len(candidates), bool), []
    at = 0
    while at < len(candidates) and len(kept) < degree:
        if alive[at]:
            kept.append(at)
            alive &= relax * relax * between[at] > own
        at += 1
    return candidates[kept]


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(neighbours, -1 where fewer; start node). Vectors are distinct."""
    n = len(vectors)
    rng = np.random.default_rng(13)
    start = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    slots = degree + degree // 2
    graph = np.full((n, slots), -1)
    if n > 1:
        graph[:, :min(8, n - 1)] = (np.arange(n)[:, None] + 1 + rng.permuted(np.tile(np.arange(n - 1), (1, 1)), axis=1)[0][:min(8, n - 1)][None, :]) % n
    for low in range(0, n, _BATCH):
        rows = low + np.arange(min(_BATCH, n - low))
        nodes, _, visited = beam_search(vectors, graph, start, vectors[rows], beam)
        for i, point in enumerate(rows):
            kept = robust_prune(vectors, point, np.unique(np.r_[nodes[i], visited[i], graph[point]]), degree, relax)
            graph[point] = -1
            graph[point, :len(kept)] = kept
            for other in kept:
                held = graph[other]
                if (held == point).any():
                    continue
                free = np.flatnonzero(held < 0)
                if len(free):
                    graph[other, free[0]] = point
                else:
                    fewer = robust_prune(vectors, other, np.r_[held, point], degree, relax)
                    graph[other] = -1
                    graph[other, :len(fewer)] = fewer
    return _all_reached(vectors, graph, start), start


def _all_reached(vectors: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """Pruning may cut off a node (of many equally near ones the last goes): its nearest reached node gets an edge more."""
    reached = np.zeros(len(graph) + 1, bool)
    reached[-1] = True  # stands for -1
    front = np.array([start])
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached[:-1])
        if not len(lost):
            return graph
        here = np.flatnonzero(reached[:-1])
        near = here[((vectors[here] - vectors[lost[0]]) ** 2).sum(1).argmin()]
        if (graph[near] >= 0).all():
            graph = np.c_[graph, np.full(len(graph), -1)]
        graph[near, np.flatnonzero(graph[near] < 0)[0]] = lost[0]
        front = lost[:1]


def _first_ids(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """For each distinct vector of a batch, its smallest ids: a common vector shrinks before the shuffle."""
    for batch in batches:
        groups: dict[bytes, list[int]] = {}
        for i, v in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            ids = groups.setdefault(v, [])
            if len(ids) < keep and (not ids or ids[-1] != i):
                ids.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(list(groups.values()), pa.list_(pa.int64()))], ["vec", "ids"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and vectors as bytes of doubles, without vectors that are null, zero or not finite in a part."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is not None and v is not None and None not in v:
                array = np.array(v, np.float64) + 0.0
                if len(array) and np.isfinite(array).all() and array.any():
                    ids.append(i)
                    out.append(array.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def _index(table: pa.Table) -> pa.Table:
    table = table.sort_by("vec")
    graph, start = build_graph(_matrix(table.column("vec")))
    starts = np.zeros(len(graph), bool)
    starts[start] = True
    return table.append_column("node", pa.array(np.arange(len(graph)), pa.int64())).append_column(
        "is_start", pa.array(starts)).append_column("next", pa.array([g[g >= 0] for g in graph], pa.list_(pa.int64())))


def _ask(index: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not index.num_rows or not queries.num_rows:
        return empty
    index = index.sort_by("node")
    vectors, asked = _matrix(index.column("vec")), _matrix(queries.column("vec"))
    links = index.column("next").to_pylist()
    graph = np.full((len(links), max(1, max(map(len, links)))), -1)
    for i, own in enumerate(links):
        graph[i, :len(own)] = own
    start, ids = int(index.column("is_start").to_numpy().argmax()), index.column("ids").to_pylist()
    nodes, _, _ = beam_search(vectors, graph, start, asked, beam)
    out = []
    for q, own in enumerate(queries.column("query_id").to_pylist()):
        near = nodes[q][nodes[q] >= 0]
        far = np.sqrt(((vectors[near] - asked[q]) ** 2).sum(1))
        # All nodes as near as the (k + 1)-th: the query's own may be one of them, and ids decide between equals.
        order = np.flatnonzero(far <= np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)])
        found = sorted((float(far[j]), i) for j in order for i in ids[near[j]] if i != own)[:k]
        out += [(own, i, d) for d, i in found]
    if not out:
        return empty
    a, b, c = zip(*out)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows by Euclidean distance.

    Equal vectors make one node with the k + 1 smallest ids, which is all that an answer can need. Nodes
    are dealt to shards of about SHARD_ROWS by a hash of the vector; each shard's graph is built in one
    task and stored, and searched in one task for each block of about QUERY_ROWS queries. Every row is
    indexed. Vectors of another length than the query's are never its neighbours. Rows with a null id,
    and vectors that are null, empty, zero or hold null or non-finite parts, take no part. Rows that
    repeat an id and a vector count once; a query never finds its own id. An empty table gives no rows.
    """
    rows = vectors.where(F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    packed = "vec_id long, vec binary"
    keep = k + 1

    def smallest(ids: Column) -> Column:
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, keep)

    partial = every.mapInArrow(_packed, packed).mapInArrow(lambda b: _first_ids(b, keep), "vec binary, ids array<long>")
    partial = partial.groupBy("vec", F.pmod(F.hash("ids"), F.lit(32)).alias("salt")).agg(smallest(F.col("ids")).alias("ids"))
    nodes = stored_copy(partial.groupBy("vec").agg(smallest(F.col("ids")).alias("ids")), "nodes")
    queries = stored_copy(rows.mapInArrow(_packed, packed).withColumnRenamed("vec_id", "query_id").distinct(), "queries")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = nodes.withColumns({"dim": F.octet_length("vec"), "shard": F.pmod(F.xxhash64("vec"), F.lit(shards))})
    schema = "vec binary, ids array<long>, dim int, shard long, node long, is_start boolean, next array<long>"
    index = stored_copy(dealt.select("vec", "ids", "dim", "shard").groupBy("dim", "shard").applyInArrow(_index, schema), "index")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumns({"dim": F.octet_length("vec"), "block": F.pmod(F.hash("query_id"), F.lit(blocks))}).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    key = ["dim", "shard", "block"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        lambda a, b: _ask(a, b, k, beam), "query_id long, vec_id long, score double")
    answers = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
