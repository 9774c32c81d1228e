"""Near-duplicate documents by an inverted join over MinHash signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import bound_batches
from tidemark.llm.components import connected_components
from tidemark.llm.words import mix, row_starts, shingle_hashes, union_labels, word_chunks
from tidemark.session import stored_copy

COORDINATES = 64
# The share of links that may agree in fewer coordinates than are asked for (at 80 percent: 36 of 64, where 51 agree on average).
MISSED = 5e-6
# Rarity is judged by counts in so many buckets; any order of the postings gives whole results.
BUCKETS = 1 << 18
# Longer posting lists and larger candidate groups are compared in pairs of chunks of this size.
LIST_CHUNK, GROUP_CHUNK = 512, 256
_COLUMNS = 4096

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int) -> int:
    """How many coordinates sets of that similarity agree in, but for a share of MISSED of them at most."""
    p, below = percent / 100, 0.0
    for n in range(COORDINATES + 1):
        below += math.comb(COORDINATES, n) * p ** n * (1 - p) ** (COORDINATES - n)
        if below > MISSED:
            return max(1, n)
    return COORDINATES


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set of shingles."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[None, i:i + 4096] ^ _MASKS[:, None]
        low = np.minimum(low, ((part * _FACTORS[:, None]) >> np.uint64(32)).min(1))
    return low.astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, rows in word_chunks(batch.column(1)):
            at = row_starts(rows, first, last)
            counts, keys, signatures = [], [], []
            for i in range(last - first):
                shingles = shingle_hashes(words[at[i]:at[i + 1]], size)
                counts.append(len(shingles))
                keys.append(_set_key(shingles))
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()),
                pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])


def _set_key(shingles: np.ndarray) -> int:
    """One 64-bit key for a set of shingles."""
    spread = mix(shingles)
    summary = np.array([len(spread), 0, 0], np.uint64)
    if len(spread):
        summary[1], summary[2] = np.add.reduce(spread), np.bitwise_xor.reduce(spread)
    summary = mix(summary + np.arange(3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.add.reduce(summary, keepdims=True)).view(np.int64)[0])


def _tokens(signatures: pa.Array) -> np.ndarray:
    """One 64-bit token per coordinate and value."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return mix((values.astype(np.uint64) << np.uint64(8)) | np.arange(COORDINATES, dtype=np.uint64))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if batch.num_rows:
            counts += np.bincount((_tokens(batch.column(0)) % np.uint64(BUCKETS)).ravel().astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def _postings(batches: Iterator[pa.RecordBatch], counts, matches: int) -> Iterator[pa.RecordBatch]:
    frequency = counts.value
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = _tokens(batch.column(1))
        rarity = frequency[(tokens % np.uint64(BUCKETS)).astype(np.int64)]
        order = np.lexsort((tokens, rarity), axis=1)[:, :COORDINATES - matches + 1]
        kept = np.take_along_axis(tokens, order, 1)
        keys = np.repeat(batch.column(0).to_numpy(), kept.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(kept.ravel().view(np.int64)), pa.array(keys)], ["token", "set_key"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, in tables that never split a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero((a != a[-1]) | (b != b[-1]))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if not cut and held:
            first = held[0]
            if (first.column(0)[0].as_py(), first.column(1)[0].as_py()) == (a[0], b[0]):
                held.append(batch)
                continue
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _colliding(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges that span the groups of documents of each list that agree in enough coordinates. Sets whose
    sizes differ too much for a link aren't compared."""
    matches = least_matches(percent)
    for table in _whole_groups(batches):
        token, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        keys, sizes = table.column(2).to_numpy(), table.column(3).to_numpy()
        values = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        begins = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        left = np.repeat(np.r_[begins[1:], len(token)], np.diff(np.r_[begins, len(token)])) - np.arange(len(token)) - 1
        a_all, b_all = [], []
        rows = np.flatnonzero(left > 0)
        step = 1
        while len(rows):
            a, b = rows, rows + step
            near = (100 * sizes[a] >= percent * sizes[b]) & (100 * sizes[b] >= percent * sizes[a])
            a, b = a[near], b[near]
            enough = (values[a] == values[b]).sum(1) >= matches
            a_all.append(a[enough])
            b_all.append(b[enough])
            step += 1
            rows = rows[left[rows] >= step]
        if a_all:
            labels = union_labels(len(token), np.concatenate(a_all), np.concatenate(b_all))
            hung = np.flatnonzero(keys != keys[labels])
            edges = np.unique(np.stack([keys[hung], keys[labels[hung]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for first, last, words, rows in word_chunks(batch.column(2)):
            at = row_starts(rows, first, last)
            sets = [shingle_hashes(words[at[i]:at[i + 1]], size) for i in range(last - first)]
            same = np.array([_set_key(x) for x in sets], np.int64) == keys[first:last]
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["set_key", "group_key", "shingles"]).filter(pa.array(same))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; a hash that only one set has is left out."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.r_[False, every[1:] != every[:-1]])
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        at = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[at], column[at] - low] = 1
        out += has @ has.T
    return out


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges that span the links confirmed on full sets within each group."""
    for table in _whole_groups(batches):
        group, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        keys, sets = table.column(2).to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column(3).to_pylist()]
        begins = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
        us, vs = [], []
        for low, high in zip(begins, np.r_[begins[1:], len(group)]):
            own, sizes = sets[low:high], np.array([len(x) for x in sets[low:high]])
            if len(own) < 2:
                continue
            shared = _overlaps(own)
            a, b = np.nonzero(np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared), 1))
            labels = union_labels(len(own), a, b)
            hung = np.flatnonzero(labels != np.arange(len(own)))
            us.append(keys[low:high][hung])
            vs.append(keys[low:high][labels[hung]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _in_chunks(rows: DataFrame, by: str, counts: DataFrame, chunk: int) -> DataFrame:
    """Rows of the groups with more than one row; a large group's go to all pairs of chunks that hold theirs."""
    joined = rows.join(counts.where("group_rows > 1"), by)
    chunks = F.ceil(F.col("group_rows") / chunk).cast("long")
    own = F.pmod(F.hash("set_key"), chunks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    return joined.select(by, F.explode(pairs).alias("part"), *[c for c in rows.columns if c != by])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row, linked where 100 * |A & B| >= percent * |A | B|.

    Sets are the distinct runs of ``size`` words (all words as one run if there are fewer). Equal sets
    are taken as one. Sets that are linked agree in least_matches(percent) coordinates, but for a share of
    MISSED of those at the very limit. Each set posts its rarest COORDINATES - least_matches + 1
    coordinate-value pairs: two sets that agree in so many share one of these in any common order of rarity. The other
    coordinates are skipped in the lists and only counted for sets that meet in one. What passes is
    confirmed on full sets. Long lists are compared in pairs of chunks, and lists hand on spanning
    edges in place of all pairs.

    component_id is the smallest id reachable and kept marks its row. Empty or null texts link with
    nothing and stay. Rows with a null id have a null component and stay. Rows that repeat an id share its
    component where their sets are equal or linked. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored_copy(source.mapInArrow(
        lambda batches: _signed(batches, size), "doc_id long, n_shingles long, set_key long, signature binary"), "signed")
    sets = stored_copy(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "sets")

    counts = np.zeros(BUCKETS, np.int64)
    counted = sets.select("signature").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():  # at most BUCKETS rows, however many documents
        counts[row.bucket] = row.n
    shared_counts = spark.sparkContext.broadcast(counts)
    postings = sets.select("set_key", "signature").mapInArrow(lambda batches: _postings(batches, shared_counts, least_matches(percent)), "token long, set_key long")
    lists = postings.groupBy("token").agg(F.count("*").alias("group_rows"))
    listed = _in_chunks(postings, "token", lists, LIST_CHUNK).join(sets.select("set_key", "n_shingles", "signature"), "set_key")
    candidates = (listed.select("token", "part", "set_key", "n_shingles", "signature").repartition("token", "part")
                  .sortWithinPartitions("token", "part").mapInArrow(lambda batches: _colliding(batches, percent), "u long, v long"))
    groups = stored_copy(connected_components(candidates), "groups")

    chosen = groups.join(sets.select(F.col("set_key").alias("node"), "first_id"), "node").select(
        F.col("node").alias("set_key"), F.col("root").alias("group_key"), F.col("first_id").alias("doc_id"))
    full = (source.join(chosen, "doc_id").select("set_key", "group_key", "text")
            .mapInArrow(lambda batches: _full_sets(batches, size), "set_key long, group_key long, shingles binary")
            .dropDuplicates(["set_key"]))
    sized = groups.groupBy(F.col("root").alias("group_key")).agg(F.count("*").alias("group_rows"))
    links = (_in_chunks(full, "group_key", sized, GROUP_CHUNK).select("group_key", "part", "set_key", "shingles")
             .repartition("group_key", "part").sortWithinPartitions("group_key", "part")
             .mapInArrow(lambda batches: _verified(batches, percent), "u long, v long"))
    linked = connected_components(links)

    of_set = sets.join(linked, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "first_id", F.coalesce("root", "set_key").alias("root"))
    smallest = of_set.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = of_set.join(smallest, "root").select("set_key", "component_id")
    empty = F.col("n_shingles") == 0
    out = signed.drop("signature").join(of_set, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
