"""Token counts, periodic runs and whitening against the plain libraries and brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tidemark.llm import periodic_runs, token_counts, whitening
from tidemark.llm.queries import QUERIES, vocabulary_path
from test_llm_operators import SF, frame, with_clashes, words_of

AWKWARD = ["", None, " \t\n ", "one", "don't  STOP it ́x é ﬁ  1234 567", "<|endoftext|> and<|startoftext|>mid <s> </s>",
           "x" * 5000, "ab " * 3000, "a　b ​ c", "ΣΑΣ σας ΟΔΟΣ", "中文 字 text", "  lead and trail  ", "a  b   c\n\n d", "🙂 🙂🙂 !?!?", "\x1c\x1d\x85 v"]


def library_counts(path, texts):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return [len(own.encode(t or "", add_special_tokens=False)) for t in texts]
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    return [len(own.encode(t or "")) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_librarys(spark, name, monkeypatch):
    rng = random.Random(name)
    signs = ["a", "B", "é", "1", " ", "  ", "\n", ".", "'s", "ß", "́", " ", "the", "ing", "<", "|", "中", "\t"]
    texts = AWKWARD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    docs = with_clashes(frame(spark, texts).repartition(3).union(frame(spark, ["again"], [0]))).withColumn("token_count", F.lit("kept"))
    path = vocabulary_path(name)
    got = token_counts.count_tokens(docs, token_counts.read_vocabulary(path)).collect()
    expected = dict(zip(texts, library_counts(path, texts))) | {"again": library_counts(path, ["again"])[0]}
    assert len(got) == len(texts) + 1 and {r.token_count for r in got} == {"kept"}
    assert [(r.text, r.n_tokens) for r in got if r.n_tokens != expected[r.text]] == []
    counter = token_counts.Counter(token_counts.read_vocabulary(path))
    whole = " ".join(t for t in texts if t)
    assert [len(p) for p in token_counts.stretches(whole.encode(), 500)][:-1] and b"".join(token_counts.stretches(whole.encode(), 500)) == whole.encode()
    monkeypatch.setattr(token_counts, "stretches", lambda text, cut=token_counts.stretches: cut(text, 500))
    assert counter.count_long(whole.encode()) == library_counts(path, [whole])[0]
    assert token_counts.count_tokens(docs.limit(0), token_counts.read_vocabulary(path)).count() == 0


def test_remembered_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_BYTES", 2000)
    counter = token_counts.Counter(token_counts.read_vocabulary(vocabulary_path("word_bpe_49k.json")))
    texts = [f"word{i} other{i}" for i in range(200)]
    assert [counter.count([t.encode()])[0] for t in texts] == library_counts(vocabulary_path("word_bpe_49k.json"), texts)
    assert len(counter.known) < 100


def test_op11(spark):
    rows = QUERIES["op11_token_counts"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = dict(zip(texts, library_counts(vocabulary_path("word_bpe_49k.json"), texts.values())))
    assert [tuple(r) for r in rows if tuple(r) != (r.doc_id, len((texts[r.doc_id] or "").encode()), counts[r.doc_id], counts[r.doc_id] > 2048)] == []
    assert len(rows) == len(texts) and any(r.over_limit for r in rows)


def plain_runs(words):
    """Every stretch that a lag keeps, with its smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng):
    kinds = rng.choice([1, 2, 3, 8, 200])
    words = []
    for _ in range(rng.randint(0, 6)):
        words += ["w%d" % rng.randrange(kinds) for _ in range(rng.randint(0, 30))]
        base = ["w%d" % rng.randrange(kinds) for _ in range(rng.choice([1, 2, 5, 8, 9, 10, 13, 14, 20, 21, 30, 31, 45, 50, 70]))]
        turn = rng.randrange(len(base))
        words += [base[(turn + i) % len(base)] for i in range(rng.randint(2 * len(base), 5 * len(base)))]
        if rng.random() < 0.2 and len(words) < 400:
            words = words * rng.randint(2, 4)
    return words


def test_runs_are_those_of_brute_force(spark):
    rng = random.Random(12)
    texts = ["  ".join(periodic(rng)) for _ in range(200)] + ["", None, " \n\t ", "Aa aA " * 30, "one " * 200_000, "x y z", " a " * 30, "a\x1cb " * 40]
    docs = with_clashes(frame(spark, texts).withColumn("runs", F.lit(3))).repartition(5)
    got = periodic_runs.find_runs(docs.union(docs.where("doc_id < 3"))).collect()
    assert len(got) == len(texts) + 3 and "found_runs" not in got[0].asDict()
    for row in got:
        words = (row.text or "").encode().split()
        words = [w.decode() for w in words]
        runs = [tuple(r) for r in row.runs]
        assert runs == ([(0, 200_000, 1)] if len(words) == 200_000 else plain_runs(words))
        assert row.collapsed == plain_collapsed(words, runs)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_long_periods_and_equal_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    for p in (100, 777, 3000):
        words = np.concatenate([rng.integers(0, 50, 40), np.tile(rng.integers(0, 50, p), 3), rng.integers(50, 99, 40)]).astype(np.uint64)
        assert (40, 3 * p, p) in [(s, n, q) for s, n, q in periodic_runs.runs_of(words * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(words)]))[0] if q == p] or \
            any(q == p and s <= 40 and s + n >= 40 + 3 * p for s, n, q in periodic_runs.runs_of(words * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(words)]))[0])
    import pyarrow as pa
    monkeypatch.setattr(periodic_runs, "span_hashes", lambda piece, starts, ends, fold: np.zeros(len(starts), np.uint64))
    made = next(periodic_runs._pieces(pa.array(["a b c d " * 3 + "x y " * 20])))[0].as_py()
    assert [(r["start"], r["length"], r["period"]) for r in made["runs"]] == plain_runs(("a b c d " * 3 + "x y " * 20).split())


def test_op12(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    planted = 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = [w.decode() for w in (doc.text or "").encode().split()]
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n <= 3000 else [tuple(r) for r in periodic_runs.runs_of(np.unique(np.array(words), return_inverse=True)[1].astype(np.uint64), np.array([0, n]))[0]]
        planted += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        expected = (doc.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                    hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest())
        assert tuple(rows[doc.doc_id]) == expected
    assert planted >= 5


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain_whitening(vectors, k=4):
    grid = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in vectors.items()}
    fit = np.array(sorted(set(grid.values())), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in grid.items():
        for c in range(min(k, len(values))):
            out[i, c + 1] = (n, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), (np.array(x) - fit.mean(0)) @ axes[:, c] / np.sqrt(values[c]),
                             values[c] / values.sum())
    return out


def same_whitening(rows, expected):
    assert {(r.vec_id, r.component) for r in rows} == set(expected)
    signs = {}
    for r in sorted(rows, key=lambda r: -abs(r.whitened)):
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        sign = signs.setdefault(r.component, np.sign(r.whitened) * np.sign(whitened))
        assert (r.n, r.deviation) == (n, deviation) and r.whitened == pytest.approx(sign * whitened, rel=1e-7, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9


def test_whitening_agrees_with_plain_numbers(spark):
    rng = np.random.default_rng(2)
    good = {i: (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 7).tolist() for i in range(300)}
    good |= {i: good[5] for i in range(300, 420)}
    bad = [(1000, None, 0), (1001, [1.0, None, 2.0, 3.0, 4.0, 5.0], 0), (1002, [float("nan")] * 6, 0), (1003, [float("inf")] * 6, 0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in good.items()] + bad, VECTORS)
    rows = whitening.whiten(with_clashes(df).withColumn("grid", F.lit("kept"))).collect()
    assert {r.grid for r in rows} == {"kept"}
    same_whitening(rows, plain_whitening(good))
    again = whitening.whiten(df.repartition(7)).collect()
    assert sorted((r.vec_id, r.component, r.whitened, r.identity_error) for r in rows) == sorted((r.vec_id, r.component, r.whitened, r.identity_error) for r in again)


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTORS)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i], 0) for i in range(9)], VECTORS)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.component for r in flat} == {1, 2, 3}
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i % 5)] * 0 + [float(j * i % 7) for j in range(1, 2 + i % 3)], 0) for i in range(60)] + [(99, [], 0)], VECTORS)).collect()
    assert {(r.vec_id % 3 + 1, r.component) for r in mixed} == {(s, c) for s in (1, 2, 3) for c in range(1, s + 1)}
    huge = whitening.whiten(spark.createDataFrame([(i, [1e30 * (i % 2), float(i)], 0) for i in range(8)], VECTORS)).collect()
    assert len(huge) == 16 and all(r.identity_error < 1e-6 for r in huge)


def test_op13(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    same_whitening(QUERIES["op13_whitening"](spark, SF).collect(), plain_whitening(vectors))


def wide_orthogonal(rng, n):
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(5):
        q = q @ (1.5 * np.eye(n) - 0.5 * (q.T @ q))
    return q


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-6, 48), np.r_[3, 2, 2 + 1e-9, 2 - 2e-9, 1, 1 + 1e-12, 0.5, np.linspace(0.1, 0.2, 41)], np.r_[1, 1, 1, 0.5, 0.5, np.linspace(0.1, 0.2, 43)],
    1 + 1e-10 * np.arange(48), np.r_[1, 0.3, np.zeros(46)], np.zeros(3) + 2, np.ones(1)])
def test_refined_vectors_solve_the_problem(values):
    """Rough float32 vectors mix clusters closer than 1e-7; refined ones hold to extended precision."""
    rng = np.random.default_rng(7)
    wide = np.array(values, np.longdouble)
    q = wide_orthogonal(rng, len(wide))
    matrix = (q * wide) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.refine(matrix, np.linalg.eigh(matrix.astype(np.float32))[1])
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-16 * 100
    assert np.abs(vectors.T @ vectors - np.eye(len(wide))).max() < 1e-16
    assert np.abs(np.sort(found) - np.sort(wide)).max() < 1e-16


def test_outer_products_are_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(-whitening.LARGEST, whitening.LARGEST, (2500, 4))
    assert (whitening.exact_gram(values) == sum(np.outer(r.astype(object), r.astype(object)) for r in values)).all()
