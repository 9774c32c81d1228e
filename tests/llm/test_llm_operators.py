"""The operators against plain versions of what they promise, on small and awkward inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from oracle import compare, connect
from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, neighbours, partial_matching, personal_data, quality, revisits, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["set_key", "text_key", "component_id", "block", "kind", "score", "topic", "removed_lines", "_s"]


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def with_clashes(docs):
    return docs.withColumns({c: F.lit(1) for c in CLASHING})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=3, n=90):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.4:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 30, 80]))))
    return texts + ["", None, "one", "One", " \t ", "Ünï çödé ünï", texts[0], "long " * 30000]


def linked_by_hand(texts, size, percent):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    texts = corpus()
    got = near_dedup.near_duplicates(with_clashes(frame(spark, texts)), size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked_by_hand(texts, size, 80)


def test_near_duplicates_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST_CHUNK", 4)
    monkeypatch.setattr(near_dedup, "GROUP_CHUNK", 3)
    rng = random.Random(5)
    base = ["v%d" % i for i in range(80)]
    texts = [" ".join(w if rng.random() > 0.03 else "x%d" % rng.randrange(999) for w in base) for _ in range(60)]
    got = near_dedup.near_duplicates(frame(spark, texts), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked_by_hand(texts, 2, 80)


def test_near_duplicates_of_nulls_and_nothing(spark):
    got = near_dedup.near_duplicates(frame(spark, ["a b c", "a b c", "a b c", None], [None, 4, 4, 7])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True)] * 2 + [("7", "7", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def removed_by_hand(rows, least):
    docs = [(i, [(p, line.strip(), len(line.split())) for p, line in enumerate((t or "").split("\n")) if line.split()]) for i, t in rows]
    out = {}
    for k, (i, own) in enumerate(docs):
        gone = set()
        for j in range(len(own)):
            for k2 in range(k + 1):
                for j2 in range(len(docs[k2][1])):
                    if k2 == k and j2 >= j:
                        break
                    n = 0
                    while j + n < len(own) and j2 + n < len(docs[k2][1]) and docs[k2][1][j2 + n][1] == own[j + n][1] and not (k2 == k and j2 + n >= j):
                        n += 1
                    if sum(w for _, _, w in own[j:j + n]) >= least:
                        gone |= {own[x][0] for x in range(j, j + n)}
        out[i] = sorted(gone)
    return out


def test_line_runs(spark):
    rng = random.Random(8)
    lines = ["l%d" % i + " x" * (i % 5) for i in range(14)]
    texts = ["\n".join(rng.choice(lines + [""]) for _ in range(rng.randint(1, 25))) for _ in range(40)] + ["", None, "  ", "solo"]
    got = line_dedup.drop_repeated_lines(with_clashes(frame(spark, texts)), min_words=7)
    assert got.columns == DOCS.fieldNames() + [c for c in CLASHING if c != "removed_lines"] + ["removed_lines"]
    expected = removed_by_hand(list(enumerate(texts)), 7)
    for r in got.collect():
        assert r.removed_lines == expected[r.doc_id], r.doc_id
        if r.removed_lines:
            kept = [x for p, x in enumerate(texts[r.doc_id].split("\n")) if p not in set(r.removed_lines)]
            assert r.text == "\n".join(kept)
        else:
            assert r.text == texts[r.doc_id]


def test_line_runs_of_nulls_and_nothing(spark):
    long = "a " * 60
    got = line_dedup.drop_repeated_lines(frame(spark, [long, long, None], [None, None, 3])).collect()
    assert all(r.removed_lines == [] for r in got) and len(got) == 3
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == []


ITEM = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven geese watch from the bank"


def test_decontamination(spark):
    filler = " ".join("f%d" % i for i in range(300))
    half = " ".join(ITEM.split()[:9])
    texts = [filler, f"{filler} {ITEM} {filler}", ITEM.upper(), half, "", None, f"{filler} {half}", "geese " * 2000 + ITEM]
    items = spark.createDataFrame([(1, ITEM), (2, "a quite different question about rivers and the long way they run"), (3, None), (None, ITEM), (4, "too short")],
                                  "item_id long, text string")
    docs = with_clashes(frame(spark, texts))
    bad = {r.doc_id for r in decontaminate.benchmark_hits(docs, items).where("contaminated").collect()}
    assert bad == {1, 2, 7}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {0, 3, 4, 5, 6}
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(texts)
    assert decontaminate.benchmark_hits(frame(spark, []), items).collect() == []


def test_repeated_items_change_nothing(spark):
    """Items listed twice, or under two ids, are found as often as single ones."""
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {tuple(r) for r in decontaminate.benchmark_hits(docs, items).collect()}
    twice = {tuple(r) for r in decontaminate.benchmark_hits(docs, items.union(items)).collect()}
    renamed = items.union(items.select((F.col("item_id") + 1000).alias("item_id"), "text"))
    both = {tuple(r) for r in decontaminate.benchmark_hits(docs, renamed).collect()}
    assert len(once) > 20 and twice == once
    assert both == once | {(r[0], r[1] + 1000, *r[2:]) for r in once}


def test_short_items_and_two_texts_of_one_id(spark):
    other = "a quite different question about rivers and the long way they run to the sea at last"
    items = spark.createDataFrame([(1, "Zebra crossing ahead"), (2, "yes"), (3, ITEM), (3, other), (4, " \t"), (5, "to be or not"), (6, " ".join(["w%d" % i for i in range(200)]))],
                                  "item_id long, text string")
    texts = ["we saw a zebra crossing ahead of us", "a crossing zebra ahead", "oh YES", "yesterday", f"x {ITEM} y", f"x {other} y", "to be or not to be", "to be or maybe not",
             "f " * 150 + " ".join(["w%d" % i for i in range(200)]), "f " * 70 + ITEM]
    bad = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(frame(spark, texts), items).where("contaminated").collect()}
    assert bad == {(0, 1), (2, 2), (4, 3), (5, 3), (6, 5), (8, 6), (9, 3)}


def test_block_max_wand_equals_plain_sums(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    rng = np.random.default_rng(5)
    import pyarrow as pa
    for _ in range(60):
        n, terms = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        pairs = np.argwhere(rng.random((n, terms)) < rng.choice([0.1, 0.5, 0.9]))
        if not len(pairs):
            continue
        impact = np.round(rng.random(len(pairs)) ** 3, 2)
        chosen = [type("R", (), {"key": i, "length": 9, "question": [], "answer": []}) for i in range(n)]
        part = decontaminate._part(chosen, pa.table({"key": pairs[:, 0], "term": pairs[:, 1], "impact": impact}), 64)
        asked = [t for t in range(len(part.terms)) if rng.random() < 0.7]
        wanted = set(part.terms[asked].tolist())
        totals = collections.Counter()
        for (i, t), v in zip(pairs.tolist(), impact.tolist()):
            if t in wanted:
                totals[i] += v
        for score in (0.05, 0.6, 1.5):
            got = dict(decontaminate.block_max_wand(part, asked, score))
            groups = [decontaminate.GROUPS] * decontaminate.GROUPS
            for g in {i // part.width for i, v in totals.items() if v >= score - 1e-9}:
                groups[:g + 1] = [min(g, x) if x >= g else x for x in groups[:g + 1]]
            groups = [min([g for g in range(j, decontaminate.GROUPS) if groups[g] == g], default=decontaminate.GROUPS) for j in range(decontaminate.GROUPS)]
            assert dict(decontaminate.block_max_wand(part, asked, score, groups)) == got
            assert {i: round(v, 9) for i, v in got.items()} == {i: round(v, 9) for i, v in totals.items() if v >= score - 1e-9}


def test_retrieval_equals_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_POSTINGS", 100)
    rng = random.Random(2)
    vocabulary = ["t%d" % i for i in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 12))) for _ in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    n, mean = len(items), sum(len(i.split()) for i in items) / len(items)
    df = collections.Counter(t for i in items for t in set(i.split()))

    def weights(item):
        tf = collections.Counter(item.split())
        return {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item.split()) / mean)) for t, c in tf.items()}

    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            w = weights(item)
            score = sum(v for t, v in w.items() if t in text.split()) / sum(w.values())
            if score >= 0.6:
                expected[d, i] = round(score, 9)
    got = decontaminate.benchmark_hits(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == expected


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([(s, g, t, float(1 + (3 * i + 5 * j + 7 * k) % 11)) for i, s in enumerate("abc") for j, g in enumerate("de")
                                   for k, t in enumerate("fg")], "source string, lang string, topic string, tokens double")
    raked = mixing.rake(cells).toPandas()
    for name, power in mixing.POWERS.items():
        target = raked.groupby(name).tokens.sum() ** power
        assert np.allclose(raked.groupby(name).weight.sum(), target / target.sum(), rtol=1e-6)


def plain_rake(cells, shares, keep, rounds):
    """Targets by trying every number of full values, then cutting each round at the bound, in plain Python."""
    total = sum(cells.values())
    targets = []
    for d, wanted in enumerate(shares):
        most = collections.Counter()
        for cell, n in cells.items():
            most[cell[d]] += n / (keep * total)
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(mid * w, most[v]) for v, w in wanted.items()) < 1 else (low, mid)
        targets.append({v: min(high * w, most[v]) for v, w in wanted.items()})
    weight = {cell: n / total for cell, n in cells.items()}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            sums = collections.Counter()
            for cell, w in weight.items():
                sums[cell[d]] += w
            weight = {cell: w * target[cell[d]] / sums[cell[d]] if sums[cell[d]] else 0.0 for cell, w in weight.items()}
        weight = {cell: min(w, cells[cell] / (keep * total)) for cell, w in weight.items()}
    return weight, targets


def test_raking_to_given_shares_within_what_there_is(spark):
    rng = random.Random(8)
    cells = {(s, g, t): rng.randint(10, 40) for s in "abcd" for g in ("en", "de", "fr") for t in ("x", "y")}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    tokens = [collections.Counter() for _ in range(3)]
    for cell, n in cells.items():
        for d, v in enumerate(cell):
            tokens[d][v] += n
    total, roots = sum(cells.values()), sum(n ** 0.5 for n in tokens[0].values())
    left = tokens[1]["de"] + tokens[1]["fr"]
    shares = [{v: n ** 0.5 / roots for v, n in tokens[0].items()}, {"en": 0.7, "de": 0.3 * tokens[1]["de"] / left, "fr": 0.3 * tokens[1]["fr"] / left},
              {v: n / total for v, n in tokens[2].items()}]
    raked = mixing.rake(df, {"source": 0.5, "topic": 1.0}, 6, {"lang": {"en": 0.7}}, 0.5, -1)
    want, targets = plain_rake(cells, shares, 0.5, 6)
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    assert all(w <= cells[c] / (0.5 * total) * (1 + 1e-9) for c, w in got.items())
    report = {(r.dimension, r.value): r for r in mixing.reached_shares(raked).collect()}
    assert len(report) == 9 and report["lang", "en"].wanted == 0.7 and report["lang", "en"].tokens == tokens[1]["en"]
    assert report["lang", "en"].target < 0.7  # more than all its tokens would be
    for d, name in enumerate(mixing.DIMENSIONS):
        assert all(abs(report[name, v].target - x) < 1e-9 for v, x in targets[d].items())
    raked = mixing.rake(df, {"source": 0.5, "topic": 1.0}, 40, {"lang": {"en": 0.5}}, 0.5, 1e-7)
    assert all(abs(r.reached - r.target) < 1e-5 and abs(r.target - r.wanted) < 1e-9 for r in mixing.reached_shares(raked).collect())


def test_few_cells_are_raked_without_a_shuffle(spark, monkeypatch):
    """One task holds few cells, whatever the session's partitions; more cells are dealt out and get the same weights."""
    cells = spark.createDataFrame([(s, g, t, 1 + (3 * i + 5 * j + 7 * k) % 11) for i, s in enumerate("abcd") for j, g in enumerate("def")
                                   for k, t in enumerate("gh")], "source string, lang string, topic string, tokens long")
    plans, keep = [], mixing.stored_copy

    def seen(df, label):
        if label == "raked":
            plans.append(("Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions()))
        return keep(df, label)

    monkeypatch.setattr(mixing, "stored_copy", seen)
    weights = []
    for at_once in (mixing.TASK_CELLS, 5):
        monkeypatch.setattr(mixing, "TASK_CELLS", at_once)
        weights.append({(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, rounds=3, keep=0.5, tolerance=-1).collect()})
    assert plans[:3] == [(False, 1)] * 3 and len(plans) == 6 and all(shuffled for shuffled, _ in plans[3:])
    assert len(weights[0]) == 24 and weights[0].keys() == weights[1].keys() and all(abs(weights[0][c] - weights[1][c]) < 1e-12 for c in weights[0])


def test_shares_that_cannot_be_met(spark):
    df = spark.createDataFrame([("a", "en", "x", 30), ("a", "de", "x", 10), ("b", "en", "x", 20)], "source string, lang string, topic string, tokens long")
    for shares in ({"lang": {"en": 0.8, "de": 0.4}}, {"lang": {"en": -0.1}}, {"lang": {"it": 0.2}}, {"topic": {"x": 0.5}}):
        with pytest.raises(ValueError):
            mixing.rake(df, shares=shares)
    weights = {(r.source, r.lang): r.weight for r in mixing.rake(df, {"source": 1.0, "topic": 1.0}, shares={"lang": {"de": 0.0}}).collect()}
    assert weights["a", "de"] == 0 and weights["a", "en"] > 0 and abs(sum(weights.values()) - 1) < 1e-6
    docs = spark.createDataFrame([(i, "w " * 20, "en" if i % 4 else "de", "s", 3, "news" if i % 2 else None) for i in range(400)], T.StructType([*DOCS.fields, T.StructField("topic", T.StringType())]))
    got = mixing.mix_documents(docs, shares={"lang": {"de": 0.0}, "topic": {"news": 0.75}}, topic_col="topic", keep=0.4).collect()
    assert collections.Counter(r.topic for r in got) == {"news": 200, "none": 200} and len(got[0]) == 10  # five columns and five made
    assert not any(r.sampled for r in got if r.lang == "de")
    kept = collections.Counter(r.topic for r in got if r.sampled)
    assert {round(r.probability, 3) for r in got if r.lang == "en"} == {0.6, 0.4} and 100 <= kept["news"] <= 140 and 25 <= kept["none"] <= 55
    for keep in (0, 1.5):
        with pytest.raises(ValueError):
            mixing.mix_documents(docs, keep=keep)


def test_mixing_of_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 3), (None, "c d", "en", "s", 3), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], DOCS)
    got = mixing.mix_documents(with_clashes(docs)).collect()
    assert len(got) == 4 and {r.n_tokens for r in got} == {0, 2} and not any(r.sampled for r in got if not r.n_tokens)
    assert mixing.mix_documents(frame(spark, [])).collect() == []


def labelled(spark, n=400):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(rng.randint(10, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zorkish", "zorkoid", "yuckle"])
        texts.append(" ".join(words))
        labels.append((i, 0 if bad else 1, int(bad)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, cut):
    held = scored.join(labels, "doc_id").collect()
    return sum((r.score >= cut) == bool(r[column]) for r in held) / len(held)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train_toxicity(docs.select("doc_id", "text"), labels)
    scored = toxicity.score_toxicity(with_clashes(docs), model)
    assert set(scored.columns) == set(docs.columns + CLASHING)
    held = scored.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    assert accuracy(held, labels, "toxic", 0.3) > 0.9
    odd = toxicity.score_toxicity(frame(spark, ["", None, "x" * 100000], [1, None, 2]), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)


def test_trees_learn_in_few_tasks(spark, monkeypatch):
    """The sample is bounded, so the trees' many small jobs don't follow the partitions that keys are dealt to."""
    docs, labels = labelled(spark)
    kind, fit, tasks = type(docs), toxicity.GBTClassifier.fit, []
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: deal(self, max(n, 16) if by else n, *by))
    monkeypatch.setattr(toxicity.GBTClassifier, "fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    model = toxicity.train_toxicity(docs.select("doc_id", "text"), labels)
    assert tasks == [toxicity.TREE_TASKS]
    assert accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", 0.3) > 0.9


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = quality.train_quality(docs.select("doc_id", "text"), labels)
    held = quality.score_quality(with_clashes(docs), model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert accuracy(held, labels, "quality", 0.5) > 0.85
    odd = quality.score_quality(frame(spark, ["", None, "x" * 100000], [1, None, 2]), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(0.1, rng.normal(size=quality.HASHED + 21), rng.normal(size=(quality.HASHED + 21, 4)), np.zeros(21), np.ones(21))
    data = np.frombuffer(b"some words here", np.uint8)
    words = np.array([5, 9, 9, 70000], np.uint64)
    i, x = model.inputs(data, words)
    margin = 0.1 + x @ model.linear[i] + sum(x[a] * x[b] * (model.factors[i[a]] @ model.factors[i[b]]) for a in range(len(i)) for b in range(a))
    assert math.isclose(model.score(data, words), 1 / (1 + math.exp(-margin)), rel_tol=1e-6)


def test_models_without_labels(spark):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs.select("doc_id", "text"), none)).collect()} == {0.0}
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs.select("doc_id", "text"), none)).collect()} == {0.5}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.train_toxicity(empty.select("doc_id", "text"), labels)).collect() == []


def test_partial_matching_equals_a_plain_model(spark):
    texts = corpus(6, 40)[:-1] + ["é\x00è", "zzz new"]
    got = {r.doc_id: r for r in partial_matching.score_texts(with_clashes(frame(spark, texts)), F.col("doc_id") % 3 != 0).collect()}
    k = partial_matching.ORDER
    counts = [collections.defaultdict(collections.Counter) for _ in range(k + 1)]
    words = collections.Counter()
    for i, t in enumerate(texts):
        if i % 3:
            x = b"\0" * k + (t or "").encode() + b"\0"
            for p in range(k, len(x)):
                for j in range(k + 1):
                    counts[j][x[p - j:p]][x[p]] += 1
            words.update(words_of(t) + ["END"])
    total, distinct = sum(words.values()), len(words)

    def code(context, symbol):
        seen, out = set(), 0.0
        for j in range(k, -1, -1):
            left = {s: n for s, n in counts[j].get(context[k - j:], {}).items() if s not in seen}
            if left:
                weight = sum(left.values()) + len(left)
                if symbol in left:
                    return out + math.log10(left[symbol] / weight)
                out += math.log10(len(left) / weight)
                seen |= set(left)
        return out - math.log10(256 - len(seen))

    for i, t in enumerate(texts):
        x = b"\0" * k + (t or "").encode() + b"\0"
        own = words_of(t) + ["END"]
        assert math.isclose(got[i].score, sum(code(x[p - k:p], x[p]) for p in range(k, len(x))), rel_tol=1e-9), i
        assert math.isclose(got[i].base_score, sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(words[w] > 0 for w in own), total)


def test_partial_matching_without_training(spark):
    got = partial_matching.score_texts(frame(spark, ["ab", None]), F.lit(False)).collect()
    assert sorted(round(r.score / -math.log10(256), 6) for r in got) == [1, 3]
    assert partial_matching.score_texts(frame(spark, []), F.lit(True)).collect() == []


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 200)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(900, 12)).astype(np.float32)
    vectors[500:560] = vectors[0]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    odd = [(2000, None, 1), (2010, [], 1), (2020, [0.0] * 12, 1), (2030, [float("nan")] * 12, 1), (None, [1.0] * 12, 1), (2040, [1.0, None], 1)]
    frame_ = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame_, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 10))
    exact = vectors.astype(np.float64)
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(900), far))[:10]
        hits += len(set(best) & {i for i, _ in found})
        assert all(math.isclose(far[i], d, abs_tol=1e-12) for i, d in found) and len(found) == 10
    assert [i for i, _ in got[0]] == list(range(500, 510))
    assert hits / (10 * len(got)) >= 0.95
    assert neighbours.nearest(frame_.limit(0), F.lit(True)).collect() == []


def test_equal_distances_go_to_smaller_ids(spark):
    rng = random.Random(6)
    for _ in range(3):
        ids = rng.sample(range(64), 64)
        rows = [(i, [float(j == place) for j in range(64)]) for place, i in enumerate(ids)]
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
        assert sorted((r["rank"], r.vec_id) for r in got) == [(n, n) for n in range(1, 11)]
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r.vec_id) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("percent", [50, 60, 95, 100])
def test_links_at_other_similarities(spark, percent):
    rng = random.Random(percent)
    texts = corpus(percent, 60)[:-1]
    base = ["b%d" % i for i in range(77)]
    texts += [" ".join(base), " ".join(base[:60] + ["c%d" % i for i in range(18)]), " ".join(rng.sample(base, 77))]
    got = near_dedup.near_duplicates(frame(spark, texts), size=2, percent=percent).collect()
    expected = linked_by_hand(texts, 2, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected


def test_matches_asked_for():
    assert [near_dedup.least_matches(p) for p in (60, 80, 100)] == [21, 36, 64]


def test_toxicity_is_linear_in_long_words_and_repeats_itself(spark):
    import time
    start = time.time()
    toxicity.features("a" * 1_000_000, np.zeros(99), {})
    assert time.time() - start < 2
    docs, labels = labelled(spark)
    docs = docs.union(docs.where("doc_id < 40"))
    first, second = ({r.doc_id: r.score for r in toxicity.score_toxicity(d, toxicity.train_toxicity(d.select("doc_id", "text"), labels)).collect()}
                     for d in (docs.repartition(3), docs.orderBy(F.desc("doc_id")).coalesce(1)))
    assert first == second and len(first) == 400


def test_addresses(spark):
    forms = {"http://A.com/Doc": "a.com/Doc", "HTTPS://www.a.com:443/doc/": "a.com/doc", "a.com/x?utm_source=q&b=C": "a.com/x?b=C",
             "ftp://u:p@m.B.org./": "b.org", "http://a.com:8080/p#F": "a.com:8080/p", "": "", None: None}
    import duckdb
    con = duckdb.connect()
    for url, expected in forms.items():
        given = "NULL::VARCHAR" if url is None else f"'{url}'"
        assert con.execute(f"SELECT {revisits._canonical_sql(given)}").fetchone()[0] == expected, url
    made = spark.createDataFrame([(u,) for u in forms], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in made.collect()} == forms


def test_revisits_of_times_and_repeats(spark):
    """Timestamps, one address over many partitions, equal times and repeated records, long headers."""
    long = "v" * 100_000
    rows = [(i, "http://hot.com/Doc", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "response" if i % 50 == 0 else "revisit", {"etag": f"e{i // 50 % 2}", "x": long if i == 7 else "s"}, "d", i)
            for i in range(300)] + [(900, "http://hot.com/doc", "2024-01-01 00:01:00", "revisit", {}, "d", None)]
    rows += [(1000 + i, "http://tie.com", "2024-01-01 00:00:00", kind, {"etag": "e"}, "d", 1) for i, kind in enumerate(["response", "revisit", "response", "revisit"])]
    schema = "record_id long, url string, at string, kind string, headers map<string,string>, digest string, length long"
    made = spark.createDataFrame(rows + rows[:3], schema).withColumn("captured_at", F.to_timestamp("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = revisits.resolve_revisits(made).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) + 3
    of = {r.record_id: r for r in got}
    assert all(of[i].refers_to == i // 50 * 50 for i in range(300)) and of[900].outcome == "no_earlier_response"
    assert (of[1001].refers_to, of[1003].refers_to) == (1000, 1002) and of[7].merged_headers["x"] == "s"


def test_revisits(spark):
    made = [(1, "http://A.com/x", 1, "response", {"etag": "e1", "server": "s"}, "d1", 10), (2, "https://www.a.com/x/", 2, "revisit", {"etag": "e1", "date": "z", "via": "v"}, None, None),
            (3, "http://a.com/x#f", 3, "revisit", {"etag": "e2"}, "d1", None), (4, "http://b.com", 3, "revisit", {}, None, None),
            (5, "a.com/x?utm_source=q", 9, "revisit", None, "d1", None), (6, None, 4, "revisit", {}, None, None), (7, "http://a.com/x", None, "response", {}, "d", 1),
            (8, "http://a.com/x", 5, None, {}, None, None)]
    schema = "record_id long, url string, captured_at long, kind string, headers map<string,string>, digest string, length long, stretch int"
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame([(*m, 1) for m in made], schema)).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "response", 2: "resolved", 3: "changed", 4: "no_earlier_response", 5: "resolved",
                                                      6: "unusable", 7: "unusable", 8: "unverified"}
    assert got[2].refers_to == 1 and got[2].merged_headers == {"etag": "e1", "server": "s", "date": "z"} and got[2].payload_length == 10
    assert got[5].refers_to == 1 and got[3].refers_to is None
    assert revisits.resolve_revisits(spark.createDataFrame([], schema)).collect() == []


def test_personal_data(spark):
    card = "4556 7375 8689 9855"
    texts = [f"mail a.b@c.org, or +49 (30) 1234-5678; ip 10.0.0.256 and 10.0.0.1. {card}", "", None, "no data", "@" * 50 + "x@y", "ü a@b.c ü",
             "first 4556737586899855 then 4556_7375_8689_9855", "9" * 5000]
    got = {r.doc_id: r for r in personal_data.find_personal_data(with_clashes(frame(spark, texts))).collect()}
    patterns = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
                (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
                (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and personal_data._luhn(re.sub("[ -]", "", s))),
                (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in p.finditer(t or "") if ok(m[0]))
        listed = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(listed.split(",")) <= set(got[i].spans.split(","))
    assert got[6].spans == "card:6:22,card:28:47"
    assert personal_data.find_personal_data(frame(spark, [])).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        now = docs.count()
        assert 0 < now <= before, name
        before = now
        if name != "mixing":
            assert docs.columns == columns
    rows = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f", None, "s", 11), (3, "a b c d e f", "en", None, 11)], DOCS)
    for docs in (odd, odd.limit(0), with_clashes(odd)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
