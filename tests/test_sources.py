import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, extras, joins, similarity
from tidemark.sources import archive, statistics, storage, telemetry

SEG = 16 << 20


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def seg(timeline, no):
    return f"{timeline:08X}{no // 256:08X}{no % 256:08X}"


def test_catalog_scan_fetch_and_copy(spark, tmp_path):
    store, local = str(tmp_path / "archive"), str(tmp_path / "local")
    for i in range(5):
        write(f"{store}/{seg(1, i)}", b"archived %d" % i)
    for extra in (seg(1, 5) + ".partial", "00000002.history", "notes.txt", seg(1, 6) + "0"):
        write(f"{store}/{extra}", b"x")
    write(f"{local}/{seg(1, 3)}", b"already here")
    listed = archive.scan_segment_catalog(spark, store)
    assert sorted((r.name, r.state) for r in listed.collect()) == sorted(
        [(seg(1, i), "complete") for i in range(5)] + [(seg(1, 5) + ".partial", "partial"), ("00000002.history", "history")])
    assert {r.seg_no for r in listed.where("state = 'complete'").collect()} == set(range(5))
    plan = listed.select("name", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    wanted = spark.createDataFrame([(seg(1, 1),), (seg(9, 9),)], "name string")
    assert [(r.name, bytes(r.content)) for r in archive.fetch_segments(spark, store, wanted).collect()] == [(seg(1, 1), b"archived 1")]
    copied = archive.copy_missing_segments(spark, store, local, seg(1, 2)).collect()
    assert sorted((r.name, r.fetched, r.error) for r in copied) == [(seg(1, 2), True, None), (seg(1, 4), True, None)]
    assert sorted(os.listdir(local)) == [seg(1, 2), seg(1, 3), seg(1, 4)]
    assert open(f"{local}/{seg(1, 3)}", "rb").read() == b"already here"
    assert archive.copy_missing_segments(spark, store, local, seg(1, 2)).count() == 0


def test_copy_reports_failures(spark, tmp_path):
    store, local = str(tmp_path / "a"), str(tmp_path / "l")
    write(f"{store}/{seg(1, 0)}", b"x")
    os.makedirs(local)
    os.makedirs(f"{local}/keep")
    job = archive.copy_missing_segments(spark, store, local, seg(1, 0))
    os.rename(local, local + "2")
    (row,) = job.collect()
    assert (row.name, row.fetched) == (seg(1, 0), False) and "No such file" in row.error


def test_apply_retention(spark, tmp_path):
    store = str(tmp_path)
    for i in range(12):
        write(f"{store}/{seg(1, i)}", b"x")
    write(f"{store}/{seg(1, 12)}.partial", b"x")
    dry = archive.apply_retention(spark, store, 8)
    assert dry.where("action = 'delete'").count() == 4 and len(os.listdir(store)) == 13
    done = archive.apply_retention(spark, store, 8, dry_run=False)
    assert sorted(r.name for r in done.where("deleted").collect()) == [seg(1, i) for i in range(4)]
    assert sorted(n for n in os.listdir(store) if not n.endswith(".crc")) == [seg(1, i) for i in range(4, 12)] + [seg(1, 12) + ".partial"]
    with pytest.raises(ValueError):
        archive.apply_retention(spark, store, 7)


def test_archive_jobs_on_another_scheme(spark, tmp_path):
    """Rows say what happened: files of a scheme of its own, one of them locked, one replaced by another."""
    root, locked = str(tmp_path), seg(1, 0)

    def vault(path):
        if path.endswith(locked):
            raise OSError("locked")
        from pyarrow import fs
        return fs.SubTreeFileSystem(root, fs.LocalFileSystem()), path.removeprefix("vault://")

    schemes = {"vault": vault}
    for i in range(12):
        write(f"{root}/store/{i // 4}/{seg(1, i)}", b"content %d" % i)
    listed = archive.scan_segment_catalog(spark, "vault:///store", schemes).collect()
    assert sorted((r.name, r.path) for r in listed) == [(seg(1, i), f"vault:///store/{i // 4}/{seg(1, i)}") for i in range(12)]
    write(f"{root}/local/{seg(1, 11)}.partial", b"x")
    copied = archive.copy_missing_segments(spark, "vault:///store", "vault:///local", seg(1, 9), schemes=schemes).collect()
    assert sorted((r.name, r.fetched, r.error) for r in copied) == [(seg(1, i), True, None) for i in (9, 10, 11)]
    assert open(f"{root}/local/{seg(1, 10)}", "rb").read() == b"content 10"
    assert storage.store_file(f"{root}/local/{seg(1, 10)}", b"other") == "another file is there"
    assert open(f"{root}/local/{seg(1, 10)}", "rb").read() == b"content 10"
    done = archive.apply_retention(spark, "vault:///store", 8, dry_run=False, schemes=schemes).where("action = 'delete'").collect()
    assert sorted((r.name, r.deleted, r.error) for r in done) == [(locked, False, "locked")] + [(seg(1, i), True, None) for i in (1, 2, 3)]
    assert sorted(r.name for r in archive.scan_segment_catalog(spark, "vault:///store", schemes).collect()) == [locked] + [seg(1, i) for i in range(4, 12)]
    assert archive.scan_segment_catalog(spark, f"{root}/nowhere").count() == 0
    with pytest.raises(OSError):
        storage.open_path("tape://reel/1")


@pytest.mark.parametrize("data,expected", [
    (b"hello world\n", [("hello world", False)]), (b"one\r\ntwo\r\n", [("one", False), ("two", False)]), (b"a\nno end", [("a", False), ("no end", False)]),
    (b"x" * 20 + b"\n", [("x" * 16, True)]), (b"x" * 16 + b"\n", [("x" * 16, True)]), (b"a\n" + b"x" * 16, [("a", False), ("x" * 16, False)]),
    (b"a\xffb\n\n", [("a�b", False), ("", False)]), (b"", []),
])
def test_log_lines(spark, tmp_path, data, expected):
    write(str(tmp_path / "log" / "f.log"), data)
    frames = telemetry.read_log_lines(spark, str(tmp_path / "log"), "stderr", "id", max_bytes=16)
    assert [(r.line, r.truncated) for r in frames.collect()] == expected


def test_metrics(spark, tmp_path):
    write(str(tmp_path / "b" / "before.prom"), b'# HELP x\n\ng_total{export="e1"} 5\ng_ratio 0.5\n')
    write(str(tmp_path / "a" / "after.prom"), b'g_total{export="e1",disk="x y"}   7\ng_total{export="e1"} 9\ng_ratio 0.25\nnew_total 3\n')
    before, after = (telemetry.read_metric_snapshots(spark, str(tmp_path / d)) for d in "ba")
    labels = {r.key: dict(r.labels) for r in after.collect()}
    assert labels['g_total{export="e1",disk="x y"}'] == {"export": "e1", "disk": "x y"} and labels["g_ratio"] == {}
    delta = {r.key: (r.before_v, r.after_v, r.delta) for r in joins.metric_delta(before, after).collect()}
    assert delta == {'g_total{export="e1"}': (5.0, 9.0, 4.0), "g_ratio": (0.5, 0.25, None), "new_total": (0.0, 3.0, 3.0),
                     'g_total{export="e1",disk="x y"}': (0.0, 7.0, 7.0)}


def test_flush_scoreboard_from_a_log(spark, tmp_path):
    write(str(tmp_path / "log" / "run1"), b"\x1b[32mINFO flush complete\x1b[0m packs_uploaded=2 bytes_uploaded=100 blocks_claimed=6 blocks_cross_deduped=1\n"
          b"INFO compaction done packs_uploaded=9\nINFO flush complete bytes_uploaded=50 packs_uploaded=x packs_uploaded=1=2\n")
    flush = telemetry.read_flush_log(spark, str(tmp_path / "log")).withColumn("run", F.lit("r"))
    guest = spark.createDataFrame([("r", 300, 10)], "run string, guest_bytes bigint, guest_ops bigint")
    row = aggregates.flush_scoreboard(flush, guest).first()
    assert (row.packs, row.s3_bytes, row.blocks, row.deduped, row.flushes) == (2, 150, 6, 1, 2)
    assert (row.write_amp, row.coalesce_ratio, row.pack_fill) == (0.5, 5.0, 3.0)
    alone = aggregates.flush_scoreboard(flush).first()
    assert (alone.write_amp, alone.coalesce_ratio) == (0.0, 0.0)


def test_bench_log(spark, tmp_path):
    write(str(tmp_path / "runs" / "a"), b"tps = 10.5\nx\ntps = 1 tps = 12.25 (excl)\n")
    write(str(tmp_path / "runs" / "b"), b"no result\n")
    got = {os.path.basename(r.run): r.tps for r in telemetry.read_bench_log(spark, str(tmp_path / "runs")).collect()}
    assert got == {"a": 12.25, "b": 0.0}


def test_stat_tables(spark, tmp_path):
    spark.createDataFrame([(1, "client backend", "active", "more")], "pid bigint, backend_type string, state string, query string").write.parquet(
        str(tmp_path / "pg_stat_activity"))
    tables = statistics.read_stat_tables(spark, {"path": str(tmp_path)}, ["activity"])
    assert tables["activity"].columns == ["pid", "backend_type", "state"] and tables["activity"].count() == 1


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_equals_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(4)
    vectors, wanted = rng.normal(size=(300, 8)), rng.normal(size=(9, 8))
    vectors[7] = vectors[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wanted)], "query_id bigint, query array<double>")
    if metric == "cosine":
        d = 1 - (wanted @ vectors.T) / np.outer(np.linalg.norm(wanted, axis=1), np.linalg.norm(vectors, axis=1))
    else:
        d = np.linalg.norm(wanted[:, None] - vectors[None], axis=2)
    want = {q: sorted((round(x, 9), i) for i, x in enumerate(d[q]))[:4] for q in range(9)}
    df = df.unionByName(spark.createDataFrame([(1000, None)], df.schema))
    queries = queries.unionByName(spark.createDataFrame([(1000, None)], queries.schema))
    monkeypatch.setattr(extras, "VECTORS_AT_ONCE", 70)
    for at_once in (4096, 9, 8, 3):
        monkeypatch.setattr(extras, "QUERIES_AT_ONCE", at_once)
        got = {}
        for r in extras.knn(df, queries, 4, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.distance, 9), r.vec_id))
        assert got == want
        assert extras.knn(df.limit(0), queries, 4, metric).collect() == []
    assert extras.knn(df, queries.limit(0), 4, metric).columns == ["query_id", "vec_id", "distance", "rank"]


def test_trigrams(spark):
    df = spark.createDataFrame([("word",), ("two words",), ("Word!",), (None,), ("zebra",)], "t string")
    got = {r.t: round(r.similarity, 6) for r in extras.trigram_similarity(df, "t", "word", 0.3).collect()}
    assert got == {"word": 1.0, "Word!": 1.0, "two words": 0.363636}


def trigrams_of(text):
    out = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        w = f"  {w} "
        out |= {w[i:i + 3] for i in range(len(w) - 2)}
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.75, 1.0])
def test_trigram_join_equals_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["north", "northern", "pier", "piers", "crane", "cranes", "hot", "hat", "x", "yz", "12", "123", "Straße"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["", None, "!?", "North  PIER", "north pier"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "a int, left_text string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(reversed(texts))], "b int, right_text string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.trigram_join(left, right, "left_text", "right_text", threshold).collect()}
    want = {}
    for i, x in enumerate(texts):
        for j, y in enumerate(reversed(texts)):
            p, q = trigrams_of(x), trigrams_of(y)
            if p and q and len(p & q) / len(p | q) >= threshold - 1e-9:
                want[i, j] = round(len(p & q) / len(p | q), 9)
    assert got == want and len(want) > 100
    assert similarity.similar_texts(left.select("left_text").limit(0), right.select("right_text")).count() == 0


def test_common_trigrams_meet_in_blocks(spark, monkeypatch):
    """Blocks of a few texts, and matrices of a few rows, find the pairs that whole groups find, each once."""
    monkeypatch.setattr(similarity, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(similarity, "ENTRIES_AT_ONCE", 40)
    texts = [f"ring {a}{b} {c}" for a in "abcd" for b in "efgh" for c in ("north", "south", "1", "\U0001d400\U0001d400x")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [tuple(r) for r in similarity.similar_texts(df, df.select(F.col("t").alias("u")), 0.4).collect()]
    sets = {t: trigrams_of(t) for t in texts}
    share = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert sorted(rows) == sorted((x, y, share(x, y)) for x in texts for y in texts if share(x, y) >= 0.4) and len(rows) > 1000


def test_texts_meet_only_under_rare_trigrams(spark):
    """A trigram that all texts share is in no prefix: texts with nothing else in common never meet."""
    texts = [f"the {c * 3}{d * 3}" for c in "abcdefgh" for d in "ijklmnop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sets = similarity._ranked_sets(df.select(F.col("t").alias("text"), F.lit("l").alias("side"), extras.trigrams(F.col("t")).alias("grams")), 0.8)
    rows = sets.collect()
    assert all(set(r.grams) == trigrams_of(r.text) and not {"  t", " th", "the", "he "} & set(r.grams[:r.prefix]) for r in rows)
    with pytest.raises(ValueError):
        similarity.similar_texts(df, df, 0)


def test_slow_statements(spark):
    head = "2024-01-01 00:00:00.000 UTC [1] [a] db=d,user=u,client=h LOG:  duration: %s ms  statement: %s"
    lines = [head % ("1500.0", "SELECT *  FROM t WHERE a = 'x''y' AND b=10"), head % ("2500.5", "SELECT * FROM t WHERE a = 'z' AND b=7.5"),
             head % ("999.9", "SELECT 1"), "2024-01-01 00:00:00.000 UTC [1] LOG:  checkpoint"]
    rows = extras.slow_queries(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in rows] == [("SELECT * FROM t WHERE a = ? AND b=?", 2, 4000.5, 2000.25, 2500.5)]


def test_partitions(spark, tmp_path):
    df = spark.sql("SELECT to_timestamp(d) AS ts FROM VALUES ('2024-01-05'), ('2024-01-09'), ('2024-04-01') AS t(d)")
    rows = extras.partition_report(df, "ts", "month", retain=2).orderBy("part_start").collect()
    assert [(r.rows, r.gap_before, r.expired) for r in rows] == [(2, 0, True), (1, 2, False)]
    extras.write_partitioned(df, str(tmp_path / "p"), "ts")
    assert extras.drop_expired(extras.partition_report(df, "ts", "month", retain=2)) == ["part=2024-01-01-00"]
    assert sorted(n for n in os.listdir(tmp_path / "p") if n.startswith("part=")) == ["part=2024-01-01-00", "part=2024-04-01-00"]
