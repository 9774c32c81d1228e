import random
import time

import pytest
from pyspark.sql import functions as F

from test_events import EVENT, TYPES, as_dict, insert, relation, replay, update
from tidemark.operators import advice, aggregates, ratelimit
from tidemark.operators import history
from tidemark.plans import inputs
from tidemark.sources import events as event_io
from tidemark.streaming import capture, live, monitor, retention, stateful

SEG = 16 << 20


def parts(df, path, n, order):
    """The rows as n files of rising order, one stream batch each."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, path, mode="append"):
    """Run a stream to its end and give the rows it put out, with their batch."""
    def keep(batch, batch_id):
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("append").parquet(path + "/rows")

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path + "/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(path + "/rows")


def test_capture_knows_relations_of_earlier_batches(spark, tmp_path):
    frames = [(0, relation(5, "s", "t", [("a", 23)])), (10, insert(5, ["1"])), (20, insert(5, ["2"])), (0, relation(5, "s", "t", [("a", 23), ("b", 25)])),
              (30, update(5, b"", [], ["2", "x"])), (40, insert(6, ["3"]))]
    df = spark.createDataFrame([(i, lsn, d) for i, (lsn, d) in enumerate(frames)], capture.FRAME_SCHEMA)
    base = str(tmp_path)
    parts(df, f"{base}/in", 3, ["seq"])
    seen = []
    progress = lambda batch, batch_id: (capture.confirm(batch, batch_id, f"{base}/progress", "one"), seen.append(batch_id))
    capture.change_stream(stream(spark, f"{base}/in", capture.FRAME_SCHEMA), f"{base}/out", f"{base}/cp", also=progress).awaitTermination()
    events = spark.read.parquet(f"{base}/out/events").orderBy("seq").collect()
    assert [(r.lsn, r.op, dict(r.new)) for r in events] == [(10, "insert", {"a": "1"}), (20, "insert", {"a": "2"}), (30, "update", {"a": "2", "b": "x"})]
    assert [r.reject for r in spark.read.parquet(f"{base}/out/rejects").collect()] == ["unknown relation"]
    row = capture.progress_table(spark, f"{base}/progress").first()
    assert (row.lsn, row.events, seen) == (30, 3, [0, 1, 2])
    # nothing is delivered again after a restart
    capture.change_stream(stream(spark, f"{base}/in", capture.FRAME_SCHEMA), f"{base}/out", f"{base}/cp", also=progress).awaitTermination()
    assert seen == [0, 1, 2]


def test_fan_out_isolates_a_failing_sink(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, i, "insert", "public", "t", None, {"id": str(i)}, TYPES) for i in range(6)]
    df = spark.createDataFrame(rows, EVENT)
    parts(df, f"{base}/in", 2, ["seq"])

    def broken(batch, batch_id):
        raise RuntimeError("sink is down")

    sinks = {"good": capture.confirmed(capture.json_sink(f"{base}/good"), f"{base}/progress", "good"), "bad": broken}
    running = capture.fan_out(lambda: stream(spark, f"{base}/in", EVENT), sinks, f"{base}/cp")
    running["good"].awaitTermination()
    with pytest.raises(Exception, match="sink is down"):
        running["bad"].awaitTermination()
    assert event_io.read_change_events(spark, f"{base}/good").count() == 6
    assert capture.progress_table(spark, f"{base}/progress").first().lsn == 5


def test_fan_out_goes_on_after_a_restart(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(i, i * 10, "insert", "public", "t", None, {"id": str(i)}, TYPES) for i in range(9)], EVENT)
    parts(df, f"{base}/in", 3, ["seq"])
    down, taken = {"b"}, {"a": {}, "b": {}}

    def sink(name):
        def write(batch, batch_id):
            rows = sorted(r.seq for r in batch.collect())
            if name in down and batch_id == 1:
                raise RuntimeError("sink is down")
            assert batch.count() == len(rows)
            taken[name][batch_id] = rows
        return write

    watch = monitor.StreamMonitor(spark, f"{base}/seen")
    spark.streams.addListener(watch)
    try:
        for again in (False, True):
            running = capture.fan_out(lambda: stream(spark, f"{base}/in", EVENT), {"a": sink("a"), "b": sink("b")}, f"{base}/cp")
            running["a"].awaitTermination()
            if again:
                running["b"].awaitTermination()
            else:
                with pytest.raises(Exception, match="sink is down"):
                    running["b"].awaitTermination()
                assert len(taken["a"]) == 3 and list(taken["b"]) == [0]
            down.clear()
            watch.settle()
    finally:
        spark.streams.removeListener(watch)
    assert taken["a"] == taken["b"] and sorted(sum(taken["b"].values(), [])) == list(range(9))
    seen = {r.consumer: (r.starts, r.running, r.batch, r.events, r.lsn) for r in watch.consumers().collect()}
    assert seen == {"a": (2, False, 2, 9, 80), "b": (2, False, 2, 9, 80)}
    # the files tell the same, and a new monitor goes on from them
    assert sorted(map(tuple, monitor.progress_of(spark, f"{base}/seen").collect())) == sorted(map(tuple, watch.consumers().collect()))
    assert sorted(map(tuple, monitor.StreamMonitor(spark, f"{base}/seen").consumers().collect())) == sorted(map(tuple, watch.consumers().collect()))
    runs, nobody = spark.range(3), spark.range(0)
    assert aggregates.running_stats(watch.consumers()).first().asDict() == aggregates.stream_stats(df, runs, nobody).first().asDict()
    assert aggregates.running_stats(watch.consumers().limit(0)).first().last_flush_lsn == "0/00000000"


def moving_steps(seed=8, moves=0.3):
    rng = random.Random(seed)
    steps, live = [], {}
    for i in range(90):
        key = str(rng.randint(1, 6))
        if key not in live:
            live[key] = row = {"id": key, "a": str(i), "b": f"b{i}"}
            steps.append((i, "insert", None, row))
        elif rng.random() < 0.2:
            live.pop(key)
            steps.append((i, "delete", {"id": key}, None))
        elif rng.random() < moves and (free := [str(k) for k in range(1, 7) if str(k) not in live]):
            new = {"id": free[0], "a": str(i)}
            steps.append((i, "update", {"id": key, "a": None, "b": None}, new))
            live[free[0]] = {**live.pop(key), **new}
        else:
            new = {"id": key, "a": str(i)}
            steps.append((i, "update", None, new))
            live[key] = {**live[key], **new}
    return steps


def step_events(spark, steps):
    return spark.createDataFrame([(i, lsn, op, "public", "t", old, new, TYPES) for i, (lsn, op, old, new) in enumerate(steps)], EVENT)


def test_live_table_equals_replay(spark, tmp_path):
    steps = moving_steps()
    df, base = step_events(spark, steps), str(tmp_path)
    parts(df, f"{base}/in", 3, ["seq"])
    live.live_table(stream(spark, f"{base}/in", EVENT), f"{base}/live", ["id"], f"{base}/cp", buckets=3, fanout=2, keep=2).awaitTermination()
    table = live.LiveTable(spark, f"{base}/live", ["id"], keep=2)
    assert as_dict(table.read()) == replay(steps) == as_dict(history.table_as_of(df, ["id"]))
    # three batches at two parts a level: two in one part, one in another; options are those of the first batch
    now = table.manifest()
    assert [(p["level"], p["first"], p["last"]) for p in now["parts"]] == [(1, 0, 1), (0, 2, 2)] and (now["buckets"], now["fanout"]) == (3, 2)
    # only the kept versions and their parts are there
    assert len(table.versions()) == 2
    listed = {"part=" + p["name"] for v in table.versions() for p in table.manifest(v)["parts"]}
    assert set(table._names("parts")) == listed
    # a batch that is run again changes nothing
    table.apply(df.where("seq >= 60"), 2)
    assert table.manifest() == now
    # a lookup reads the buckets of its keys
    some = spark.createDataFrame([("3",), ("5",), ("no such key",)], "id string")
    assert as_dict(table.lookup(some)) == {k: v for k, v in replay(steps).items() if k in ("3", "5")}
    plan = table.lookup(some.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_live_table_of_one_version(spark, tmp_path):
    steps = moving_steps(3, moves=0)
    df, path = step_events(spark, steps), str(tmp_path / "live")
    table = live.LiveTable(spark, path, ["id"])
    with pytest.raises(FileNotFoundError):
        table.read()
    table.apply(df.where("seq < 40"), 0)
    table.apply(df.where("false"), 1)
    table.apply(df.where("seq >= 40"), 2)
    before = table.read()
    table.compact()
    assert len(table.manifest()["parts"]) == 1
    # what was opened before the fold still reads, older versions too, and a late writer is refused
    assert as_dict(before) == as_dict(table.read()) == replay(steps)
    assert as_dict(table.read(version=1)) == replay(steps[:40])
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(table.manifest(1), [], 9)
    assert as_dict(table.read()) == replay(steps)
    # a part without a manifest is that of a failed attempt: never read, removed later
    table._write(history.fold_cells(df, ["id"]), 0, 3, 3, 16)
    assert as_dict(table.read()) == replay(steps)
    table.vacuum()
    assert len(table._names("parts")) == 4


def test_segments_assemble_like_the_batch(spark, tmp_path):
    rng = random.Random(2)
    cuts = sorted(rng.sample(range(0, 3 * SEG), 20))
    chunks = [(1, a, b - a) for a, b in zip([0, *cuts], [*cuts, 3 * SEG + 50]) if b > a]
    late = chunks.pop(5)
    chunks += [late, chunks[0], (2, SEG - 100, 200)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(chunks)], "seq bigint, timeline int, start_lsn bigint, n_bytes bigint")
    base = str(tmp_path)
    parts(df, f"{base}/in", 4, ["seq"])
    out = drain(stateful.assemble_segments(stream(spark, f"{base}/in", df.schema)), base, "update")
    newest = out.groupBy("timeline", "seg_no").agg(F.max_by(F.struct("bytes", "sealed", "covered", "name"), "batch_no").alias("s")).select("timeline", "seg_no", "s.*")
    batch = aggregates.segment_coverage(df).where("sealed").select("timeline", "seg_no", "bytes", "sealed", "covered", "name")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, batch.collect()))


def test_neighbouring_segments_share_a_state(spark, tmp_path):
    """600 segments, open and covered ones, are three rows of the store and not one each."""
    base = str(tmp_path)
    df = spark.range(600).select(F.lit(1).alias("timeline"), (F.col("id") * SEG + F.col("id") % 2).alias("start_lsn"), (F.lit(SEG) - F.col("id") % 2).alias("n_bytes"))
    parts(df, f"{base}/in", 2, ["start_lsn"])
    rows = []
    query = (stateful.assemble_segments(stream(spark, f"{base}/in", df.schema)).writeStream.outputMode("update")
             .foreachBatch(lambda b, i: rows.extend(map(tuple, b.drop("expired", "name").collect())))
             .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(rows) == [(1, n, SEG - n % 2, True, n % 2 == 0) for n in range(600)]
    assert [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress][-1] == 3


def test_batches_of_a_stream_hold_files_by_size(spark, tmp_path, monkeypatch):
    """A batch is as many files as its size asks for, each a range of the order; no row is lost."""
    rows = spark.range(30000).select(F.col("id").alias("seq"), F.md5(F.col("id").cast("string")).alias("value"))

    def taken(name):
        monkeypatch.setattr(inputs, "scratch_path", lambda spark, label: str(tmp_path / name / label))
        source, sizes = inputs.in_batches(rows, 3, "seq"), []
        query = (source.writeStream.foreachBatch(lambda b, i: sizes.append(b.count()))
                 .option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        assert len(sizes) == 3 and sum(sizes) == 30000
        return [spark.read.parquet(str(f)).agg(F.min("seq"), F.max("seq")).first() for f in (tmp_path / name / "arrivals").glob("*.parquet")]

    assert len(taken("few")) == 3
    monkeypatch.setattr(inputs, "ARRIVAL_BYTES", 100000)
    many = sorted(taken("many"))
    assert len(many) >= 9 and all(a[1] < b[0] for a, b in zip(many, many[1:]))


def test_segments_leave_the_store(spark, tmp_path):
    base = str(tmp_path)
    chunks = [(1, 0, SEG), (1, SEG, 500), (1, SEG, 500), (1, 0, 10), (1, SEG - 1, 1), (2, 3 * SEG - 5, 5)]
    df = spark.createDataFrame(chunks, "timeline int, start_lsn bigint, n_bytes bigint")
    df.coalesce(1).write.parquet(f"{base}/in")
    rows = []
    whole = stateful.assemble_segments(stream(spark, f"{base}/in", df.schema), settle_seconds=4, give_up_seconds=4)
    query = (whole.writeStream.outputMode("update").foreachBatch(lambda b, i: rows.extend(map(tuple, b.collect())))
             .option("checkpointLocation", f"{base}/cp").trigger(processingTime="500 milliseconds").start())
    state = lambda p: sum(o["numRowsTotal"] for o in p["stateOperators"])
    sizes, deadline = [], time.time() + 90
    try:
        while time.time() < deadline and (len(rows) < 4 or not sizes or sizes[-1]):
            time.sleep(0.3)
            assert query.exception() is None
            sizes = [state(p) for p in query.recentProgress]
    finally:
        query.stop()
    assert max(sizes) > 0 and sizes[-1] == 0
    name = lambda t, n: f"{t:08X}{0:08X}{n:08X}"
    assert sorted(rows) == [(1, 0, SEG, True, True, False, name(1, 0)), (1, 1, 500, False, False, True, name(1, 1)),
                            (2, 2, 5, True, False, False, name(2, 2)), (2, 2, 5, True, False, True, name(2, 2))]


def test_rules_stream_like_the_batch(spark, tmp_path):
    base = str(tmp_path)
    lines = spark.range(900).select((F.col("id") % 2).cast("string").alias("stream"), F.col("id").alias("seq"), (F.col("id") * 300).alias("at_us"))
    parts(lines, f"{base}/lines", 3, ["seq"])
    out = drain(stateful.rate_limit_stream(stream(spark, f"{base}/lines", lines.schema), 500, 50), f"{base}/o1")
    columns = ["stream", "seq", "passed", "notice"]
    want = ratelimit.rate_limit(lines, 500, 50).select(*columns).collect()
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, want)) and any(r.notice for r in want)

    ticks = spark.range(60).select(F.lit(1).alias("host"), F.col("id").alias("tick"), (F.col("id") * 5).alias("at_s"), F.lit(2).cast("bigint").alias("live"),
                                   F.when(F.col("id") > 0, F.when(F.col("id") < 20, 1.8).otherwise(0.3)).alias("cores"))
    parts(ticks, f"{base}/ticks", 3, ["tick"])
    out = drain(stateful.scale_decision_stream(stream(spark, f"{base}/ticks", ticks.schema), 4), f"{base}/o2").orderBy("tick").collect()
    whole, _ = advice.scale_rule(ticks.orderBy("tick").toPandas(), None, 4)
    assert [r.action for r in out] == whole["action"] and {"up", "down"} <= set(whole["action"])

    memory = spark.range(100).select(F.lit("h").alias("host"), F.col("id").alias("seq"), (F.col("id") * 5).alias("at_s"),
                                     (F.when(F.col("id") < 30, 735).otherwise(2016) * 1048576).cast("bigint").alias("ram_bytes"))
    parts(memory, f"{base}/mem", 2, ["seq"])
    out = drain(stateful.retune_advice_stream(stream(spark, f"{base}/mem", memory.schema)), f"{base}/o3").orderBy("seq").collect()
    want = advice.retune_advice(memory).orderBy("seq").collect()
    assert [(r.reload, r.restart, r.buffers_to_mb) for r in out] == [(r.reload, r.restart, r.buffers_to_mb) for r in want]
    assert [r.seq for r in want if r.restart] == [48]


def test_timers(spark, tmp_path):
    base = str(tmp_path)
    samples = spark.createDataFrame([("h", 1, 1.0, 0.5, 10), ("h", 2, 1.0, 0.5, 25), ("h", 3, 1.0, 0.5, None)], "host string, s int, some_avg10 double, full_avg10 double, refaults bigint")
    samples = samples.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    samples.coalesce(1).write.parquet(f"{base}/in")
    beats, pressure = [], []
    feed = stateful.pressure_stream(spark.readStream.schema(samples.schema).parquet(f"{base}/in"), 2)
    idle = stateful.heartbeat_stream(spark.readStream.schema(samples.schema).parquet(f"{base}/in"), "host", 2)
    queries = [
        feed.writeStream.foreachBatch(lambda b, i: pressure.extend(map(tuple, b.select("host", "refaults_increase", "disconnected").collect())))
        .option("checkpointLocation", f"{base}/c1").trigger(processingTime="500 milliseconds").start(),
        idle.writeStream.foreachBatch(lambda b, i: beats.extend(map(tuple, b.collect())))
        .option("checkpointLocation", f"{base}/c2").trigger(processingTime="500 milliseconds").start(),
    ]
    deadline = time.time() + 90
    while time.time() < deadline and (len(beats) < 2 or len(pressure) < 4):
        time.sleep(0.5)
    for q in queries:
        q.stop()
    assert pressure == [("h", None, False), ("h", 15, False), ("h", None, False), ("h", None, True)]
    assert len(beats) >= 2 and beats[1][1] - beats[0][1] == 2000 and beats[0][0] == "h"


def test_retention_job(spark, tmp_path):
    base = str(tmp_path)
    names = [f"{1:08X}{0:08X}{i:08X}" for i in range(11)]
    for d in ("archive", "arrivals"):
        (tmp_path / d).mkdir()
    for n in names:
        (tmp_path / "archive" / n).write_bytes(b"x")
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(f"{base}/arrivals")
    arrivals = spark.readStream.schema("name string").parquet(f"{base}/arrivals")
    retention.retention_job(arrivals, f"{base}/archive", 8, f"{base}/c1", f"{base}/r1").awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(f"{base}/r1").collect()) == names[:3] and len(list((tmp_path / "archive").iterdir())) == 11
    retention.retention_job(arrivals, f"{base}/archive", 8, f"{base}/c2", f"{base}/r2", dry_run=False).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "archive").iterdir()) == names[3:]
