import datetime
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import typed_view
from tidemark.operators import filters, history, joins
from tidemark.sources import events as event_io
from tidemark.sources import frames as frame_io


def relation(oid, schema, table, columns):
    out = b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0d" + struct.pack(">H", len(columns))
    for name, type_oid in columns:
        out += b"\0" + name.encode() + b"\0" + struct.pack(">Ii", type_oid, -1)
    return out


def cells(values):
    out = struct.pack(">H", len(values))
    for v in values:
        if v is None:
            out += b"n"
        elif v == "<unchanged>":
            out += b"u"
        else:
            out += b"t" + struct.pack(">i", len(v.encode())) + v.encode()
    return out


def insert(oid, values):
    return b"I" + struct.pack(">I", oid) + b"N" + cells(values)


def update(oid, marker, old, new):
    before = marker + cells(old) if marker else b""
    return b"U" + struct.pack(">I", oid) + before + b"N" + cells(new)


def delete(oid, marker, old):
    return b"D" + struct.pack(">I", oid) + marker + cells(old)


def decode(spark, frames):
    rows = [(i, lsn, data) for i, (lsn, data) in enumerate(frames)]
    df = spark.createDataFrame(rows, "seq bigint, lsn bigint, data binary")
    events = frame_io.decode_pgoutput(df)
    return [json.loads(r.value) for r in event_io.events_as_json(events).orderBy("lsn").collect()]


def test_messages_of_every_kind(spark):
    out = decode(spark, [
        (0, relation(301, "port", "berths", [("no", 21), ("name", 25), ("depth", 700)])),
        (0, relation(302, "port", "calls", [("call", 20), ("note", 25)])),
        (0, relation(303, "yard", "cranes", [("crane", 23), ("up", 16), ("load", 701), ("cost", 1700)])),
        (0x2A0C0FFEE0, insert(301, ["12", "north pier", "8.5"])),
        (10, insert(302, ["900000000000", None])),
        (20, insert(303, ["4", "f", "-0.625", "1200.500"])),
        (30, update(302, b"O", ["900000000000", None], ["900000000000", "late"])),
        (40, update(301, b"K", ["12", "<unchanged>", "<unchanged>"], ["13", "<unchanged>", "9.25"])),
        (50, update(303, b"", [], ["4", "t", "<unchanged>", "<unchanged>"])),
        (60, delete(302, b"O", ["900000000000", "late"])),
        (70, delete(303, b"K", ["4", None, None, None])),
    ])
    calls = {"schema": "port", "table": "calls"}
    cranes = {"schema": "yard", "table": "cranes"}
    assert out == [
        {"lsn": "0/0000000A", "op": "insert", **calls, "new": {"call": 900000000000, "note": None}},
        {"lsn": "0/00000014", "op": "insert", **cranes, "new": {"crane": 4, "up": False, "load": -0.625, "cost": "1200.500"}},
        {"lsn": "0/0000001E", "op": "update", **calls, "old": {"call": 900000000000, "note": None}, "new": {"call": 900000000000, "note": "late"}},
        {"lsn": "0/00000028", "op": "update", "schema": "port", "table": "berths", "old": {"no": 12}, "new": {"no": 13, "depth": 9.25}},
        {"lsn": "0/00000032", "op": "update", **cranes, "new": {"crane": 4, "up": True}},
        {"lsn": "0/0000003C", "op": "delete", **calls, "old": {"call": 900000000000, "note": "late"}},
        {"lsn": "0/00000046", "op": "delete", **cranes, "old": {"crane": 4, "up": None, "load": None, "cost": None}},
        {"lsn": "2A/0C0FFEE0", "op": "insert", "schema": "port", "table": "berths", "new": {"no": 12, "name": "north pier", "depth": 8.5}},
    ]


@pytest.mark.parametrize("data", [
    b"", b"B" + b"\0" * 20, b"C" + b"\0" * 12, b"T\0\0\0\1", b"Y", b"O", b"M", b"I", b"I\0\0\0\x0a", b"I\0\0\0\x0aN\0\1t\0\0\0\x09abc",
    b"I\0\0\0\x0aN\0\1t\xff\xff\xff\xff", b"I\0\0\0\x0aN\0\1x", b"U\0\0\0\x0aX\0\0", b"D\0\0\0\x0aN\0\1t\0\0\0\x011",
    b"U\0\0\0\x0aK\0\1t\0\0\0\x011X", b"I\0\0\0\x0aN\0\1t\0\0\0\x01\xff",
])
def test_messages_without_an_event(spark, data):
    assert decode(spark, [(0, relation(10, "public", "t", [("id", 23)])), (1, data)]) == []


def test_relations_follow_arrival_and_rejects_say_why(spark):
    frames = [
        (0, insert(5, ["1"])), (50, relation(5, "s", "t", [("a", 23)])), (10, insert(5, ["2"])),
        (0, relation(5, "s", "t", [("a", 23), ("b", 25)])), (20, insert(5, ["3", "x"])), (21, insert(5, ["4"])), (22, insert(6, ["5"])),
    ]
    df = spark.createDataFrame([(i, lsn, d) for i, (lsn, d) in enumerate(frames)], "seq bigint, lsn bigint, data binary")
    resolved = frame_io.resolve_events(frame_io.dml_messages(df), frame_io.relation_messages(df))
    good, bad = filters.split_rejects(resolved)
    assert [(r.seq, dict(r.new)) for r in good.orderBy("seq").collect()] == [(2, {"a": "2"}), (4, {"a": "3", "b": "x"})]
    assert [(r.seq, r.reject) for r in bad.orderBy("seq").collect()] == [(0, "unknown relation"), (5, "column count mismatch"), (6, "unknown relation")]


def bracket(tag, ts=0, xid=0):
    return b"B" + struct.pack(">QqI", 0, ts, xid) if tag == "B" else b"C" + struct.pack(">bQQq", 0, 0, 0, ts)


@pytest.mark.parametrize("blocks", [1, 4])
def test_transactions(spark, blocks):
    """Closed, never closed and empty transactions, changes outside of any, and brackets of the wrong length."""
    table = relation(7, "port", "berths", [("no", 23)])
    log_a = [table, insert(7, ["1"]), bracket("B", 5, 70), insert(7, ["2"]), insert(7, ["3"]), bracket("C", 9), insert(7, ["4"]),
             bracket("B", 11, 71), insert(7, ["5"]), bracket("B", 20, 72), bracket("C", 20), bracket("B", 30, 73), b"B\0", insert(7, ["6"]), bracket("C", 31),
             bracket("B", 40, 74), insert(7, ["7"])]
    frames = spark.createDataFrame([("a", i, i, d) for i, d in enumerate(log_a)] + [("b", i + 1, i, d) for i, d in enumerate(log_a[:4])],
                                   "source string, seq bigint, lsn bigint, data binary")
    one = frames.where("source = 'a'").drop("source")
    got = frame_io.with_transactions(frame_io.decode_pgoutput(one), one, blocks=blocks).orderBy("seq").collect()
    epoch = datetime.datetime(2000, 1, 1)
    assert [(r.new["no"], r.xid, r.bracket, r.commit_ts and (r.commit_ts - epoch).microseconds) for r in got] == [
        ("1", None, "outside", None), ("2", 70, "committed", 9), ("3", 70, "committed", 9), ("4", None, "outside", None), ("5", 71, "open", None),
        ("6", 73, "committed", 31), ("7", 74, "open", None)]
    assert [r.new["no"] for r in frame_io.committed_events(one, blocks=blocks).orderBy("seq").collect()] == ["2", "3", "6"]
    marks = frame_io.transaction_brackets(frames, ["source"], blocks).where("kind = 'B'").collect()
    assert sorted((r.source, r.xid, r.committed) for r in marks) == [
        ("a", 70, True), ("a", 71, False), ("a", 72, True), ("a", 73, True), ("a", 74, False), ("b", 70, False)]


def test_transactions_are_cut_by_the_size_of_events(spark, monkeypatch):
    """Decoded events are wide, so their scan takes smaller blocks than others do; the rows are the same."""
    table = relation(7, "port", "berths", [("no", 23)])
    log = [table] + [f for n in range(60) for f in (bracket("B", n, n), insert(7, [str(n)]), insert(7, [f"-{n}"]), *([bracket("C", n + 1)] if n % 7 else []))]
    base = spark.createDataFrame([(i, i, d) for i, d in enumerate(log)], "seq bigint, lsn bigint, data binary")
    one = frame_io.stored_copy(base, "frames")
    whole, seen, plain = frame_io.with_transactions(frame_io.decode_pgoutput(one), one, blocks=1), [], frame_io.running
    monkeypatch.setattr(frame_io, "EVENT_BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(frame_io, "running", lambda *a: seen.append(a[-1]) or plain(*a))
    cut = frame_io.with_transactions(frame_io.decode_pgoutput(one), one)
    columns = ["seq", "xid", "commit_ts", "bracket"]
    rows = [sorted(map(tuple, d.select(*columns).collect()), key=str) for d in (whole, cut)]
    assert seen[0] > 1 and rows[0] == rows[1] and len(rows[0]) == 120 and {r[3] for r in rows[0]} == {"committed", "open"}


def test_malformed_messages_are_rejected_with_a_reason(spark):
    frames = [relation(5, "s", "t", [("a", 23)]), insert(5, ["1"]), insert(5, ["1"])[:-3], b"D\0\0\0\x05N\0\0", b"U", insert(5, [b"x".decode()])]
    df = spark.createDataFrame([(i, i, d) for i, d in enumerate(frames)], "seq bigint, lsn bigint, data binary")
    good, bad = filters.split_rejects(frame_io.resolve_events(frame_io.dml_messages(df), frame_io.relation_messages(df)))
    assert [r.seq for r in good.orderBy("seq").collect()] == [1, 5]
    assert [(r.seq, r.reject.split(":")[0]) for r in bad.orderBy("seq").collect()] == [(2, "malformed"), (3, "malformed"), (4, "malformed")]


@pytest.mark.parametrize("blocks", [1, 6])
def test_many_versions_of_a_relation(spark, blocks):
    """Ten thousand versions: as the range join says, and no change meets more than its own version."""
    relations = [(1, 3 * i, "s", "t", [f"c{i % 10_000 // 2}"]) for i in range(10_000)] + [(2, 50, "s", "u", ["x"])]
    changes = [(1 if i % 4 else 2, 2 * i, f"v{i}") for i in range(15_000)] + [(9, 1, "nobody")]
    r = spark.createDataFrame(relations, "rel_oid bigint, seq bigint, `schema` string, `table` string, columns array<string>").cache()
    d = spark.createDataFrame(changes, "rel_oid bigint, seq bigint, v string").cache()
    for unknown in (False, True):
        got = {x.v: (x.table, x.columns) for x in joins.resolve_relations(d, r, unknown, blocks=blocks).collect()}
        want = {}
        for oid, seq, v in changes:
            if oid == 1:
                want[v] = ("t", [f"c{seq // 3 // 2}"])
            elif oid == 2 and seq >= 50:
                want[v] = ("u", ["x"])
            elif unknown:
                want[v] = (None, None)
        assert got == want
    assert joins.descriptor_versions(r).where("rel_oid = 1").count() == 5000
    few = r.where("seq < 40")
    assert sorted(map(str, joins.resolve_relations(d, few, few=99).collect())) == sorted(map(str, joins.resolve_relations(d, few, few=0, blocks=blocks).collect()))


def test_events_keep_what_a_table_is_rebuilt_from(spark, tmp_path):
    ts = datetime.datetime(2024, 2, 3, 4, 5, 6, 789012)
    rows = [(7, 100, ts, "insert", "s", name, None, {"id": "1", "a": None}, {"id": 23, "a": 25}) for name in ("t", "u")]
    events = spark.createDataFrame(rows, "seq bigint, lsn bigint, commit_ts timestamp, op string, `schema` string, `table` string, old map<string,string>, "
                                         "new map<string,string>, types map<string,int>")
    event_io.write_change_events(events, str(tmp_path / "lake"), rebuildable=True)
    back = event_io.read_change_events(spark, str(tmp_path / "lake"), tables=[("s", "u")])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "in_table" in plan.split("PartitionFilters")[1][:200]
    assert [tuple(r[c] for c in events.columns) for r in back.collect()] == [rows[1]]
    event_io.write_change_events(events.drop("commit_ts"), str(tmp_path / "plain"))
    plain = event_io.read_change_events(spark, str(tmp_path / "plain")).collect()
    assert {(r.seq, r.commit_ts, r.types) for r in plain} == {(100, None, None)} and len(plain) == 2
    flat = spark.createDataFrame([('{"lsn":"0/9","op":"insert","schema":"s","table":"t","new":{"id":1}}',), ('{"lsn":"0/A","op":"insert","schema":"s","table":"x","new":{"id":1}}',)], "value string")
    flat.write.text(str(tmp_path / "flat"))
    assert [r.lsn for r in event_io.read_change_events(spark, str(tmp_path / "flat"), tables=[("s", "t")]).collect()] == [9]


def test_redelivery_in_a_stream_equals_the_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 10 * (i // 2), start + datetime.timedelta(seconds=i // 2), "insert", "s", "t", None, {"id": str(i)}, {"id": 23}) for i in range(60)]
    schema = "seq bigint, lsn bigint, commit_ts timestamp, op string, `schema` string, `table` string, old map<string,string>, new map<string,string>, types map<string,int>"
    sent = [rows[:30], rows[20:50], rows[25:]]
    for i, part in enumerate(sent):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = history.dedupe_replay(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r.new["id"] for r in batch.collect()) == sorted(str(i) for i in range(60))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        history.dedupe_replay(stream)
    query = (history.dedupe_replay(stream, ["id"], delay="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, out)) == sorted(map(str, batch.collect()))
    # state: only what is within the delay of the newest commit time
    late = spark.createDataFrame([(99, 990, start + datetime.timedelta(hours=1), "insert", "s", "t", None, {"id": "99"}, {"id": 23})], schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = (history.dedupe_replay(stream, ["id"], delay="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert states[-1] == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 61


EVENT = "seq bigint, lsn bigint, op string, `schema` string, `table` string, old map<string,string>, new map<string,string>, types map<string,int>"
TYPES = {"id": 23, "a": 25, "b": 25}


def log(spark, steps):
    rows = [(i, lsn, op, "public", "t", old, new, TYPES) for i, (lsn, op, old, new) in enumerate(steps)]
    return spark.createDataFrame(rows, EVENT)


def replay(steps, until=None):
    """Row by row, as a check of the aggregated form."""
    table, ordered = {}, sorted(enumerate(steps), key=lambda s: (s[1][0], s[0]))
    for _, (lsn, op, old, new) in ordered:
        if until is not None and lsn > until:
            continue
        if op == "insert":
            table[new["id"]] = dict(new)
        elif op == "delete":
            table.pop(old["id"], None)
        else:
            start = old["id"] if old and "id" in old else new["id"]
            row = table.pop(start, {})
            table[new["id"]] = {**row, **new}
    return table


def as_dict(df):
    return {r["id"]: dict(r["image"]) for r in df.collect()}


def test_as_of_semantics(spark):
    steps = [
        (10, "insert", None, {"id": "1", "a": "x", "b": "big"}), (20, "update", None, {"id": "1", "a": None}),
        (30, "insert", None, {"id": "2", "a": "y", "b": "old"}), (40, "delete", {"id": "2"}, None), (50, "insert", None, {"id": "2", "a": "z"}),
        (60, "update", None, {"id": "3", "a": "mid"}), (70, "delete", {"id": "1"}, None), (70, "insert", None, {"id": "1", "a": "again"}),
    ]
    df = log(spark, steps)
    assert as_dict(history.table_as_of(df, ["id"])) == {"1": {"id": "1", "a": "again"}, "2": {"id": "2", "a": "z"}, "3": {"id": "3", "a": "mid"}}
    assert as_dict(history.table_as_of(df, ["id"], until_lsn=20)) == {"1": {"id": "1", "a": None, "b": "big"}}
    complete = {r["id"]: r["complete"] for r in history.table_as_of(df, ["id"]).collect()}
    assert complete == {"1": True, "2": True, "3": False}
    columns = history.table_as_of(df, ["id"], until_lsn=60, columns=["id", "a", "b"]).orderBy("id").collect()
    assert [tuple(r) for r in columns] == [("1", None, "big", True), ("2", "z", None, True), ("3", "mid", None, False)]


def test_moves_carry_cells_through_a_chain(spark):
    steps = [
        (10, "insert", None, {"id": "1", "a": "x", "b": "big"}), (15, "insert", None, {"id": "9", "a": "n", "b": "other"}),
        (20, "update", {"id": "1", "a": None, "b": None}, {"id": "2", "a": "y"}), (30, "update", {"id": "2", "a": None, "b": None}, {"id": "3", "a": "z"}),
        (40, "insert", None, {"id": "1", "a": "new"}), (50, "update", {"id": "9", "a": "n", "b": "other"}, {"id": "8", "a": "m"}),
        (60, "update", {"id": "1"}, {"id": "7", "a": "q"}),
    ]
    want = {"3": {"id": "3", "a": "z", "b": "big"}, "8": {"id": "8", "a": "m", "b": "other"}, "7": {"id": "7", "a": "q"}}
    assert as_dict(history.table_as_of(log(spark, steps), ["id"])) == want == replay(steps)


@pytest.mark.parametrize("seed,wide", [(1, 200), (2, 2)])
def test_as_of_equals_replay(spark, seed, wide, monkeypatch):
    # with fewer columns allowed than the table has, the log is folded cell by cell
    monkeypatch.setattr(history, "WIDE_TABLE", wide)
    rng = random.Random(seed)
    steps, live, hot = [], {}, "1"
    for i in range(250):
        key = hot if rng.random() < 0.4 else str(rng.randint(1, 12))
        lsn = i // 2
        if key not in live:
            row = {"id": key, "a": str(i), "b": rng.choice([None, f"b{i}"])}
            steps.append((lsn, "insert", None, row))
            live[key] = row
        elif rng.random() < 0.15:
            steps.append((lsn, "delete", {"id": key}, None))
            live.pop(key)
        elif rng.random() < 0.15 and (free := [str(k) for k in range(1, 13) if str(k) not in live]):
            target = rng.choice(free)
            new = {"id": target, "a": str(i)}
            steps.append((lsn, "update", {"id": key, "a": None, "b": None}, new))
            live[target] = {**live.pop(key), **new}
        else:
            new = {"id": key, "a": str(i)} if rng.random() < 0.5 else {"id": key, "a": rng.choice([None, str(i)]), "b": f"c{i}"}
            steps.append((lsn, "update", None, new))
            live[key] = {**live[key], **new}
    df = log(spark, steps)
    assert as_dict(history.table_as_of(df, ["id"])) == replay(steps)
    assert as_dict(history.table_as_of(df, ["id"], until_lsn=60)) == replay(steps, 60)
    columns = history.table_as_of(df, ["id"], columns=["id", "a", "b"]).collect()
    assert {r["id"]: (r["a"], r["b"]) for r in columns} == {k: (v.get("a"), v.get("b")) for k, v in replay(steps).items()}


def test_batch_of_fifty_rows_each_up_to_a_time(spark):
    rows = spark.range(150).select(
        F.col("id").alias("seq"), (F.col("id") * 8).alias("lsn"), F.timestamp_seconds(F.lit(1_000_000) + F.floor(F.col("id") / 50) * 60).alias("commit_ts"),
        F.lit("insert").alias("op"), F.lit("public").alias("schema"), F.lit("events").alias("table"),
        F.lit(None).cast("map<string,string>").alias("old"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("new"))
    target = rows.where("seq = 99").first().commit_ts
    assert history.table_as_of(rows, ["id"], until_ts=target).count() == 100


def test_snapshot_and_changes(spark):
    snapshot = spark.createDataFrame([("1", "x", "p"), ("2", "y", "q")], "id string, a string, b string")
    changes = log(spark, [(90, "delete", {"id": "1"}, None), (110, "update", None, {"id": "2", "a": "z"}), (120, "insert", None, {"id": "3", "a": "w"})])
    state = history.apply_changes(snapshot, changes.drop("types"), ["id"], 100)
    assert as_dict(state) == {"1": {"id": "1", "a": "x", "b": "p"}, "2": {"id": "2", "a": "z", "b": "q"}, "3": {"id": "3", "a": "w"}}


def test_json_round_trip_and_pruning(spark, tmp_path):
    df = log(spark, [(10, "insert", None, {"id": "1", "a": None, "b": 'q"\n'}), (20, "update", None, {"id": "1", "a": "x"}), (30, "delete", {"id": "1"}, None)])
    event_io.write_change_events(df, str(tmp_path / "e"))
    back = event_io.read_change_events(spark, str(tmp_path / "e")).orderBy("lsn").collect()
    assert [r.lsn for r in back] == [10, 20, 30]
    assert [r.new and dict(r.new) for r in back] == [{"id": "1", "a": None, "b": 'q"\n'}, {"id": "1", "a": "x"}, None]
    assert [r.old and dict(r.old) for r in back] == [None, None, {"id": "1"}]


def test_publication_is_not_retroactive(spark):
    df = log(spark, [(10, "insert", None, {"id": "1"}), (20, "insert", None, {"id": "2"}), (30, "insert", None, {"id": "3"})])
    members = spark.createDataFrame([("public", "t", 15, 30)], "`schema` string, `table` string, from_lsn bigint, to_lsn bigint")
    assert [r.lsn for r in filters.publication_filter(df, members).collect()] == [20]
    assert filters.publication_filter(df, []).count() == 0
    assert [r.lsn for r in filters.since_lsn(df, 20).collect()] == [30]


def test_typed_view(spark):
    df = log(spark, [(10, "insert", None, {"id": "1", "a": "x"}), (20, "delete", {"id": "1"}, None)])
    assert [tuple(r) for r in typed_view(df, "t", {"id": 23, "b": 25}).collect()] == [(10, "insert", 1, None)]


def test_control_payloads(spark):
    df = spark.createDataFrame([("ready",), ("{}",), ("heartbeat",)], "payload string")
    assert [r.payload for r in filters.drop_control_payloads(df).collect()] == ["{}"]


def test_identities(spark):
    saved = spark.createDataFrame([("pg", 10, 5), ("pool", 11, 6), ("x", 12, 7)], "name string, pid bigint, starttime bigint")
    live = spark.createDataFrame([(10, 5), (11, 99)], "pid bigint, starttime bigint")
    assert {r.name: r.state for r in joins.reconcile_identities(saved, live).collect()} == {"pg": "adopted", "pool": "recycled", "x": "dead"}
