"""Queries over the change log."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import coerce_pg, event_json, json_quote, json_value, lsn_format, typed_view
from tidemark.operators import aggregates, filters, flow, history, joins, ordering
from tidemark.plans.inputs import derived, in_batches, table
from tidemark.plans.registry import query
from tidemark.session import scratch_path, stored_copy
from tidemark.sources import events as event_io
from tidemark.sources import frames as frame_io
from tidemark.streaming.capture import change_stream, confirmed, fan_out, json_sink, progress_table
from tidemark.streaming.live import LiveTable, live_table as keep_table
from tidemark.streaming.monitor import StreamMonitor

BASE = 4261412864
STEP = 65536


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived change log in event form; values are whole hundredths, typed int8."""
    d = derived(spark, sf_dir, "d1_changes")
    cents = F.floor(F.col("c_value") * 100).cast("bigint").cast("string")
    cell = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    sent = [cell("k", F.col("k").cast("string")), cell("c_type", F.col("c_type")), cell("c_value", cents)]
    whole = F.map_from_entries(F.array(*sent, cell("c_props", F.col("c_props"))))
    short = F.map_from_entries(F.array(*sent))
    types = {"k": 20, "c_type": 25, "c_value": 20, "c_props": 25}
    return d.select(
        "seq", "lsn", lsn_format(F.col("lsn")).alias("lsn_text"), "commit_ts", "op",
        F.lit("public").alias("schema"), F.col("tbl").alias("table"), "k",
        F.when(F.col("op") == "delete", F.create_map(F.lit("k"), F.col("k").cast("string"))).alias("old"),
        F.when(F.col("op") != "delete", F.when(F.col("props_unchanged"), short).otherwise(whole)).alias("new"),
        F.create_map(*[x for n, o in types.items() for x in (F.lit(n), F.lit(o))]).alias("types"),
    )


def _typed_state(state: DataFrame) -> DataFrame:
    return state.select(
        F.col("k").cast("bigint").alias("k"), "c_type", F.col("c_value").cast("bigint").alias("cents"), "c_props")


AS_OF_SQL = """
WITH src AS ({source}),
h AS (SELECT * FROM src WHERE {target}),
l AS (SELECT k, max(lsn) AS last_lsn, max(CASE WHEN op = 'insert' THEN lsn END) AS ins_lsn FROM h GROUP BY k),
s AS (SELECT h.k, h.c_type, h.cents FROM h JOIN l ON h.k = l.k AND h.lsn = l.last_lsn WHERE h.op <> 'delete'),
p AS (SELECT k, c_props FROM (SELECT h.k, h.c_props, row_number() OVER (PARTITION BY h.k ORDER BY h.lsn DESC) AS r
  FROM h JOIN l ON h.k = l.k AND h.lsn >= coalesce(l.ins_lsn, 0) WHERE NOT h.props_unchanged AND h.op <> 'delete') q WHERE r = 1)
SELECT s.k, s.c_type, s.cents, p.c_props FROM s LEFT JOIN p ON s.k = p.k
"""
LOG_SQL = """SELECT seq, lsn, commit_ts, op, tbl, k, c_type, CAST(floor(c_value * 100) AS BIGINT) AS cents, c_props, props_unchanged FROM d1_changes"""


def as_of_sql(target: str, source: str = LOG_SQL) -> str:
    return AS_OF_SQL.format(source=source, target=target)


# A position in the middle of the log.
HALF_SQL = f"lsn <= {BASE} + (SELECT (max(lsn) - {BASE}) // 2 FROM d1_changes)"


HALF_TIME_SQL = "commit_ts <= (SELECT max(commit_ts) FROM d1_changes WHERE seq <= (SELECT max(seq) // 2 FROM d1_changes))"


def half_time(log: DataFrame):
    """The newest commit time in the first half of the log."""
    middle = log.agg(F.call_function("div", F.max("seq"), F.lit(2))).scalar()
    return log.where(F.col("seq") <= middle).agg(F.max("commit_ts")).first()[0]


def half_way(log: DataFrame) -> int:
    return BASE + (log.agg(F.max("lsn")).first()[0] - BASE) // 2


@query("table_as_of", ["d1_changes"], as_of_sql(HALF_SQL))
def table_as_of(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return _typed_state(history.table_as_of(log, ["k"], until_lsn=half_way(log), columns=["k", "c_type", "c_value", "c_props"]))


@query("table_as_of_latest", ["d1_changes"], as_of_sql("1 = 1"))
def table_as_of_latest(spark, sf_dir):
    state = history.table_as_of(event_log(spark, sf_dir), ["k"])
    image = lambda c: F.try_element_at("image", F.lit(c)).alias(c)
    return _typed_state(state.select("k", image("c_type"), image("c_value"), image("c_props")))


@query("table_as_of_time", ["d1_changes"], as_of_sql(HALF_TIME_SQL))
def table_as_of_time(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return _typed_state(history.table_as_of(log, ["k"], until_ts=half_time(log), columns=["k", "c_type", "c_value", "c_props"]))


def _snapshot(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("c_type"),
                    F.floor(F.col("c_acctbal") * 100).cast("bigint").alias("c_value"), F.col("c_name").alias("c_props"))


SNAPSHOT_SQL = f"""SELECT -1 AS seq, {BASE} AS lsn, NULL AS commit_ts, 'insert' AS op, '' AS tbl, c_custkey AS k, c_mktsegment AS c_type,
 CAST(floor(c_acctbal * 100) AS BIGINT) AS cents, c_name AS c_props, false AS props_unchanged FROM customer UNION ALL
 SELECT seq, lsn, commit_ts, op, tbl, k, c_type, CAST(floor(c_value * 100) AS BIGINT), c_props, props_unchanged FROM d1_changes WHERE lsn > {BASE}"""


@query("apply_changes", ["d1_changes"], as_of_sql(HALF_SQL, SNAPSHOT_SQL))
def apply_changes(spark, sf_dir):
    log = event_log(spark, sf_dir)
    state = history.apply_changes(
        _snapshot(spark, sf_dir), log, ["k"], BASE, half_way(log),
        columns=["k", "c_type", "c_value", "c_props"])
    return _typed_state(state)


@query("live_table", ["d1_changes"], as_of_sql("1 = 1"))
def live_table(spark, sf_dir):
    """The whole log as a stream of three batches; two parts of a level become one."""
    path, events = scratch_path(spark, "live"), in_batches(event_log(spark, sf_dir), 3, "seq")
    keep_table(events, path, ["k"], scratch_path(spark, "checkpoint"), fanout=2).awaitTermination()
    image = lambda c: F.try_element_at("image", F.lit(c)).alias(c)
    return _typed_state(LiveTable(spark, path, ["k"]).read().select("k", image("c_type"), image("c_value"), image("c_props")))


def _delivered(spark, sf_dir) -> tuple[str, StreamMonitor]:
    """The log to two sinks of their own pace: one fails at its second batch and is started again."""
    base, events = scratch_path(spark, "delivery"), in_batches(event_log(spark, sf_dir), 3, "seq")
    failures = [1]

    def failing(sink):
        def write(batch, batch_id):
            if batch_id == failures[0]:
                failures[0] = None
                raise ConnectionError("the sink is down")
            sink(batch, batch_id)
        return write

    steady, shaky = (confirmed(json_sink(f"{base}/{n}", rebuildable=True), f"{base}/progress", n) for n in ("steady", "shaky"))
    sinks = {"steady": steady, "shaky": failing(shaky)}
    monitor = StreamMonitor(spark, f"{base}/seen")
    spark.streams.addListener(monitor)
    try:
        for _ in range(2):
            for running in fan_out(lambda: events, sinks, f"{base}/checkpoints").values():
                try:
                    running.awaitTermination()
                except StreamingQueryException as e:
                    if "the sink is down" not in str(e):
                        raise
            monitor.settle()
    finally:
        spark.streams.removeListener(monitor)
    return base, monitor


@query("fan_out", ["d1_changes"], """
SELECT sink, seq, lsn, op, tbl AS table_name FROM d1_changes CROSS JOIN (SELECT unnest(['steady', 'shaky']) AS sink) s""")
def fanned_out(spark, sf_dir):
    """What two sinks hold after one of them failed and was started again: every event once."""
    base, _ = _delivered(spark, sf_dir)
    held = [event_io.read_change_events(spark, f"{base}/{n}").select(
        F.lit(n).alias("sink"), "seq", "lsn", "op", F.col("table").alias("table_name")) for n in ("steady", "shaky")]
    return held[0].unionByName(held[1])


@query("confirmed_positions", ["d1_changes"], """
SELECT consumer, max(lsn) AS lsn, count(*) AS events, CAST(2 AS BIGINT) AS starts, max(lsn) AS seen_lsn, count(*) AS seen_events
FROM d1_changes CROSS JOIN (SELECT unnest(['steady', 'shaky']) AS consumer) s GROUP BY consumer""")
def confirmed_positions(spark, sf_dir):
    """What the consumers confirmed, beside what the listener saw pass."""
    base, monitor = _delivered(spark, sf_dir)
    seen = monitor.consumers().select("consumer", "starts", F.col("lsn").alias("seen_lsn"), F.col("events").alias("seen_events"))
    return progress_table(spark, f"{base}/progress").join(seen, "consumer")


@query("running_stats", ["d1_changes"], """
SELECT count(*) AS events_total, CAST(2 AS BIGINT) AS reconnects_total,
 concat(hex(max(lsn) // 4294967296), '/', lpad(hex(max(lsn) % 4294967296), 8, '0')) AS last_flush_lsn, CAST(0 AS BIGINT) AS subscribers FROM d1_changes""")
def running_stats(spark, sf_dir):
    """The counters of the two streams after both have ended."""
    return aggregates.running_stats(_delivered(spark, sf_dir)[1].consumers())


@query("union_history", ["d1_changes"], f"""
SELECT lsn, op, k, c_type FROM (SELECT {BASE} AS lsn, 'insert' AS op, c_custkey AS k, c_mktsegment AS c_type FROM customer
 UNION ALL SELECT lsn, op, k, CASE WHEN op <> 'delete' THEN c_type END FROM d1_changes) q
""")
def union_history(spark, sf_dir):
    base = history.snapshot_events(_snapshot(spark, sf_dir), BASE, "public", "included")
    log = event_log(spark, sf_dir)
    half = F.col("seq") < 600
    whole = history.union_history(base, log.where(half), log.where(~half))
    key = F.coalesce(F.try_element_at("new", F.lit("k")), F.try_element_at("old", F.lit("k")))
    return whole.select("lsn", "op", key.cast("bigint").alias("k"), F.try_element_at("new", F.lit("c_type")).alias("c_type"))


@query("dedupe_replay", ["d1_changes"], "SELECT lsn, op, tbl AS table_name, k FROM d1_changes")
def dedupe_replay(spark, sf_dir):
    log = event_log(spark, sf_dir)
    sent_twice = log.unionByName(log.where(F.col("seq") % 4 != 1))
    return history.dedupe_replay(sent_twice, ["k"]).select("lsn", "op", F.col("table").alias("table_name"), "k")


@query("change_event_json", ["d1_changes"], """
SELECT seq, concat('{"lsn":"', hex(lsn // 4294967296), '/', lpad(hex(lsn % 4294967296), 8, '0'), '","op":"', op,
 '","schema":"public","table":"', tbl, '",', CASE WHEN op = 'delete' THEN concat('"old":{"k":', k, '}}')
 ELSE concat('"new":{"k":', k, ',"c_type":"', c_type, '","c_value":',
  coalesce(CAST(CAST(floor(c_value * 100) AS BIGINT) AS VARCHAR), 'null'),
  CASE WHEN props_unchanged THEN '' ELSE concat(',"c_props":"', replace(c_props, '"', '\\"'), '"') END, '}}') END) AS value
FROM d1_changes""")
def change_event_json(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select("seq", event_json(
        F.col("lsn_text"), F.col("op"), F.col("schema"), F.col("table"), F.col("old"), F.col("new"), F.col("types")).alias("value"))


READ_BACK_SQL = """
SELECT lsn, op, tbl AS table_name, k, CASE WHEN op <> 'delete' THEN c_type END AS c_type,
 CASE WHEN op <> 'delete' THEN CAST(floor(c_value * 100) AS BIGINT) END AS cents,
 (op <> 'delete' AND NOT props_unchanged) AS props_sent,
 CASE WHEN op <> 'delete' AND NOT props_unchanged THEN c_props END AS c_props FROM d1_changes
"""


def _read_back(events: DataFrame, *more: str) -> DataFrame:
    new = lambda c: F.try_element_at("new", F.lit(c))
    return events.select(
        *more, "lsn", "op", F.col("table").alias("table_name"),
        F.coalesce(new("k"), F.try_element_at("old", F.lit("k"))).cast("bigint").alias("k"), new("c_type").alias("c_type"),
        new("c_value").cast("bigint").alias("cents"),
        F.coalesce(F.map_contains_key("new", "c_props"), F.lit(False)).alias("props_sent"), new("c_props").alias("c_props"))


@query("read_change_events", ["d1_changes"], READ_BACK_SQL)
def read_change_events(spark, sf_dir):
    path = scratch_path(spark, "events")
    event_io.write_change_events(event_log(spark, sf_dir), path)
    return _read_back(event_io.read_change_events(spark, path))


def frame_log(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """The change log as binary frames, with its descriptor messages; ``extra`` adds messages that
    are not row changes, an unknown relation and rows of the wrong width."""
    relations = derived(spark, sf_dir, "d14_relations")
    described = relations.select(
        F.col("seq").cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("lsn"), F.col("rel_oid").cast("bigint").alias("rel_oid"),
        F.col("sch").alias("schema"), F.col("tbl").alias("table"),
        F.transform(F.split("cols", ","), lambda c: F.struct(
            F.split(c, ":")[0].alias("name"), F.split(c, ":")[1].cast("bigint").alias("type_oid"))).alias("columns"))
    d = derived(spark, sf_dir, "d1_changes")
    cents = F.floor(F.col("c_value") * 100).cast("bigint").cast("string")
    cell = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    null = cell("n", F.lit(None))
    text = lambda value: F.when(value.isNull(), null).otherwise(cell("t", value))
    narrow = (F.col("tbl") == "included") & (F.col("seq") < 300)
    if extra:
        narrow = narrow & (F.col("seq") % 10 != 3)
    first = [text(F.col("k").cast("string")), text(F.col("c_type")), text(cents)]
    props = F.when(F.col("props_unchanged"), cell("u", F.lit(None))).otherwise(text(F.col("c_props")))
    new = F.when(narrow, F.array(*first)).otherwise(F.array(*first, props))
    key_only = [text(F.col("k").cast("string")), null, null]
    old = F.when(narrow, F.array(*key_only)).otherwise(F.array(*key_only, null))
    tag = {"insert": "I", "update": "U", "delete": "D"}
    oid = F.when(F.col("tbl") == "included", 42).otherwise(43)
    op_tag = F.when(F.col("op") == "insert", tag["insert"]).when(F.col("op") == "update", tag["update"]).otherwise(tag["delete"])
    if extra:
        oid = F.when(F.col("seq") % 17 == 4, 99).otherwise(oid)
        op_tag = F.when(F.col("seq") % 9 == 2, F.lit("M")).otherwise(op_tag)
    dml = d.select(
        F.col("seq"), "lsn", op_tag.alias("tag"), oid.cast("bigint").alias("rel_oid"),
        F.when(F.col("op") == "delete", old).alias("old"), F.when(F.col("op") != "delete", new).alias("new"))
    return frame_io.encode_relations(described).unionByName(frame_io.encode_frames(dml))


DECODED_SQL = """
SELECT seq, concat(hex(lsn // 4294967296), '/', lpad(hex(lsn % 4294967296), 8, '0')) AS lsn_text, lsn, op, tbl AS table_name, k,
 CASE WHEN op <> 'delete' THEN c_type END AS c_type, CASE WHEN op <> 'delete' THEN CAST(floor(c_value * 100) AS BIGINT) END AS cents,
 (op <> 'delete' AND NOT props_unchanged AND NOT (tbl = 'included' AND seq < 300)) AS props_sent,
 CASE WHEN op <> 'delete' AND NOT props_unchanged AND NOT (tbl = 'included' AND seq < 300) THEN c_props END AS c_props
FROM d1_changes
"""


@query("decode_pgoutput", ["d1_changes"], DECODED_SQL)
def decode_pgoutput(spark, sf_dir):
    return _read_back(frame_io.decode_pgoutput(frame_log(spark, sf_dir)), "seq", "lsn_text")


@query("change_stream", ["d1_changes"], DECODED_SQL)
def stream_of_changes(spark, sf_dir):
    base = scratch_path(spark, "capture")
    frame_log(spark, sf_dir).write.parquet(f"{base}/frames")
    frames = spark.readStream.schema("seq bigint, lsn bigint, data binary").parquet(f"{base}/frames")
    change_stream(frames, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    events = spark.read.parquet(f"{base}/out/events")
    return _read_back(events, "seq", "lsn_text")


# Five events make a transaction; of these the last one of the log and every thirteenth are never closed.
BRACKETED_SQL = """SELECT seq, lsn, seq // 5 AS xid, max(commit_ts) OVER (PARTITION BY seq // 5) AS commit_ts, op, tbl, k, c_type,
 CAST(floor(c_value * 100) AS BIGINT) AS cents, c_props, (props_unchanged OR (tbl = 'included' AND seq < 300)) AS props_unchanged,
 CASE WHEN seq // 5 % 13 = 7 OR seq // 5 = (SELECT max(seq) // 5 FROM d1_changes) THEN 'open' ELSE 'committed' END AS bracket FROM d1_changes"""


def bracketed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as frames with transactions around the row changes, numbered by arrival."""
    frames = frame_log(spark, sf_dir).withColumn("seq", F.col("seq") * 4 + 1)
    d = derived(spark, sf_dir, "d1_changes")
    xid = F.call_function("div", F.col("seq"), F.lit(5))
    whole = d.groupBy(xid.alias("xid")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("lsn").alias("lsn"), F.max("commit_ts").alias("commit_ts"))
    last = d.agg(F.max(xid)).scalar()
    opening = whole.select((F.col("first") * 4).alias("seq"), "lsn", F.lit("B").alias("tag"), "xid", "commit_ts")
    closing = whole.where((F.col("xid") % 13 != 7) & (F.col("xid") != last)).select(
        (F.col("last") * 4 + 2).alias("seq"), "lsn", F.lit("C").alias("tag"), "xid", "commit_ts")
    return stored_copy(frames.unionByName(frame_io.encode_brackets(opening.unionByName(closing))), "frames")


@query("with_transactions", ["d1_changes"], f"""SELECT lsn, xid, CASE WHEN bracket = 'committed' THEN commit_ts END AS commit_ts, bracket
FROM ({BRACKETED_SQL}) q""")
def with_transactions(spark, sf_dir):
    frames = bracketed_log(spark, sf_dir)
    return frame_io.with_transactions(frame_io.decode_pgoutput(frames), frames).select("lsn", "xid", "commit_ts", "bracket")


@query("table_as_of_committed", ["d1_changes"], as_of_sql(HALF_TIME_SQL, f"SELECT * FROM ({BRACKETED_SQL}) b WHERE bracket = 'committed'"))
def table_as_of_committed(spark, sf_dir):
    """Frames to a table at a point in time: brackets give the time, open transactions don't count."""
    events = frame_io.committed_events(bracketed_log(spark, sf_dir))
    return _typed_state(history.table_as_of(events, ["k"], until_ts=half_time(event_log(spark, sf_dir)), columns=["k", "c_type", "c_value", "c_props"]))


@query("table_as_of_from_lake", ["d1_changes"], as_of_sql(HALF_TIME_SQL + " AND tbl = 'included'"))
def table_as_of_from_lake(spark, sf_dir):
    """A table at a point in time from events that were written as JSON and read back: one folder of the lake."""
    path, log = scratch_path(spark, "lake"), event_log(spark, sf_dir)
    event_io.write_change_events(log, path, rebuildable=True)
    events = event_io.read_change_events(spark, path, tables=[("public", "included")])
    return _typed_state(history.table_as_of(events, ["k"], until_ts=half_time(log), columns=["k", "c_type", "c_value", "c_props"]))


@query("dml_only", ["d1_changes"], """
SELECT seq, CASE op WHEN 'insert' THEN 'I' WHEN 'update' THEN 'U' ELSE 'D' END AS tag FROM d1_changes WHERE seq % 9 <> 2""")
def dml_only(spark, sf_dir):
    kept = filters.dml_only(frame_log(spark, sf_dir, extra=True))
    return kept.select("seq", F.substring("data", 1, 1).cast("string").alias("tag"))


@query("split_rejects", ["d1_changes"], """
SELECT seq, CASE WHEN seq % 17 = 4 THEN 'unknown relation' WHEN tbl = 'included' AND seq < 300 AND seq % 10 = 3 THEN 'column count mismatch'
 ELSE 'good' END AS verdict FROM d1_changes WHERE seq % 9 <> 2""")
def split_rejects(spark, sf_dir):
    frames = frame_log(spark, sf_dir, extra=True)
    resolved = frame_io.resolve_events(frame_io.dml_messages(frames), frame_io.relation_messages(frames))
    good, rejects = filters.split_rejects(resolved)
    return good.select("seq", F.lit("good").alias("verdict")).unionByName(rejects.select("seq", F.col("reject").alias("verdict")))


@query("resolve_relations", ["d1_changes", "d14_relations"], """
SELECT seq, tbl AS table_name, cols FROM (
 SELECT d.seq, r.tbl, r.cols, row_number() OVER (PARTITION BY d.seq ORDER BY r.seq DESC) AS rn
 FROM d1_changes d JOIN d14_relations r ON r.rel_oid = CASE WHEN d.tbl = 'included' THEN 42 ELSE 43 END AND r.seq <= d.seq) q WHERE rn = 1""")
def resolve_relations(spark, sf_dir):
    d = derived(spark, sf_dir, "d1_changes").select("seq", F.when(F.col("tbl") == "included", 42).otherwise(43).alias("rel_oid"))
    r = derived(spark, sf_dir, "d14_relations").select(
        "rel_oid", F.col("seq").cast("bigint").alias("seq"), F.col("sch").alias("schema"), F.col("tbl").alias("table"),
        F.split("cols", ",").alias("columns"))
    joined = joins.resolve_relations(d, r)
    return joined.select("seq", F.col("table").alias("table_name"), F.array_join("columns", ",").alias("cols"))


@query("typed_view", ["d1_changes"], """
SELECT lsn, op, k, c_type, CAST(floor(c_value * 100) AS BIGINT) AS c_value, CASE WHEN NOT props_unchanged THEN c_props END AS c_props
FROM d1_changes WHERE tbl = 'included' AND op <> 'delete'""")
def typed(spark, sf_dir):
    return typed_view(event_log(spark, sf_dir), "included", {"k": 20, "c_type": 25, "c_value": 20, "c_props": 25})


@query("coerce_pg", [], """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type = 'click' END AS flag,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS INTEGER) END AS whole,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS number,
 CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS exact_text,
 CASE WHEN event_id % 3 = 0 THEN concat('"', event_id, 'x"') ELSE CAST(event_id AS VARCHAR) END AS whole_json FROM events""")
def coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "error", "maybe").when(F.col("event_type") == "click", "t").otherwise("f")
    number = F.col("event_id").cast("string")
    whole = F.when(F.col("event_id") % 3 == 0, F.concat(number, F.lit("x"))).otherwise(number)
    floating = F.when(F.col("event_id") % 4 == 0, "NaN").otherwise(F.floor("value").cast("string"))
    return e.select(
        "event_id", coerce_pg(flag, 16).alias("flag"), coerce_pg(whole, 23).alias("whole"), coerce_pg(floating, 701).alias("number"),
        coerce_pg(F.floor(F.col("value") * 100).cast("bigint").cast("string"), 1700).alias("exact_text"),
        json_value(whole, F.lit(23)).alias("whole_json"))


@query("json_quote", [], r"""
SELECT doc_id, md5(concat('"', replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '"')) AS quoted
FROM documents""")
def quoted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(json_quote(F.col("text"))).alias("quoted"))


@query("publication_filter", ["d1_changes"], f"""
SELECT seq, tbl AS table_name, op FROM d1_changes WHERE tbl = 'included' OR (lsn >= {BASE + 400 * STEP} AND lsn < {BASE + 900 * STEP})""")
def publication_filter(spark, sf_dir):
    log = event_log(spark, sf_dir)
    names = log.select("schema", "table").distinct()
    start = F.when(F.col("table") == "gated", F.lit(BASE + 400 * STEP)).otherwise(F.lit(0)).cast("bigint")
    end = F.when(F.col("table") == "gated", F.lit(BASE + 900 * STEP).cast("bigint"))
    members = names.select("schema", "table", start.alias("from_lsn"), end.alias("to_lsn"))
    return filters.publication_filter(log, members).select("seq", F.col("table").alias("table_name"), "op")


@query("publication_list", ["d1_changes"], "SELECT seq, tbl AS table_name, op FROM d1_changes WHERE tbl = 'included'")
def publication_list(spark, sf_dir):
    kept = filters.publication_filter(event_log(spark, sf_dir), [("public", "included")])
    return kept.select("seq", F.col("table").alias("table_name"), "op")


@query("since_lsn", ["d1_changes"], f"SELECT seq, lsn, op FROM d1_changes WHERE lsn > {BASE + 321 * STEP}")
def since_lsn(spark, sf_dir):
    return filters.since_lsn(event_log(spark, sf_dir), BASE + 321 * STEP).select("seq", "lsn", "op")


@query("drop_control_payloads", [], """
SELECT event_id, props AS payload FROM events WHERE event_type NOT IN ('view', 'click')""")
def drop_control_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "ready").otherwise(F.col("props"))
    return filters.drop_control_payloads(e.select("event_id", payload.alias("payload")))


@query("stream_stats", ["d1_changes", "d11_runs"], """
SELECT (SELECT count(*) FROM d1_changes) AS events_total, (SELECT count(*) - 1 FROM d11_runs) AS reconnects_total,
 (SELECT concat(hex(max(lsn) // 4294967296), '/', lpad(hex(max(lsn) % 4294967296), 8, '0')) FROM d1_changes) AS last_flush_lsn,
 (SELECT count(*) FROM customer) AS subscribers""")
def stream_stats(spark, sf_dir):
    return aggregates.stream_stats(event_log(spark, sf_dir), derived(spark, sf_dir, "d11_runs"), table(spark, sf_dir, "customer"))


ARRIVALS = "SELECT seq, k % 3 AS source, lsn - (CASE WHEN seq % 7 = 0 THEN 20 ELSE 0 END) * 65536 AS lsn FROM d1_changes"


@query("order_violations", ["d1_changes"], f"""
SELECT seq, source, lsn, prev_lsn FROM (SELECT *, lag(lsn) OVER (PARTITION BY source ORDER BY seq) AS prev_lsn FROM ({ARRIVALS}) a) q WHERE lsn < prev_lsn""")
def order_violations(spark, sf_dir):
    d = derived(spark, sf_dir, "d1_changes")
    late = F.when(F.col("seq") % 7 == 0, 20).otherwise(0) * STEP
    arrivals = d.select("seq", (F.col("k") % 3).alias("source"), (F.col("lsn") - late).alias("lsn"))
    return ordering.order_violations(arrivals)


@query("flush_progress", ["d1_changes"], f"""
SELECT seq, slot, max(lsn) OVER w AS write_lsn, max(lsn) OVER w AS flush_lsn FROM (SELECT seq, source AS slot, lsn FROM ({ARRIVALS}) a) q
WINDOW w AS (PARTITION BY slot ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def flush_progress(spark, sf_dir):
    d = derived(spark, sf_dir, "d1_changes")
    late = F.when(F.col("seq") % 7 == 0, 20).otherwise(0) * STEP
    messages = d.select("seq", (F.col("k") % 3).alias("slot"), (F.col("lsn") - late).alias("lsn"))
    return ordering.flush_progress(messages).select("seq", "slot", "write_lsn", "flush_lsn")


@query("subscriber_backlog", ["d1_changes"], f"""
SELECT s.subscriber, s.lsn, CAST(t.n - coalesce(e.upto, 0) AS BIGINT) AS pending, t.n - coalesce(e.upto, 0) > 64 AS pruned FROM
 (SELECT c_custkey AS subscriber, {BASE} + (c_custkey * 7) * 65536 + 5 AS lsn FROM customer) s
 CROSS JOIN (SELECT count(*) AS n FROM d1_changes) t
 ASOF LEFT JOIN (SELECT lsn, count(*) OVER (ORDER BY lsn) AS upto FROM d1_changes) e ON s.lsn >= e.lsn""")
def subscriber_backlog(spark, sf_dir):
    log = derived(spark, sf_dir, "d1_changes").select("lsn")
    progress = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subscriber"), (BASE + F.col("c_custkey") * 7 * STEP + 5).cast("bigint").alias("lsn"))
    return flow.subscriber_backlog(log, progress)


@query("idle_heartbeats", [], """
SELECT source, unnest(generate_series(ts + INTERVAL 1800 SECOND, nxt - INTERVAL 1 MICROSECOND, INTERVAL 1800 SECOND)) AS ts FROM (
 SELECT user_id AS source, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) q
WHERE nxt > ts + INTERVAL 1800 SECOND""")
def idle_heartbeats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", "event_id")
    return flow.idle_heartbeats(e, seconds=1800, order=("event_id",))


@query("replication_lag", ["d10_slots"], """
SELECT slot, tick, current_lsn, flush_lsn, restart_lsn, current_lsn - flush_lsn AS lag_bytes, current_lsn - flush_lsn > 67108864 AS lagging,
 current_lsn - restart_lsn AS retained_bytes, current_lsn - restart_lsn > 4294967296 AS over_cap,
 coalesce(restart_lsn = lag(restart_lsn) OVER w AND current_lsn > lag(current_lsn) OVER w, false) AS pinned
FROM d10_slots WINDOW w AS (PARTITION BY slot ORDER BY tick)""")
def replication_lag(spark, sf_dir):
    return flow.replication_lag(derived(spark, sf_dir, "d10_slots"))


@query("caught_up", ["d10_slots"], """
SELECT slot, tick, flush_lsn, target, flush_lsn >= target AS caught_up FROM d10_slots,
 (SELECT max(current_lsn) - 1000 * 65536 AS target FROM d10_slots) t""")
def caught_up(spark, sf_dir):
    slots = derived(spark, sf_dir, "d10_slots").select("slot", "tick", "flush_lsn", "current_lsn")
    goal = slots.agg((F.max("current_lsn") - 1000 * STEP).alias("target"))
    return joins.caught_up(slots.drop("current_lsn"), goal)
