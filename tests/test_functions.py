import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.sources import telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize("text,value", [
    ("2A/0C0FFEE0", 0x2A0C0FFEE0), ("0/1F", 31), ("00/0", 0), ("2A-0C", None), ("Z1/0000000Q", None),
    ("1/2/3", None), ("80000000/0", None), ("7FFFFFFF/FFFFFFFF", 2**63 - 1), ("123456789/0", None), ("", None),
    ("FFFFFFFFFFFFFFFFFFFFFFFFFF/0", None),
])
def test_lsn_parse(spark, text, value):
    assert one(spark, fn.lsn_parse(lit(text))) == value


@pytest.mark.parametrize("value,text", [(0x2A0C0FFEE0, "2A/0C0FFEE0"), (1 << 40, "100/00000000"), (2**63 - 1, "7FFFFFFF/FFFFFFFF"), (171, "0/000000AB")])
def test_lsn_format(spark, value, text):
    assert one(spark, fn.lsn_format(lit(value).cast("bigint"))) == text


def test_lsn_bytes(spark):
    assert one(spark, fn.lsn_from_bytes(lit(bytes.fromhex("0000002A0C0FFEE0")))) == 0x2A0C0FFEE0
    assert one(spark, fn.lsn_from_bytes(lit(b"\xff" * 8))) is None
    assert bytes(one(spark, fn.lsn_to_bytes(lit(51966).cast("bigint")))) == bytes.fromhex("000000000000CAFE")


def test_clock(spark):
    ts = one(spark, fn.pg_micros_to_ts(lit(1_000_000).cast("bigint")))
    assert ts == datetime.datetime(2000, 1, 1, 0, 0, 1)
    assert one(spark, fn.ts_to_pg_micros(lit(datetime.datetime(1999, 1, 1)))) == 0


@pytest.mark.parametrize("pos,timeline,naming,name", [
    ((7 << 24) + 99, 18, "by_word", "000000120000000000000007"), ((5 << 32) + (3 << 24), 2, "by_word", "000000020000000500000003"),
    ((5 << 32) + (3 << 24), 2, "flat", "000000020000000000000503"), ((1 << 61) + 5, 9, "by_word", "000000092000000000000000"),
])
def test_segment_name(spark, pos, timeline, naming, name):
    assert one(spark, fn.segment_name(lit(pos).cast("bigint"), lit(timeline), naming)) == name


@pytest.mark.parametrize("name,end", [
    ("000000120000000000000007", 8 << 24), ("000000020000000500000003", (5 << 32) + (4 << 24)),
    ("000000020000000000000503", (5 << 32) + (4 << 24)), ("0000000200000005000000037", None), ("segment", None),
])
def test_parse_segment_name(spark, name, end):
    parsed = one(spark, fn.parse_segment_name(lit(name)))
    assert (parsed and parsed.end_lsn) == end


def test_name_kinds(spark):
    kinds = [one(spark, F.concat_ws(",", fn.is_segment(lit(n)).cast("string"), fn.is_partial(lit(n)).cast("string"), fn.is_history(lit(n)).cast("string")))
             for n in ("0000001200000000000000bc", "000000120000000000000007.partial", "0000000C.history", "00000012000000000000000701")]
    assert kinds == ["true,false,false", "false,true,false", "false,false,true", "false,false,false"]


@pytest.mark.parametrize("text,oid,value", [
    ("t", 16, True), ("f", 16, False), ("on", 16, None), ("-317", 21, -317), ("40000", 21, None), ("12 ", 23, None), ("-0.625", 701, -0.625),
    ("NaN", 701, None), ("-Infinity", 701, None), ("2e309", 701, None), ("7d", 701, None), ("0.25", 700, 0.25), ("1200.500", 1700, "1200.500"), ("[4,5]", 3802, "[4,5]"),
])
def test_coerce(spark, text, oid, value):
    assert one(spark, fn.coerce_pg(lit(text), oid)) == value


@pytest.mark.parametrize("text,oid,json", [
    ("f", 16, "false"), ("maybe", 16, '"maybe"'), ("-12", 23, "-12"), ("10000000000000000000", 20, '"10000000000000000000"'), ("-0.625", 701, "-0.625"),
    ("Infinity", 701, '"Infinity"'), ("1200.500", 1700, '"1200.500"'), ("harbour", 25, '"harbour"'), (None, 23, "null"),
])
def test_json_value(spark, text, oid, json):
    assert one(spark, fn.json_value(lit(text).cast("string"), lit(oid))) == json


def test_json_quote(spark):
    text = 'C:\\dir\t"two"\r\n\x02 ß\x1e'
    assert json.loads(one(spark, fn.json_quote(lit(text)))) == text
    assert one(spark, fn.json_quote(lit(text))) == '"C:\\\\dir\\t\\"two\\"\\r\\n\\u0002 ß\\u001e"'


def test_event_json_keeps_null_and_omits_absent(spark):
    image = F.map_from_entries(F.array(F.struct(lit("berth"), lit("31")), F.struct(lit("ship"), F.lit(None).cast("string"))))
    types = F.create_map(lit("berth"), lit(21), lit("ship"), lit(25), lit("cargo"), lit(25))
    none = F.lit(None).cast("map<string,string>")
    text = one(spark, fn.event_json(lit("2A/0C0FFEE0"), lit("update"), lit("port"), lit("calls"), none, image, types))
    assert text == '{"lsn":"2A/0C0FFEE0","op":"update","schema":"port","table":"calls","new":{"berth":31,"ship":null}}'


@pytest.mark.parametrize("raw,text", [(b"a\xffb", "a�b"), (b"a\xe2\x82b", "a�b"), ("é".encode(), "é")])
def test_utf8_lossy(spark, raw, text):
    assert one(spark, fn.utf8_lossy(lit(raw))) == text


@pytest.mark.parametrize("raw,newline,limit,line,truncated", [
    (b"hello world", True, 20, b"hello world", False), (b"crlf\r", True, 20, b"crlf", False), (b"tail", False, 20, b"tail", False),
    (b"x" * 10, True, 10, b"x" * 10, True), (b"x" * 10, False, 10, b"x" * 10, False), (b"x" * 11, False, 10, b"x" * 10, True),
    (b"x" * 9 + b"\ry", True, 10, b"x" * 9, True), (b"", True, 10, b"", False),
])
def test_clip_line(spark, raw, newline, limit, line, truncated):
    got = one(spark, fn.clip_line(lit(raw), lit(newline), limit))
    assert (bytes(got.line), got.truncated) == (line, truncated)


def test_retry_delays(spark):
    rows = spark.range(12).select(fn.retry_delay_ms(F.col("id")).alias("a"), fn.retry_delay_doubling_ms(F.col("id")).alias("b")).collect()
    assert [r.a for r in rows] == [min(100 << min(n, 8), 30_000) for n in range(12)]
    assert [r.b for r in rows] == [min(100 * 2**n, 30_000) for n in range(12)]


def test_fleet_sizing_of_one_host(spark):
    hosts = spark.createDataFrame([("a", 16 << 30, 8), ("b", 256 << 20, 1)], "host string, ram_bytes bigint, vcpus int")
    a, b = fn.fleet_sizing(hosts).orderBy("host").collect()
    assert (a.shared_buffers_mb, a.pool_size, a.max_connections, a.wal_buffers_mb, a.max_worker_processes) == (4096, 24, 100, 16, 12)
    assert (a.effective_cache_mb, a.maintenance_work_mb, a.work_mem_mb, a.max_parallel_per_gather, a.nr_hugepages, a.pooler_max_workers) == (12288, 819, 113, 4, 2080, 2)
    assert (b.shared_buffers_mb, b.wal_buffers_mb, b.max_connections, b.work_mem_mb, b.max_parallel_per_gather) == (128, 4, 100, 32, 1)


def test_log_prefix(spark):
    line = "2024-01-01 00:00:00.123 UTC [42] [psql] db=shop,user=app,client=10.0.0.1 LOG:  duration: 1234.500 ms  statement: SELECT 1"
    p = one(spark, fn.parse_pg_log_prefix(lit(line)))
    assert (p.pid, p.app, p.db, p.usr, p.client, p.level, p.duration_ms, p.statement) == (42, "psql", "shop", "app", "10.0.0.1", "LOG", 1234.5, "SELECT 1")
    p = one(spark, fn.parse_pg_log_prefix(lit("2024-01-01 00:00:00.123 UTC [7] LOG:  checkpoint starting: time")))
    assert (p.pid, p.db, p.level, p.message, p.duration_ms) == (7, None, "LOG", "checkpoint starting: time", None)
    stamp = "2024-01-01 00:00:00.123 UTC [7] "
    for line in ("", "\tFROM t [7] LOG:  duration: 1.5 ms  statement: x", "x" * 1000 + stamp + "LOG:  late"):
        assert set(one(spark, fn.parse_pg_log_prefix(lit(line))).asDict().values()) == {None}
    assert set(one(spark, fn.parse_pg_log_prefix(lit(None).cast("string"))).asDict().values()) == {None}
    p = one(spark, fn.parse_pg_log_prefix(lit(stamp + "[] db=,user=,client= ERROR:  duration: 3 ms\x01\nsecond $1")))
    assert (p.app, p.db, p.usr, p.client, p.level, p.message, p.duration_ms) == ("", "", "", "", "ERROR", "duration: 3 ms\x01\nsecond $1", None)
    p = one(spark, fn.parse_pg_log_prefix(lit(stamp + "LOG:  duration: 2.25 ms  execute s1: SELECT a,\n '\x01 ms  statement: '")))
    assert (p.app, p.duration_ms, p.statement) == (None, 2.25, "SELECT a,\n '\x01 ms  statement: '")
    p = one(spark, fn.parse_pg_log_prefix(lit(stamp + "LOG:  duration: 1.2.3 ms")))
    assert (p.level, p.duration_ms, p.statement) == ("LOG", None, None)
    assert one(spark, fn.parse_pg_log_prefix(lit(stamp + "no level"))).asDict() == {
        "logged_at": "2024-01-01 00:00:00.123 UTC", "pid": 7, **dict.fromkeys(
            ("app", "db", "usr", "client", "level", "message", "duration_ms", "statement"))}


@pytest.mark.parametrize("kind,raw,expected", [
    ("proc_stat", "42 (pg (x) pool) S 1 2 3 4 5 6 7 8 9 10 100 7 13 14 15 16 17 18 5000 20", {"cpu_ticks": 107, "starttime": 5000}),
    ("proc_stat", "42 (short) S 1", {"cpu_ticks": None, "starttime": None}),
    ("psi", "some avg10=12.34 avg60=1.00 avg300=0.00 total=5\nfull avg10=0.50 avg60=0.10 avg300=0.00 total=1\n", {"some_avg10": 12.34, "full_avg10": 0.5}),
    ("psi", "some avg10=12.34 avg60=1.00 avg300=0.00 total=5\n", {"some_avg10": 12.34, "full_avg10": 0.0}),
    ("psi", "", {"some_avg10": None, "full_avg10": None}),
    ("vmstat", "nr_free 1\nworkingset_refault_file 297848\nx 2\n", {"refaults": 297848}), ("vmstat", "nr_free 1\n", {"refaults": None}),
    ("meminfo", "MemTotal:        4030464 kB\nMemFree: 1 kB\n", {"kib": 4030464}),
    ("proc_status", "Name: x\nVmRSS:\t  1234 kB\n", {"rss_kb": 1234}),
    ("memory_max", "max\n", {"memory_bytes": None}), ("memory_max", "1073741824\n", {"memory_bytes": 1 << 30}),
    ("cpu_max", "max 100000\n", {"vcpus": None}), ("cpu_max", "50000 100000\n", {"vcpus": 1}), ("cpu_max", "400000 100000", {"vcpus": 4}),
])
def test_host_samples(spark, kind, raw, expected):
    got = telemetry.parse_host_samples(spark.createDataFrame([(kind, raw)], "kind string, raw string"), kind).first().asDict()
    assert got == expected
