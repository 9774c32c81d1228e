"""Queries over log lines, process samples and host readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import (
    clip_line, fleet_sizing, parse_pg_log_prefix, retry_delay_doubling_ms, retry_delay_ms, utf8_lossy,
)
from tidemark.operators import advice, aggregates, filters, flow, joins, ordering, ratelimit
from tidemark.plans.inputs import derived, table
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import telemetry


@query("utf8_lossy", [], """
SELECT doc_id, md5(concat(text, chr(65533), lang, chr(65533))) AS cleaned FROM documents""")
def lossy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stray = F.unhex(F.lit("FF"))
    cut_off = F.unhex(F.lit("E282"))
    raw = F.concat(F.encode("text", "UTF-8"), stray, F.encode("lang", "UTF-8"), cut_off)
    return d.select("doc_id", F.md5(utf8_lossy(raw)).alias("cleaned"))


@query("clip_line", ["d5_lines"], """
SELECT seq, substr(line, 1, 24) AS line, length(line) + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END > 24 AS truncated FROM d5_lines""")
def clipped(spark, sf_dir):
    d = derived(spark, sf_dir, "d5_lines")
    frame = clip_line(F.encode("line", "UTF-8"), F.col("seq") % 2 == 0, 24)
    return d.select("seq", frame.alias("f")).select("seq", utf8_lossy(F.col("f.line")).alias("line"), "f.truncated")


@query("read_log_lines", ["d5_lines"], """
SELECT 'stdout' AS stream, substr(line, 1, 24) AS line, length(line) + 1 > 24 AS truncated FROM d5_lines""")
def read_log_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    derived(spark, sf_dir, "d5_lines").select("line").write.text(path)
    frames = telemetry.read_log_lines(spark, path, "stdout", "00000000-0000-0000-0000-000000000000", max_bytes=24)
    return frames.select("stream", "line", "truncated")


@query("parse_host_samples", [], """
SELECT event_id AS seq, user_id AS pid, event_id + event_id % 7 AS cpu_ticks, 1000 + user_id AS starttime FROM events""")
def host_samples(spark, sf_dir):
    raw = derived(spark, sf_dir, "d13_proc").withColumn("kind", F.lit("proc_stat"))
    return telemetry.parse_host_samples(raw, "proc_stat")


@query("pressure_samples", [], """
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id % 100 + 0.25::DOUBLE END AS some_avg10,
 CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE event_id % 10 + 0.5::DOUBLE END END AS full_avg10 FROM events""")
def pressure_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = lambda kind, number: F.concat(F.lit(f"{kind} avg10="), number.cast("string"), F.lit(" avg60=0.00 avg300=1.00 total=17\n"))
    some = F.when(F.col("event_type") != "error", line("some", F.col("event_id") % 100 + F.lit(0.25)))
    full = F.when(F.col("event_type") != "view", line("full", F.col("event_id") % 10 + F.lit(0.5)))
    raw = e.select("event_id", F.lit("psi").alias("kind"), F.concat_ws("", some, full).alias("raw"))
    return telemetry.parse_host_samples(raw, "psi")


@query("retry_delay", [], """
SELECT o_orderkey, least(CAST(100 * pow(2, least(o_orderkey % 15, 8)) AS BIGINT), 30000) AS delay_ms,
 least(CAST(100 * pow(2, least(o_orderkey % 15, 9)) AS BIGINT), 30000) AS doubling_ms FROM orders""")
def retry_delay(spark, sf_dir):
    n = F.col("o_orderkey") % 15
    return table(spark, sf_dir, "orders").select("o_orderkey", retry_delay_ms(n).alias("delay_ms"), retry_delay_doubling_ms(n).alias("doubling_ms"))


@query("fleet_sizing", ["d8_hosts"], """
WITH h AS (SELECT host, ram_bytes // 1048576 AS ram, vcpus AS v FROM d8_hosts),
s AS (SELECT *, greatest(ram // 4, 128) AS sb, least(greatest(v * 3, 16), 256) AS pool FROM h)
SELECT host, ram AS ram_mb, v AS vcpus, sb AS shared_buffers_mb, pool AS pool_size, least(greatest(v // 4, 1), 8) AS pooler_max_workers,
 least(greatest(sb // 32, 1), 16) AS wal_buffers_mb, least(greatest(pool + 2 * v + 10, 100), greatest(ram // 50, 100)) AS max_connections,
 greatest(v + 4, 8) AS max_worker_processes, greatest(v, 1) AS max_parallel_workers, ram * 3 // 4 AS effective_cache_mb,
 least(ram // 20, 2048) AS maintenance_work_mb, greatest(ram // 2 // (pool * 3), 32) AS work_mem_mb,
 least(greatest(v // 2, 1), 4) AS max_parallel_per_gather, sb // 2 + 32 AS nr_hugepages FROM s""")
def sizing(spark, sf_dir):
    return fleet_sizing(derived(spark, sf_dir, "d8_hosts"))


@query("parse_pg_log_prefix", ["d16_log"], """
SELECT event_id AS seq, '2024-01-01 00:00:00.000 UTC' AS logged_at, user_id AS pid, concat('app', user_id % 3) AS app, concat('d', user_id % 2) AS db,
 'u' AS usr, '10.0.0.1' AS client, 'LOG' AS level, CAST(floor(value * 10) AS DOUBLE) AS duration_ms,
 concat('SELECT * FROM t', user_id % 4, ' WHERE id = ', event_id) AS statement FROM events""")
def log_prefix(spark, sf_dir):
    d = derived(spark, sf_dir, "d16_log").select("seq", parse_pg_log_prefix(F.col("line")).alias("p"))
    return d.select("seq", "p.logged_at", "p.pid", "p.app", "p.db", "p.usr", "p.client", "p.level", "p.duration_ms", "p.statement")


KEPT_SQL = """RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_s, seq) AS rn FROM d9_mem),
r AS (SELECT host, rn, seq, ram_bytes, ram_bytes AS kept, true AS hit FROM o WHERE rn = 1 UNION ALL
 SELECT o.host, o.rn, o.seq, o.ram_bytes, CASE WHEN abs(o.ram_bytes - r.kept) * 20 > r.kept THEN o.ram_bytes ELSE r.kept END,
  abs(o.ram_bytes - r.kept) * 20 > r.kept FROM r JOIN o ON o.host = r.host AND o.rn = r.rn + 1)
SELECT host, seq, ram_bytes FROM r WHERE hit"""


@query("significant_change", ["d9_mem"], KEPT_SQL)
def significant_change(spark, sf_dir):
    kept = filters.significant_change(derived(spark, sf_dir, "d9_mem"), "ram_bytes", ["host"], ["at_s", "seq"])
    return kept.select("host", "seq", "ram_bytes")


RATE_SQL = """
SELECT s.host, s.pid, s.tick, t.prev_tick, greatest(s.cpu_ticks - b.cpu_ticks, 0) AS delta_ticks FROM d3_ticks s
JOIN (SELECT host, tick, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS prev_tick FROM (SELECT DISTINCT host, tick FROM d3_ticks) x) t
 ON s.host = t.host AND s.tick = t.tick JOIN d3_ticks b ON b.host = s.host AND b.pid = s.pid AND b.tick = t.prev_tick"""


@query("counter_rate", ["d3_ticks"], RATE_SQL.replace("greatest(s.cpu_ticks - b.cpu_ticks, 0)", "CAST(greatest(s.cpu_ticks - b.cpu_ticks, 0) AS BIGINT)"))
def counter_rate(spark, sf_dir):
    return joins.counter_rate(derived(spark, sf_dir, "d3_ticks"))


@query("counter_increase", ["d3_ticks"], """
SELECT host, pid, tick, CAST(greatest(cpu_ticks - lag(cpu_ticks) OVER w, 0 * lag(cpu_ticks) OVER w) AS BIGINT) AS cpu_ticks_increase
FROM d3_ticks WINDOW w AS (PARTITION BY host, pid ORDER BY tick)""")
def counter_increase(spark, sf_dir):
    grown = ordering.counter_increase(derived(spark, sf_dir, "d3_ticks"), ["host", "pid"], ["tick"], ["cpu_ticks"])
    return grown.select("host", "pid", "tick", "cpu_ticks_increase")


@query("hot_streak", [], """
WITH n AS (SELECT user_id % 4 AS host, event_id, value > 20 AS hot, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn FROM events)
SELECT host, event_id, rn - coalesce(max(CASE WHEN NOT hot THEN rn END) OVER (PARTITION BY host ORDER BY rn), 0) AS streak FROM n""")
def hot_streak(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("host"), "event_id", "value")
    return ordering.hot_streak(e, ["host"], ["event_id"], F.col("value") > 20).select("host", "event_id", "streak")


@query("reconcile_identities", [], """
SELECT c_name AS name, c_custkey AS pid, 1000 + c_custkey % 7 AS starttime, l.starttime AS live_starttime,
 CASE WHEN l.pid IS NULL THEN 'dead' WHEN l.starttime = 1000 + c_custkey % 7 THEN 'adopted' ELSE 'recycled' END AS state
FROM customer LEFT JOIN (SELECT user_id AS pid, 1000 + min(event_id) % 7 AS starttime FROM events GROUP BY user_id) l ON l.pid = c_custkey""")
def reconcile(spark, sf_dir):
    saved = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("pid"), (1000 + F.col("c_custkey") % 7).alias("starttime"))
    live = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pid")).agg((1000 + F.min("event_id") % 7).alias("starttime"))
    return joins.reconcile_identities(saved, live)


@query("active_sessions", ["d19_activity"], """
SELECT snapshot, CASE WHEN count(pid) > 0 THEN count(*) FILTER (backend_type = 'client backend' AND state <> 'idle' AND pid <> 10) END AS active
FROM d19_activity GROUP BY snapshot""")
def active_sessions(spark, sf_dir):
    return aggregates.active_sessions(derived(spark, sf_dir, "d19_activity"), own_pid=10)


@query("soak_check", ["d20_soak"], """
SELECT *, rss_ok AND fds_ok AND partials_ok AND lag_ok AS passed FROM (SELECT run, min(rss_kb) AS min_rss_kb, max(rss_kb) AS max_rss_kb,
 max(rss_kb) < greatest(min(rss_kb), 1) * 2 AS rss_ok, max(fds) < min(fds) + 10 AS fds_ok, bool_and(partials <= 1) AS partials_ok,
 bool_and(lag_bytes < 67108864) AS lag_ok FROM d20_soak GROUP BY run) q""")
def soak_check(spark, sf_dir):
    return aggregates.soak_check(derived(spark, sf_dir, "d20_soak"))


@query("crash_loops", ["d11_runs"], """
WITH n AS (SELECT process, seq, ran_s, row_number() OVER (PARTITION BY process ORDER BY seq) AS rn FROM d11_runs),
s AS (SELECT *, rn - coalesce(max(CASE WHEN ran_s >= 60 THEN rn END) OVER (PARTITION BY process ORDER BY rn), 0) AS restart_streak FROM n)
SELECT process, seq, restart_streak, least(CAST(100 * pow(2, least(restart_streak, 8)) AS BIGINT), 30000) AS delay_ms FROM s""")
def crash_loops(spark, sf_dir):
    return flow.crash_loops(derived(spark, sf_dir, "d11_runs")).select("process", "seq", "restart_streak", "delay_ms")


@query("pressure_feed", ["d17_pressure"], """
SELECT host, seq, some_avg10, CASE WHEN refaults IS NOT NULL AND lag(refaults) OVER w IS NOT NULL THEN greatest(refaults - lag(refaults) OVER w, 0) END AS refaults_increase,
 coalesce(lead(ts) OVER w > ts + INTERVAL 600 SECOND, false) AS disconnected FROM d17_pressure WINDOW w AS (PARTITION BY host ORDER BY ts)""")
def pressure_feed(spark, sf_dir):
    fed = flow.pressure_feed(derived(spark, sf_dir, "d17_pressure"), seconds=600)
    return fed.select("host", "seq", "some_avg10", "refaults_increase", "disconnected")


RATE_LIMIT_SQL = """RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY at_us, seq) AS rn FROM d5_lines),
r AS (SELECT stream, rn, seq, at_us, CAST(1000000000 - 1000000 AS BIGINT) AS tok, true AS passed, 0::BIGINT AS dropped, 0::BIGINT AS notice FROM o WHERE rn = 1 UNION ALL
 SELECT o.stream, o.rn, o.seq, o.at_us, CASE WHEN f.t >= 1000000 THEN f.t - 1000000 ELSE f.t END, f.t >= 1000000,
  CASE WHEN f.t >= 1000000 THEN 0 ELSE r.dropped + 1 END, CASE WHEN f.t >= 1000000 THEN r.dropped ELSE 0 END
 FROM r JOIN o ON o.stream = r.stream AND o.rn = r.rn + 1, LATERAL (SELECT least(r.tok + (o.at_us - r.at_us) * 500, 1000000000) AS t) f)
"""


@query("rate_limit", ["d5_lines"], RATE_LIMIT_SQL + "SELECT stream, seq, passed, notice FROM r")
def rate_limit(spark, sf_dir):
    lines = derived(spark, sf_dir, "d5_lines").select("stream", "seq", "at_us")
    return ratelimit.rate_limit(lines).select("stream", "seq", "passed", "notice")


@query("limited_stream", ["d5_lines"], RATE_LIMIT_SQL + """
SELECT r.stream, r.seq, 1 AS part, o.line FROM r JOIN o ON o.stream = r.stream AND o.rn = r.rn WHERE passed UNION ALL
SELECT stream, seq, 0, concat('[dropped ', notice, ' log lines]') FROM r WHERE notice > 0""")
def limited_stream(spark, sf_dir):
    sent = ratelimit.limited_stream(ratelimit.rate_limit(derived(spark, sf_dir, "d5_lines")))
    return sent.select("stream", "seq", "part", "line")


TICKS_SQL = f"""
t AS (SELECT host, tick, count(DISTINCT pid) AS live, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS prev_tick FROM d3_ticks GROUP BY host, tick),
d AS (SELECT host, tick, CAST(sum(delta_ticks) AS BIGINT) AS delta FROM ({RATE_SQL}) x GROUP BY host, tick),
c AS (SELECT t.host, t.tick, t.tick * 5 AS at_s, live, CASE WHEN prev_tick IS NOT NULL THEN coalesce(delta, 0) / 100.0::DOUBLE / ((t.tick - prev_tick) * 5) END AS cores,
 row_number() OVER (PARTITION BY t.host ORDER BY t.tick) AS rn FROM t LEFT JOIN d ON d.host = t.host AND d.tick = t.tick)"""


@query("scale_decisions", ["d3_ticks"], "RECURSIVE " + TICKS_SQL.strip() + """,
r AS (SELECT host, tick, rn, at_s, live, cores, 0 AS hot, 0 AS cold, CAST(NULL AS BIGINT) AS acted, 'hold' AS action, CAST(NULL AS BOOLEAN) AS at_ceiling,
  CAST(NULL AS VARCHAR) AS last_action FROM c WHERE rn = 1 UNION ALL
 SELECT c.host, c.tick, c.rn, c.at_s, c.live, c.cores, CASE WHEN a.act = 'hold' THEN s.hot ELSE 0 END, CASE WHEN a.act = 'hold' THEN s.cold ELSE 0 END,
  CASE WHEN a.act = 'hold' THEN r.acted ELSE c.at_s END, a.act, c.live >= 4 AND c.cores / c.live > 0.75::DOUBLE,
  CASE WHEN a.act = 'hold' THEN r.last_action ELSE a.act END
 FROM r JOIN c ON c.host = r.host AND c.rn = r.rn + 1,
 LATERAL (SELECT CASE WHEN c.cores / c.live > 0.75::DOUBLE THEN r.hot + 1 ELSE 0 END AS hot,
   CASE WHEN c.live > 1 AND c.cores / (c.live - 1) < 0.5::DOUBLE THEN r.cold + 1 ELSE 0 END AS cold, coalesce(c.at_s - r.acted, 1000000) AS since) s,
 LATERAL (SELECT CASE WHEN s.hot >= 2 AND c.live < 4 AND s.since >= 30 THEN 'up' WHEN s.cold >= 6 AND c.live > 1 AND s.since >= 60 THEN 'down' ELSE 'hold' END AS act) a)
SELECT host, tick, live, floor(cores * 100 + 0.5::DOUBLE) / 100 AS aggregate_cores, floor(cores / live * 100 + 0.5::DOUBLE) / 100 AS per_worker_cores,
 action, at_ceiling, last_action FROM r""")
def scale_decisions(spark, sf_dir):
    return advice.scale_decisions(derived(spark, sf_dir, "d3_ticks"), max_workers=4)


@query("retune_advice", ["d9_mem"], """RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_s, seq) AS rn FROM d9_mem),
r AS (SELECT host, seq, rn, at_s, ram_bytes AS seen, ram_bytes AS tuned, at_s AS moved, CAST(NULL AS BIGINT) AS restarted, false AS reload, false AS restart,
  greatest(ram_bytes // 1048576 // 4, 128) AS buffers_from_mb FROM o WHERE rn = 1 UNION ALL
 SELECT o.host, o.seq, o.rn, o.at_s, s.seen, CASE WHEN w.restart THEN s.seen ELSE r.tuned END, s.moved, CASE WHEN w.restart THEN o.at_s ELSE r.restarted END,
  s.reload, w.restart, b.old
 FROM r JOIN o ON o.host = r.host AND o.rn = r.rn + 1,
 LATERAL (SELECT abs(o.ram_bytes - r.seen) * 20 > r.seen AS reload, CASE WHEN abs(o.ram_bytes - r.seen) * 20 > r.seen THEN o.ram_bytes ELSE r.seen END AS seen,
  CASE WHEN abs(o.ram_bytes - r.seen) * 20 > r.seen THEN o.at_s ELSE r.moved END AS moved) s,
 LATERAL (SELECT greatest(r.tuned // 1048576 // 4, 128) AS old, greatest(s.seen // 1048576 // 4, 128) AS new) b,
 LATERAL (SELECT (b.new * 4 >= b.old * 5 OR b.new * 5 <= b.old * 4) AND o.at_s - s.moved >= 90 AND (r.restarted IS NULL OR o.at_s - r.restarted >= 120) AS restart) w)
SELECT host, seq, reload, restart, buffers_from_mb, greatest(tuned // 1048576 // 4, 128) AS buffers_to_mb FROM r""")
def retune_advice(spark, sf_dir):
    told = advice.retune_advice(derived(spark, sf_dir, "d9_mem"))
    return told.select("host", "seq", "reload", "restart", "buffers_from_mb", "buffers_to_mb")
