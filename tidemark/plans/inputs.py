"""Inputs of the registered queries, derived by SQL from the given tables.

The text runs unchanged in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import plan_bytes, scratch_path, stored_copy

# A file of rows that a stream reads holds about this much of them, as stored.
ARRIVAL_BYTES = 8 << 20

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    "d1_changes": r"""
WITH b AS (SELECT event_id, ts, user_id, event_type, value, props,
   row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
   lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
c AS (SELECT *, (rn > 1 AND event_type = 'error' AND coalesce(prev,'') <> 'error') AS is_del FROM b),
d AS (SELECT *, coalesce(lag(is_del) OVER (PARTITION BY user_id ORDER BY event_id), false) AS prev_del FROM c),
e AS (SELECT *, CASE WHEN is_del THEN 'delete' WHEN rn = 1 OR prev_del THEN 'insert' ELSE 'update' END AS op FROM d)
SELECT event_id AS seq, 4261412864 + event_id * 65536 AS lsn, ts AS commit_ts, op,
  CASE WHEN user_id % 5 = 0 THEN 'gated' ELSE 'included' END AS tbl, user_id AS k, event_type AS c_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS c_value, props AS c_props,
  (op = 'update' AND event_id % 3 = 0) AS props_unchanged FROM e
""",
    "d14_relations": r"""
SELECT 42 AS rel_oid, -1 AS seq, 'public' AS sch, 'included' AS tbl, 'k:20,c_type:25,c_value:701' AS cols UNION ALL
SELECT 42, 300, 'public', 'included', 'k:20,c_type:25,c_value:701,c_props:25' UNION ALL
SELECT 43, -1, 'public', 'gated', 'k:20,c_type:25,c_value:701,c_props:25'
""",
    "d2_catalog": r"""
WITH n AS (SELECT o_orderkey, 1 + o_orderkey % 3 AS timeline, CAST(floor(o_orderkey / 3.0) AS bigint) AS seg_no FROM orders)
SELECT timeline, seg_no, concat(lpad(hex(CAST(timeline AS bigint)),8,'0'),
  lpad(hex(CAST(floor(seg_no/256.0) AS bigint)),8,'0'), lpad(hex(CAST(seg_no % 256 AS bigint)),8,'0'),
  CASE WHEN o_orderkey % 101 = 7 THEN '.partial' ELSE '' END) AS name,
  (o_orderkey % 37 = 5) AS missing_locally FROM n WHERE o_orderkey % 53 <> 11
""",
    "d15_chunks": r"""
SELECT 1 + l_orderkey % 2 AS timeline, 4261412864 + (l_orderkey * 7 + l_linenumber) * 1048576 AS start_lsn,
  CAST(1048576 * (1 + l_partkey % 3) AS bigint) AS n_bytes FROM lineitem
""",
    "d3_ticks": r"""
SELECT host, pid, tick, sum(inc) OVER (PARTITION BY host, pid ORDER BY tick ROWS UNBOUNDED PRECEDING) AS cpu_ticks FROM (
 SELECT user_id % 4 AS host, user_id % 16 AS pid, CAST(floor(event_id/100.0) AS bigint) AS tick,
  CAST(sum(floor(value)) AS bigint) AS inc FROM events GROUP BY 1,2,3) q WHERE (tick + pid) % 9 <> 4
""",
    "d13_proc": r"""
SELECT event_id AS seq, user_id AS pid, concat(CAST(user_id AS varchar(9)), ' (pg (x) pool) S 1 2 3 4 5 6 7 8 9 10 ', CAST(event_id AS varchar(9)), ' ',
  CAST(event_id % 7 AS varchar(9)), ' 13 14 15 16 17 18 ', CAST(1000 + user_id AS varchar(9)), ' 20 21') AS raw FROM events
""",
    "d4_latency": r"""
SELECT o_orderpriority AS transport, o_orderkey AS n, CAST(floor(o_totalprice) AS bigint) AS us FROM orders
""",
    "d5_lines": r"""
SELECT event_id AS seq, CASE WHEN event_type IN ('error','view') THEN 'stderr' ELSE 'stdout' END AS stream,
  event_id * 300 AS at_us,
  concat(event_type, ' user=', CAST(user_id AS varchar(20)), ' ', props) AS line FROM events
""",
    "d16_log": r"""
SELECT event_id AS seq, concat('2024-01-01 00:00:00.000 UTC [', CAST(user_id AS varchar(9)), '] [app', CAST(user_id % 3 AS varchar(9)), '] db=d', CAST(user_id % 2 AS varchar(9)),
  ',user=u,client=10.0.0.1 LOG:  duration: ', CAST(CAST(floor(value * 10) AS bigint) AS varchar(20)), '.000 ms  statement: SELECT * FROM t', CAST(user_id % 4 AS varchar(9)), ' WHERE id = ', CAST(event_id AS varchar(20))) AS line FROM events
""",
    "d6_metrics": r"""
SELECT s_suppkey, concat('store_m', CAST(s_suppkey % 7 AS varchar(9)), CASE WHEN s_suppkey % 2 = 0 THEN '_total' ELSE '' END,
  '{export="e', CAST(s_suppkey AS varchar(9)), '"}') AS key, CAST(s_nationkey * 10 AS bigint) AS before_v,
  CAST(s_nationkey * 10 + s_suppkey AS bigint) AS after_v, (s_suppkey % 6 = 1) AS new_in_after FROM supplier
""",
    "d7_flush": r"""
SELECT p_partkey, p_brand AS run, concat('2026-01-01T00:00:00Z INFO ', CASE WHEN p_size % 3 = 0 THEN 'compaction done' ELSE 'flush complete' END,
  ' packs_uploaded=', CAST(p_size AS varchar(9)), ' bytes_uploaded=', CAST(p_partkey * 131072 AS varchar(20)),
  ' blocks_claimed=', CAST(p_size * 3 AS varchar(9)), ' blocks_cross_deduped=', CAST(p_size % 4 AS varchar(9))) AS line FROM part
""",
    "d8_hosts": r"""
SELECT s_suppkey AS host, CAST(1 + s_suppkey % 64 AS bigint) * 1073741824 AS ram_bytes, CAST(1 + s_suppkey % 64 AS bigint) AS vcpus FROM supplier
""",
    "d9_mem": r"""
SELECT user_id % 4 AS host, event_id AS seq, event_id * 5 AS at_s,
  CAST(735 + 256 * (CAST(floor(event_id / 40.0) AS bigint) % 6) AS bigint) * 1048576 AS ram_bytes FROM events
""",
    "d10_slots": r"""
SELECT user_id % 5 AS slot, event_id AS tick, 4261412864 + event_id * 65536 AS current_lsn,
  4261412864 + event_id * 65536 - (event_id % 1500) * 65536 AS flush_lsn,
  4261412864 + CAST(floor(event_id / 700.0) AS bigint) * 700 * 65536 AS restart_lsn FROM events
""",
    "d11_runs": r"""
SELECT o_orderpriority AS process, o_orderkey AS seq, o_orderkey % 97 AS ran_s, CAST(o_custkey % 3 AS bigint) AS exit_code FROM orders
""",
    "d12_probes": r"""
SELECT CASE WHEN event_id % 2000 < 1000 THEN 'before' ELSE 'after' END AS phase, event_id AS seq, event_type <> 'error' AS ok FROM events
""",
}

DERIVED["d17_pressure"] = """
SELECT user_id % 4 AS host, event_id AS seq, ts, value / 10 AS some_avg10, value / 20 AS full_avg10,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 31) % 4000 END AS refaults FROM events
"""

DERIVED["d18_history"] = """
SELECT CAST(2 AS bigint) AS timeline, concat('1', chr(9), '0/14000000', chr(9), 'no recovery target specified') AS line UNION ALL
SELECT CAST(3 AS bigint), concat('1', chr(9), '0/14000000', chr(9), 'no recovery target specified') UNION ALL
SELECT CAST(3 AS bigint), concat('2', chr(9), '0/30000000', chr(9), 'at restore point') UNION ALL
SELECT CAST(3 AS bigint), '# comment'
"""

DERIVED["d19_activity"] = """
SELECT user_id % 20 AS snapshot, CASE WHEN user_id % 20 = 7 THEN NULL ELSE event_id END AS pid,
  CASE WHEN event_id % 6 = 0 THEN 'walsender' ELSE 'client backend' END AS backend_type,
  CASE WHEN event_type = 'view' THEN 'idle' ELSE 'active' END AS state FROM events
"""

DERIVED["d20_soak"] = """
SELECT o_orderpriority AS run, o_orderkey AS seq, 1000 + o_custkey % 700 AS rss_kb, o_orderkey % 9 AS fds,
  CASE WHEN o_orderkey % 4001 = 17 THEN 2 ELSE 1 END AS partials, (o_orderkey * 4096) % 67000000 AS lag_bytes FROM orders
"""

DERIVED["d21_scores"] = """
SELECT s_suppkey AS run_no, CASE WHEN s_suppkey % 3 = 0 THEN 'baseline' ELSE concat('variant', CAST(s_suppkey % 3 AS varchar(3))) END AS variant,
  s_nationkey % 5 AS scale, CAST(1000 + s_suppkey % 11 AS double) AS s3_mb, CAST(2000 + s_suppkey % 17 AS double) AS tps FROM supplier
"""

DERIVED["d22_poolers"] = """
SELECT s_suppkey AS series, n.poolers, CAST(100 * n.poolers AS bigint) AS ticks0, CAST(100 * n.poolers + 67 * n.poolers + s_suppkey % 10 AS bigint) AS ticks1,
  CAST(0 AS double) AS t0, CAST(10 AS double) AS t1, CAST(700 * n.poolers - s_suppkey % 13 AS double) AS tps
FROM supplier, (SELECT 1 AS poolers UNION ALL SELECT 2 UNION ALL SELECT 3) n
"""

DERIVED["d23_dead"] = """
SELECT p_brand AS profile, p_size * 10 AS n_dead_before, p_size AS n_dead_after, p_partkey FROM part
"""



def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input over the parquet tables of a folder."""
    for table in TABLES:
        if table in DERIVED[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(DERIVED[name])


def in_batches(rows: DataFrame, n: int, order: str | None = None, session: SparkSession | None = None) -> DataFrame:
    """The rows as a stream of n batches, or one or two fewer where they are few, from files that hold
    ranges of an order, if there is one. A batch has as many files as its size asks for."""
    path, rows = scratch_path(rows.sparkSession, "arrivals"), stored_copy(rows, "rows")
    files = n * (1 + plan_bytes(rows) // (n * ARRIVAL_BYTES))
    dealt = rows.repartitionByRange(files, order) if order else rows.repartition(files)
    dealt.write.parquet(path)
    # a range that no row falls in leaves no file
    written = len(rows.sparkSession.read.parquet(path).inputFiles())
    return (session or rows.sparkSession).readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-written // n)).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_inputs(names: list[str], query: str) -> str:
    """SQL text with the derived inputs as leading common table expressions. The query may start
    with ``WITH`` or, for a recursive one, with ``RECURSIVE`` and its own expressions."""
    parts = [f"{n} AS ({DERIVED[n].strip()})" for n in names]
    body = query.strip()
    for lead in ("WITH ", "RECURSIVE "):
        if body.startswith(lead):
            return ("WITH RECURSIVE " if lead == "RECURSIVE " else "WITH ") + ", ".join([*parts, body[len(lead):]])
    return "WITH " + ", ".join(parts) + " " + body
