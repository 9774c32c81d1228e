"""Queries over benchmark runs, metrics, vectors and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import aggregates, extras, joins, ordering, similarity
from tidemark.plans.inputs import derived, table
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import statistics, telemetry


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = derived(spark, sf_dir, "d6_metrics")
    key, name = F.col("key"), F.substring_index("key", "{", 1)
    part = lambda v: m.select("key", name.alias("name"), F.col(v).alias("value"), name.endswith("_total").alias("is_counter"), "new_in_after")
    return part("before_v").where("NOT new_in_after").drop("new_in_after"), part("after_v").drop("new_in_after")


DELTA = """SELECT key, split_part(key, '{', 1) AS name, suffix(split_part(key, '{', 1), '_total') AS is_counter,
 CASE WHEN new_in_after THEN 0 ELSE before_v END AS before_v, after_v,
 CASE WHEN suffix(split_part(key, '{', 1), '_total') THEN after_v - CASE WHEN new_in_after THEN 0 ELSE before_v END END AS delta FROM d6_metrics"""


@query("metric_delta", ["d6_metrics"], DELTA)
def metric_delta(spark, sf_dir):
    return joins.metric_delta(*_snapshots(spark, sf_dir))


@query("rank_metrics", ["d6_metrics"], f"""
SELECT key, CASE name WHEN 'store_s3_bytes_written_total' THEN 2 WHEN 'store_cache_misses_total' THEN 8 WHEN 'store_dirty_blocks' THEN 11 END AS rank FROM (
 SELECT replace(replace(replace(key, 'm2_total', 's3_bytes_written_total'), 'm3{{', 'dirty_blocks{{'), 'm4_total', 'cache_misses_total') AS key,
  split_part(replace(replace(replace(key, 'm2_total', 's3_bytes_written_total'), 'm3{{', 'dirty_blocks{{'), 'm4_total', 'cache_misses_total'), '{{', 1) AS name FROM d6_metrics) q""")
def rank_metrics(spark, sf_dir):
    key = F.replace(F.replace(F.replace("key", F.lit("m2_total"), F.lit("s3_bytes_written_total")), F.lit("m3{"), F.lit("dirty_blocks{")),
                    F.lit("m4_total"), F.lit("cache_misses_total"))
    m = derived(spark, sf_dir, "d6_metrics").select(key.alias("key"), F.substring_index(key, "{", 1).alias("name"))
    return ordering.rank_metrics(m).select("key", F.col("rank").cast("int").alias("rank"))


@query("read_metric_snapshots", ["d6_metrics"], """
SELECT key, split_part(key, '{', 1) AS name, CAST(after_v AS DOUBLE) AS value, suffix(split_part(key, '{', 1), '_total') AS is_counter,
 concat('e', s_suppkey) AS export FROM d6_metrics""")
def read_metric_snapshots(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    m = derived(spark, sf_dir, "d6_metrics")
    lines = F.array(F.lit("# HELP text"), F.concat("key", F.lit(" "), F.col("after_v").cast("string")), F.lit(""))
    m.select(F.explode(lines).alias("value")).write.text(path)
    read = telemetry.read_metric_snapshots(spark, path)
    return read.select("key", "name", "value", "is_counter", F.col("labels")["export"].alias("export"))


FLUSHED = """SELECT p_partkey, run, p_size AS packs_uploaded, p_partkey * 131072 AS bytes_uploaded, p_size * 3 AS blocks_claimed, p_size % 4 AS blocks_cross_deduped
 FROM (SELECT p_partkey, p_brand AS run, CAST(p_size AS BIGINT) AS p_size FROM part) p WHERE p_size % 3 <> 0"""


def _flushes(spark, sf_dir) -> DataFrame:
    d = derived(spark, sf_dir, "d7_flush")
    coloured = F.concat(F.unhex(F.lit("1B5B33326D")).cast("string"), F.col("line"), F.unhex(F.lit("1B5B306D")).cast("string"))
    return telemetry.flush_rows(d.withColumn("line", coloured)).drop("line")


@query("flush_events", [], FLUSHED)
def flush_events(spark, sf_dir):
    return _flushes(spark, sf_dir)


@query("read_flush_log", [], f"SELECT packs_uploaded, bytes_uploaded, blocks_claimed, blocks_cross_deduped FROM ({FLUSHED}) f")
def read_flush_log(spark, sf_dir):
    path = scratch_path(spark, "flush")
    derived(spark, sf_dir, "d7_flush").select("line").write.text(path)
    return telemetry.read_flush_log(spark, path).drop("run")


@query("read_bench_log", [], """
SELECT o_orderpriority AS run, coalesce(max_by(o_custkey + 0.5::DOUBLE, o_orderkey) FILTER (o_orderkey % 3 = 0 AND o_orderpriority <> '5-LOW'), 0) AS tps
FROM orders GROUP BY o_orderpriority""")
def read_bench_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reported = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderpriority") != "5-LOW")
    text = F.when(reported, F.concat(F.lit("tps = "), (F.col("o_custkey") + F.lit(0.5)).cast("decimal(20,1)").cast("string"), F.lit(" (without initial connection time)")))
    lines = o.select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("line_no"), F.coalesce(text, F.lit("progress: 15.0 s")).alias("value"))
    return telemetry.bench_rows(lines)


@query("flush_scoreboard", [], f"""
SELECT f.run, CAST(sum(packs_uploaded) AS BIGINT) AS packs, CAST(sum(bytes_uploaded) AS BIGINT) AS s3_bytes, CAST(sum(blocks_claimed) AS BIGINT) AS blocks,
 CAST(sum(blocks_cross_deduped) AS BIGINT) AS deduped, count(*) AS flushes, sum(bytes_uploaded)::DOUBLE / max(g.guest_bytes) AS write_amp,
 max(g.guest_ops)::DOUBLE / sum(packs_uploaded) AS coalesce_ratio, sum(blocks_claimed)::DOUBLE / sum(packs_uploaded) AS pack_fill
FROM ({FLUSHED}) f JOIN (SELECT p_brand AS run, sum(p_partkey) * 400000 AS guest_bytes, sum(p_size) * 7 AS guest_ops, min(p_partkey) + 10 AS mark FROM part GROUP BY p_brand) g ON g.run = f.run
WHERE p_partkey > g.mark GROUP BY f.run""")
def flush_scoreboard(spark, sf_dir):
    guest = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("run")).agg(
        (F.sum("p_partkey") * 400000).alias("guest_bytes"), (F.sum("p_size") * 7).alias("guest_ops"), (F.min("p_partkey") + 10).alias("mark"))
    return aggregates.flush_scoreboard(_flushes(spark, sf_dir).withColumn("line_no", F.col("p_partkey")), guest, after_line="mark")


@query("index_percentiles", ["d4_latency"], """
WITH r AS (SELECT transport, us, row_number() OVER (PARTITION BY transport ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY transport) AS n FROM d4_latency)
SELECT transport, max(n) AS n, max(CASE WHEN i = n * 50 // 100 THEN us END) AS p50, max(CASE WHEN i = n * 95 // 100 THEN us END) AS p95,
 max(CASE WHEN i = n * 99 // 100 THEN us END) AS p99, max(us) AS max FROM r GROUP BY transport""")
def index_percentiles(spark, sf_dir):
    return aggregates.index_percentiles(derived(spark, sf_dir, "d4_latency"), "transport", "us")


NOISE = """SELECT scale, count(*) AS runs, avg(s3_mb) AS s3_mb_mean, CASE WHEN count(*) >= 3 THEN max(abs(s3_mb - m)) / max(m) END AS s3_mb_floor
 FROM (SELECT *, avg(s3_mb) OVER (PARTITION BY scale) AS m FROM d21_scores WHERE variant = 'baseline') b GROUP BY scale"""


@query("noise_floor", ["d21_scores"], NOISE)
def noise_floor(spark, sf_dir):
    scores = derived(spark, sf_dir, "d21_scores")
    return aggregates.noise_floor(scores.where("variant = 'baseline'"), ["s3_mb"], ["scale"])


@query("ship_decision", ["d21_scores"], f"""
SELECT run_no, s.scale, (s3_mb - s3_mb_mean) / s3_mb_mean AS change, CASE WHEN s3_mb_floor IS NULL THEN NULL WHEN abs((s3_mb - s3_mb_mean) / s3_mb_mean) <= s3_mb_floor THEN 'noise'
 WHEN s3_mb < s3_mb_mean THEN 'ship' ELSE 'no-ship' END AS decision
FROM d21_scores s JOIN ({NOISE}) n ON n.scale = s.scale WHERE variant <> 'baseline'""")
def ship_decision(spark, sf_dir):
    scores = derived(spark, sf_dir, "d21_scores")
    floors = aggregates.noise_floor(scores.where("variant = 'baseline'"), ["s3_mb"], ["scale"])
    decided = aggregates.ship_decision(scores.where("variant <> 'baseline'"), floors, "s3_mb", ["scale"])
    return decided.select("run_no", "scale", "change", "decision")


@query("compare_variants", ["d21_scores"], """
SELECT run_no, variant, s.scale, s3_mb, tps, (s3_mb - b1) / b1 * 100 AS s3_mb_pct, (tps - b2) / b2 * 100 AS tps_pct FROM d21_scores s
JOIN (SELECT scale, avg(s3_mb) AS b1, avg(tps) AS b2 FROM d21_scores WHERE variant = 'baseline' GROUP BY scale) b ON b.scale = s.scale WHERE variant <> 'baseline'""")
def compare_variants(spark, sf_dir):
    scores = derived(spark, sf_dir, "d21_scores")
    base = scores.where("variant = 'baseline'")
    return joins.compare_variants(scores.where("variant <> 'baseline'"), base, ["s3_mb", "tps"], ["scale"])


@query("divergence_report", ["d23_dead"], f"""
WITH w AS (SELECT run AS profile, CAST(sum(bytes_uploaded) AS BIGINT) AS bytes, CAST(sum(packs_uploaded) AS BIGINT) AS packs FROM ({FLUSHED}) f GROUP BY run),
d AS (SELECT profile, CAST(sum(n_dead_before) AS BIGINT) AS dead_before, CAST(sum(n_dead_after) AS BIGINT) AS dead_after FROM d23_dead GROUP BY profile)
SELECT w.profile, bytes, packs, dead_before, dead_after, bytes::DOUBLE / (SELECT bytes FROM w WHERE profile = (SELECT min(p_brand) FROM part)) AS bytes_ratio
FROM w JOIN d ON d.profile = w.profile""")
def divergence_report(spark, sf_dir):
    dead = derived(spark, sf_dir, "d23_dead")
    first = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return aggregates.divergence_report(
        _flushes(spark, sf_dir).withColumnRenamed("run", "profile"),
        dead.select("profile", F.col("n_dead_before").alias("n_dead_tup")), dead.select("profile", F.col("n_dead_after").alias("n_dead_tup")), first)


@query("pooler_cost", ["d22_poolers"], """
SELECT p.series, p.poolers, p.tps, (ticks1 - ticks0) / 100.0::DOUBLE / (t1 - t0) AS cores,
 CASE WHEN p.tps > 0 THEN (ticks1 - ticks0) / 100.0::DOUBLE / (t1 - t0) * 1e6::DOUBLE / p.tps END AS us_per_txn,
 (ticks1 - ticks0) / 100.0::DOUBLE / (t1 - t0) / p.poolers AS per_pooler, p.tps / (s.tps * p.poolers) AS efficiency
FROM d22_poolers p JOIN (SELECT series, tps FROM d22_poolers WHERE poolers = 1) s ON s.series = p.series""")
def pooler_cost(spark, sf_dir):
    return aggregates.pooler_cost(derived(spark, sf_dir, "d22_poolers"))


@query("service_availability", ["d12_probes"], """
SELECT phase, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, count(*) FILTER (NOT ok)::DOUBLE / count(*) AS error_rate FROM d12_probes GROUP BY phase""")
def service_availability(spark, sf_dir):
    return aggregates.service_availability(derived(spark, sf_dir, "d12_probes"))


KNN_SQL = """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label AS query_id, i, avg(v) AS v FROM x GROUP BY label, i),
d AS (SELECT c.query_id, x.vec_id, {distance} AS distance FROM x JOIN c ON c.i = x.i GROUP BY c.query_id, x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _centroids(spark, sf_dir) -> DataFrame:
    spread = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = spread.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # one row per dimension of a label
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(ordered, lambda s: s["v"]).alias("query"))


def _knn(spark, sf_dir, metric: str) -> DataFrame:
    near = extras.knn(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), 10, metric)
    return near.select("query_id", "vec_id", F.round("distance", 9).alias("distance"), "rank")


@query("knn_cosine", [], KNN_SQL.format(distance="1 - sum(x.v * c.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(c.v * c.v)))"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@query("knn_l2", [], KNN_SQL.format(distance="sqrt(sum((x.v - c.v) * (x.v - c.v)))"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@query("trigram_similarity", [], """
WITH w AS (SELECT p_partkey AS id, p_name AS name, concat('  ', unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS w FROM part
  UNION ALL SELECT -1, '', concat('  ', unnest(['hot', 'plates']), ' ')),
g AS (SELECT DISTINCT id, name, substr(w, i, 3) AS g FROM (SELECT id, name, w, unnest(generate_series(1, length(w) - 2)) AS i FROM w) q),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id, a.name, count(*) AS shared FROM g a JOIN g b ON b.id = -1 AND a.id <> -1 AND a.g = b.g GROUP BY a.id, a.name)
SELECT s.id AS p_partkey, s.name AS p_name, shared::DOUBLE / (n.n + (SELECT n FROM n WHERE id = -1) - shared) AS similarity
FROM s JOIN n ON n.id = s.id WHERE shared::DOUBLE / (n.n + (SELECT n FROM n WHERE id = -1) - shared) >= 0.2::DOUBLE""")
def trigram_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return extras.trigram_similarity(p, "p_name", "hot plates", 0.2)


@query("trigram_join", [], """
WITH t AS (SELECT concat(p_name, ' ', p_brand, ' ', p_size) AS text, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT text, concat('  ', unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS w FROM t),
g AS (SELECT DISTINCT text, substr(w, i, 3) AS g FROM (SELECT text, w, unnest(generate_series(1, length(w) - 2)) AS i FROM w) q),
c AS (SELECT text, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT a.text AS left_text, b.text AS right_text, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.text < b.text GROUP BY 1, 2)
SELECT left_text, right_text, shared::DOUBLE / (x.n + y.n - shared) AS similarity, u.n * v.n AS row_pairs
FROM s JOIN c x ON x.text = left_text JOIN c y ON y.text = right_text JOIN t u ON u.text = left_text JOIN t v ON v.text = right_text
WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.7::DOUBLE""")
def trigram_join(spark, sf_dir):
    """Part labels that are nearly alike, with the number of pairs of parts behind each pair of labels."""
    label = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))
    labels = table(spark, sf_dir, "part").groupBy(label.alias("text")).agg(F.count("*").alias("n"))
    left = labels.select(F.col("text").alias("left_text"), F.col("n").alias("left_n"))
    right = labels.select(F.col("text").alias("right_text"), F.col("n").alias("right_n"))
    joined = similarity.trigram_join(left, right, "left_text", "right_text", 0.7)
    return joined.where("left_text < right_text").select("left_text", "right_text", "similarity", (F.col("left_n") * F.col("right_n")).alias("row_pairs"))


@query("slow_queries", [], """
SELECT concat('SELECT * FROM t', user_id % 4, ' WHERE id = ?') AS statement, count(*) AS calls, sum(floor(value * 10)) AS total_ms,
 avg(floor(value * 10)) AS mean_ms, max(floor(value * 10)) AS max_ms FROM events WHERE floor(value * 10) >= 400 GROUP BY 1""")
def slow_queries(spark, sf_dir):
    return extras.slow_queries(derived(spark, sf_dir, "d16_log"), slow_ms=400)


@query("partition_report", [], """
WITH p AS (SELECT date_trunc('day', o_orderdate) AS part_start, count(*) AS rows, min(o_orderdate) AS first_value, max(o_orderdate) AS last_value
 FROM orders GROUP BY 1)
SELECT part_start::TIMESTAMP AS part_start, rows, first_value, last_value, (part_start + INTERVAL 1 DAY)::TIMESTAMP AS part_end,
 coalesce(date_diff('day', lag(part_start) OVER (ORDER BY part_start), part_start) - 1, 0) AS gap_before,
 date_diff('day', part_start, (SELECT max(part_start) FROM p)) >= 730 AS expired FROM p""")
def partition_report(spark, sf_dir):
    return extras.partition_report(table(spark, sf_dir, "orders"), "o_orderdate", "day", retain=730)


@query("read_bench_log", [], """
WITH l AS (SELECT p_brand AS run, p_partkey AS no, CASE WHEN p_partkey % 4 = 0 OR p_brand = 'Brand#7' THEN NULL ELSE p_size + 0.5 END AS tps FROM part)
SELECT run, coalesce(arg_max(tps, CASE WHEN tps IS NOT NULL THEN no END), 0.0)::DOUBLE AS tps FROM l GROUP BY run""")
def read_bench_log(spark, sf_dir):
    """Run logs written as one file per run and read back; one run never says how fast it was."""
    path = scratch_path(spark, "bench")
    quiet = (F.col("p_partkey") % 4 == 0) | (F.col("p_brand") == "Brand#7")
    said = F.when(quiet, "starting vacuum").otherwise(F.concat(F.lit("tps = "), (F.col("p_size") + 0.5).cast("string"), F.lit(" (without initial connection time)")))
    lines = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "-").alias("run"), "p_partkey", said.alias("value"))
    lines.repartition("run").sortWithinPartitions("run", "p_partkey").select("run", "value").write.partitionBy("run").text(path)
    runs = telemetry.read_bench_log(spark, path)
    return runs.select(F.regexp_replace(F.regexp_extract("run", "run=([^/]+)", 1), "-", "#").alias("run"), "tps")


@query("read_stat_tables", [], """
SELECT user_id AS pid, 'client backend' AS backend_type, event_type AS state, count(*) AS n FROM events GROUP BY ALL""")
def read_stat_tables(spark, sf_dir):
    """Stored snapshots of the activity statistics; the table holds more than the reports read."""
    path = scratch_path(spark, "stats")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.lit("client backend").alias("backend_type"), F.col("event_type").alias("state"), "value")
    seen.write.parquet(f"{path}/pg_stat_activity")
    activity = statistics.read_stat_tables(spark, {"path": path}, ["activity"])["activity"]
    return activity.groupBy(*activity.columns).agg(F.count("*").alias("n"))
