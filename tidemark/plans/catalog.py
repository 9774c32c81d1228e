"""Queries over log positions, segment names and the archive catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import (
    lsn_diff, lsn_format, lsn_from_bytes, lsn_ge, lsn_parse, lsn_to_bytes, parse_segment_name, pg_micros_to_ts,
    segment_name, ts_to_pg_micros,
)
from tidemark.operators import aggregates, filters, joins, ordering, sets
from tidemark.plans.inputs import derived, in_batches, table
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources.archive import apply_retention, catalog_rows, copy_missing_segments, fetch_segments, scan_segment_catalog
from tidemark.sources.storage import open_path, store_file
from tidemark.streaming.stateful import assemble_segments

# Segment 1,024 of timeline 1 in the derived catalog.
REDO = "000000010000000400000000"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "d2_catalog")


LSN_TEXT = "concat(hex({0} // 4294967296), '/', lpad(hex({0} % 4294967296), 8, '0'))"


@query("lsn_text", ["d1_changes"], f"""
SELECT seq, {LSN_TEXT.format('lsn')} AS lsn_text, CASE WHEN seq % 7 <> 0 THEN lsn END AS parsed FROM d1_changes""")
def lsn_text(spark, sf_dir):
    d = derived(spark, sf_dir, "d1_changes").select("seq", lsn_format(F.col("lsn")).alias("lsn_text"))
    damaged = F.when(F.col("seq") % 14 == 0, "noslash").when(F.col("seq") % 7 == 0, F.concat(F.lit("X"), F.col("lsn_text"))).otherwise(F.col("lsn_text"))
    return d.withColumn("parsed", lsn_parse(damaged))


@query("lsn_bytes", ["d1_changes"], "SELECT seq, lpad(hex(lsn), 16, '0') AS raw, lsn AS back FROM d1_changes")
def lsn_bytes(spark, sf_dir):
    raw = lsn_to_bytes(F.col("lsn"))
    return derived(spark, sf_dir, "d1_changes").select("seq", F.hex(raw).alias("raw"), lsn_from_bytes(raw).alias("back"))


@query("lsn_distance", ["d10_slots"], """
SELECT slot, tick, current_lsn - flush_lsn AS behind, flush_lsn >= restart_lsn AS ahead_of_restart FROM d10_slots""")
def lsn_distance(spark, sf_dir):
    d = derived(spark, sf_dir, "d10_slots")
    return d.select("slot", "tick", lsn_diff(F.col("current_lsn"), F.col("flush_lsn")).alias("behind"),
                    lsn_ge(F.col("flush_lsn"), F.col("restart_lsn")).alias("ahead_of_restart"))


@query("log_clock", [], """
SELECT event_id, epoch_us(ts) - 946684800000000 AS pg_us, ts AS back FROM events""")
def log_clock(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ts_to_pg_micros(F.col("ts")).alias("pg_us"))
    return e.withColumn("back", pg_micros_to_ts(F.col("pg_us")).cast("timestamp_ntz"))


@query("segment_name", ["d15_chunks"], """
SELECT timeline, start_lsn,
 concat(lpad(hex(timeline), 8, '0'), lpad(hex(start_lsn // 4294967296), 8, '0'), lpad(hex((start_lsn % 4294967296) // 16777216), 8, '0')) AS name,
 concat(lpad(hex(timeline), 8, '0'), lpad(hex(start_lsn // 16777216 // 4294967296), 8, '0'), lpad(hex(start_lsn // 16777216 % 4294967296), 8, '0')) AS flat_name
FROM d15_chunks""")
def segment_names(spark, sf_dir):
    pos, timeline = F.col("start_lsn"), F.col("timeline")
    return derived(spark, sf_dir, "d15_chunks").select(
        "timeline", "start_lsn", segment_name(pos, timeline).alias("name"), segment_name(pos, timeline, "flat").alias("flat_name"))


@query("parse_segment_name", ["d2_catalog"], """
SELECT name, CAST(timeline AS BIGINT) AS timeline, seg_no // 256 AS hi, seg_no % 256 AS lo, seg_no, seg_no * 16777216 AS start_lsn,
 (seg_no + 1) * 16777216 AS end_lsn FROM d2_catalog""")
def parsed_names(spark, sf_dir):
    return catalog(spark, sf_dir).select("name", parse_segment_name(F.col("name")).alias("s")).select("name", "s.*")


NAMED = """SELECT CASE WHEN seg_no % 97 = 3 THEN concat(substr(name, 1, 8), '.history') WHEN seg_no % 89 = 4 THEN concat(name, '0')
 WHEN seg_no % 83 = 5 THEN lower(name) ELSE name END AS name FROM d2_catalog"""


def _mixed_names(spark, sf_dir) -> DataFrame:
    name, n = F.col("name"), F.col("seg_no")
    return catalog(spark, sf_dir).select(
        F.when(n % 97 == 3, F.concat(F.substring(name, 1, 8), F.lit(".history"))).when(n % 89 == 4, F.concat(name, F.lit("0")))
        .when(n % 83 == 5, F.lower(name)).otherwise(name).alias("name"))


@query("file_kinds", ["d2_catalog"], f"""
SELECT name, CASE WHEN regexp_full_match(name, '[0-9A-Fa-f]{{24}}') THEN 'segment' WHEN suffix(name, '.partial') THEN 'partial'
 WHEN regexp_full_match(name, '[0-9A-Fa-f]{{8}}\\.history') THEN 'history' ELSE 'other' END AS kind FROM ({NAMED}) n""")
def file_kinds(spark, sf_dir):
    return aggregates.file_kinds(_mixed_names(spark, sf_dir))


@query("scan_segment_catalog", ["d2_catalog"], f"""
SELECT name, CASE WHEN regexp_full_match(name, '[0-9A-Fa-f]{{24}}') THEN 'complete' WHEN suffix(name, '.partial') THEN 'partial' ELSE 'history' END AS state,
 CAST(concat('0x', substr(name, 1, 8)) AS BIGINT) AS timeline,
 CASE WHEN NOT suffix(name, '.history') AND regexp_full_match(name, '[0-9A-Fa-f]{{24}}(\\.partial)?') THEN CAST(concat('0x', substr(name, 9, 8)) AS BIGINT) * 256 + CAST(concat('0x', substr(name, 17, 8)) AS BIGINT) END AS seg_no
FROM ({NAMED}) n WHERE regexp_full_match(name, '[0-9A-Fa-f]{{24}}') OR suffix(name, '.partial') OR regexp_full_match(name, '[0-9A-Fa-f]{{8}}\\.history')""")
def scan_catalog(spark, sf_dir):
    return catalog_rows(_mixed_names(spark, sf_dir)).select("name", "state", F.coalesce("timeline", F.conv(F.substring("name", 1, 8), 16, 10).cast("bigint")).alias("timeline"), "seg_no")


@query("list_segments", ["d2_catalog"], "SELECT name FROM d2_catalog WHERE length(name) = 24 ORDER BY name")
def list_segments(spark, sf_dir):
    return ordering.list_segments(catalog(spark, sf_dir))


@query("highest_segment", ["d2_catalog"], "SELECT max(name) AS name FROM d2_catalog WHERE length(name) = 24")
def highest_segment(spark, sf_dir):
    return ordering.highest_segment(catalog(spark, sf_dir))


@query("catalog_summary", ["d2_catalog"], """
SELECT CAST(timeline AS BIGINT) AS timeline, count(*) AS segments, min(name) AS first_name, max(name) AS last_name, (max(seg_no) + 1) * 16777216 AS high_lsn,
 (SELECT (seg_no + 1) * 16777216 FROM d2_catalog WHERE length(name) = 24 ORDER BY name DESC LIMIT 1) AS resume_lsn
FROM d2_catalog WHERE length(name) = 24 GROUP BY timeline""")
def catalog_summary(spark, sf_dir):
    return aggregates.catalog_summary(catalog(spark, sf_dir))


RETENTION = """SELECT name, CASE WHEN row_number() OVER (PARTITION BY timeline ORDER BY name DESC) <= {} THEN 'keep' ELSE 'delete' END AS action
 FROM d2_catalog WHERE length(name) = 24"""


@query("retention_plan", ["d2_catalog"], RETENTION.format(32))
def retention_plan(spark, sf_dir):
    return ordering.retention_plan(catalog(spark, sf_dir).select("name"), 32)


@query("retention_plan_deep", ["d2_catalog"], RETENTION.format(1500))
def retention_plan_deep(spark, sf_dir):
    return ordering.retention_plan(catalog(spark, sf_dir).select("name"), 1500)


@query("at_or_after_redo", ["d2_catalog"], f"SELECT name FROM d2_catalog WHERE name >= '{REDO}'")
def at_or_after_redo(spark, sf_dir):
    return filters.at_or_after_redo(catalog(spark, sf_dir).select("name"), REDO)


@query("missing_segments", ["d2_catalog"], f"SELECT name FROM d2_catalog WHERE length(name) = 24 AND name >= '{REDO}' AND missing_locally")
def missing_segments(spark, sf_dir):
    archive = catalog(spark, sf_dir)
    return joins.missing_segments(archive, archive.where(~F.col("missing_locally")), REDO)


@query("missing_segments_of_timeline", ["d2_catalog"],
       f"SELECT name FROM d2_catalog WHERE length(name) = 24 AND name >= '{REDO}' AND missing_locally AND timeline = 1")
def missing_segments_of_timeline(spark, sf_dir):
    archive = catalog(spark, sf_dir)
    return joins.missing_segments(archive, archive.where(~F.col("missing_locally")), REDO, per_timeline=True)


@query("replay_horizon", ["d2_catalog"], """
WITH m AS (SELECT seg_no, seg_no - row_number() OVER (ORDER BY seg_no) AS island FROM d2_catalog WHERE timeline = 1 AND length(name) = 24 AND seg_no >= 1024),
r AS (SELECT max(seg_no) AS last FROM m WHERE island = (SELECT island FROM m WHERE seg_no = 1024))
SELECT CAST(1 AS BIGINT) AS timeline, CAST(1024 AS BIGINT) AS redo_seg, last AS last_reachable, coalesce(last, 1023) + 1 AS first_missing,
 coalesce(last - 1023, 0) AS reachable, (SELECT count(*) FROM m) - coalesce(last - 1023, 0) AS unreachable FROM r""")
def replay_horizon(spark, sf_dir):
    return ordering.replay_horizon(catalog(spark, sf_dir), REDO)


@query("timeline_path", ["d2_catalog"], """
SELECT name, seg_no * 16777216 AS start_lsn, (seg_no + 1) * 16777216 AS end_lsn FROM d2_catalog WHERE length(name) = 24 AND (
 (timeline = 1 AND (seg_no + 1) * 16777216 <= 335544320) OR (timeline = 2 AND (seg_no + 1) * 16777216 > 335544320 AND (seg_no + 1) * 16777216 <= 805306368)
 OR (timeline = 3 AND (seg_no + 1) * 16777216 > 805306368))""")
def timeline_path(spark, sf_dir):
    history = ordering.parse_history(derived(spark, sf_dir, "d18_history"))
    return ordering.timeline_path(catalog(spark, sf_dir).select("name"), history)


@query("catalog_diff", ["d2_catalog"], """
SELECT name, 'only_a' AS side FROM d2_catalog WHERE missing_locally UNION ALL
SELECT name, 'only_b' FROM d2_catalog WHERE seg_no % 41 = 7 AND NOT missing_locally UNION ALL
SELECT name, 'only_b' FROM d2_catalog WHERE seg_no % 41 = 7 AND missing_locally AND 1 = 0""")
def catalog_diff(spark, sf_dir):
    names = catalog(spark, sf_dir)
    present = names.where(~F.col("missing_locally"))
    b = present.select("name").unionByName(present.where(F.col("seg_no") % 41 == 7).select("name"))
    return sets.catalog_diff(names.select("name"), b)


@query("survivors", ["d2_catalog"], "SELECT DISTINCT name FROM d2_catalog WHERE missing_locally")
def survivors(spark, sf_dir):
    names = catalog(spark, sf_dir)
    return sets.survivors(names, names.where(~F.col("missing_locally")))


COVERAGE_SQL = """
WITH p AS (SELECT CAST(timeline AS BIGINT) AS timeline, s.seg_no, greatest(start_lsn, s.seg_no * 16777216) AS lo, least(start_lsn + n_bytes, (s.seg_no + 1) * 16777216) AS hi
 FROM d15_chunks, LATERAL (SELECT unnest(generate_series(start_lsn // 16777216, (start_lsn + n_bytes - 1) // 16777216)) AS seg_no) s),
q AS (SELECT *, max(hi) OVER (PARTITION BY timeline, seg_no ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT timeline, seg_no, concat(lpad(hex(timeline), 8, '0'), lpad(hex(seg_no // 256), 8, '0'), lpad(hex(seg_no % 256), 8, '0')) AS name,
 CAST(sum(greatest(hi - greatest(lo, coalesce(reach, 0)), 0)) AS BIGINT) AS bytes, min(lo) AS first_lsn, max(hi) AS last_lsn,
 max(hi) = (seg_no + 1) * 16777216 AS sealed, sum(greatest(hi - greatest(lo, coalesce(reach, 0)), 0)) = 16777216 AS covered
FROM q GROUP BY timeline, seg_no"""


@query("segment_coverage", ["d15_chunks"], COVERAGE_SQL)
def segment_coverage(spark, sf_dir):
    return aggregates.segment_coverage(derived(spark, sf_dir, "d15_chunks"))


@query("assemble_segments", ["d15_chunks"], f"SELECT timeline, seg_no, name, bytes, sealed, covered FROM ({COVERAGE_SQL}) c WHERE sealed")
def assembled_segments(spark, sf_dir):
    """Segments put together by a stream over the chunks; the newest row of each."""
    base, session = scratch_path(spark, "assembly"), spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = derived(spark, sf_dir, "d15_chunks").select("timeline", "start_lsn", "n_bytes")
    stream = in_batches(chunks, 2, session=session)
    keep = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/states/part={batch}")
    (assemble_segments(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    newest = F.max_by(F.struct("name", "bytes", "sealed", "covered"), "batch")
    return spark.read.parquet(f"{base}/states").groupBy("timeline", "seg_no").agg(newest.alias("s")).select("timeline", "seg_no", "s.*")


# Archive files on storage: one segment per supplier, on two timelines; every third one is there locally.
STORED_SQL = """s AS (SELECT s_suppkey AS no, concat(lpad(hex(1 + s_suppkey % 2), 8, '0'), lpad(hex(s_suppkey // 256), 8, '0'), lpad(hex(s_suppkey % 256), 8, '0')) AS name,
 s_name AS content, s_suppkey % 3 = 0 AS here FROM supplier)"""


def stored_archive(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of an archive and of a local copy with gaps, written by tasks."""
    archive, local = (scratch_path(spark, x) for x in ("archive", "local"))
    no = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(segment_name(no * (1 << 24), 1 + no % 2).alias("name"), F.col("s_name").alias("content"), (no % 3 == 0).alias("here"))

    def write(batches):
        for batch in batches:
            for name, content, here in zip(batch["name"], batch["content"], batch["here"]):
                for folder in (archive, local) if here else (archive,):
                    system, inside = open_path(folder)
                    system.create_dir(inside)
                    store_file(f"{folder}/{name}", content.encode())
            yield batch[["name"]]

    rows.repartition(4).mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return archive, local


@query("scan_segment_catalog", [], f"WITH {STORED_SQL} SELECT name, 'complete' AS state, 1 + no % 2 AS timeline, no AS seg_no, length(content) AS length FROM s")
def stored_catalog(spark, sf_dir):
    return scan_segment_catalog(spark, stored_archive(spark, sf_dir)[0]).select("name", "state", "timeline", "seg_no", "length")


@query("fetch_segments", [], f"WITH {STORED_SQL} SELECT name, length(content) AS length, md5(content) AS digest FROM s WHERE here")
def fetched_segments(spark, sf_dir):
    archive, local = stored_archive(spark, sf_dir)
    found = fetch_segments(spark, archive, scan_segment_catalog(spark, local).select("name"))
    return found.select("name", "length", F.md5("content").alias("digest"))


@query("copy_missing_segments", [], f"""WITH {STORED_SQL} SELECT name, true AS fetched, CAST(NULL AS VARCHAR) AS error, md5(content) AS digest FROM s
WHERE NOT here AND name >= '00000001000000000000000A'""")
def copied_segments(spark, sf_dir):
    """What was copied, with the digest of what is in the local folder afterwards."""
    archive, local = stored_archive(spark, sf_dir)
    report = cut_lineage(copy_missing_segments(spark, archive, local, "00000001000000000000000A"))
    return report.join(fetch_segments(spark, local, report).select("name", F.md5("content").alias("digest")), "name")


@query("apply_retention", [], f"""WITH {STORED_SQL}, r AS (SELECT name, row_number() OVER (PARTITION BY substr(name, 1, 8) ORDER BY name DESC) AS rn FROM s)
SELECT name, CASE WHEN rn <= 8 THEN 'keep' ELSE 'delete' END AS action, rn > 8 AS deleted, rn <= 8 AS still_there FROM r""")
def applied_retention(spark, sf_dir):
    archive, _ = stored_archive(spark, sf_dir)
    done = apply_retention(spark, archive, 8, dry_run=False)
    left = scan_segment_catalog(spark, archive).select("name", F.lit(True).alias("there"))
    return done.join(left, "name", "left").select("name", "action", "deleted", F.coalesce("there", F.lit(False)).alias("still_there"))


@query("timeline_path_alone", ["d2_catalog"], """
SELECT timeline, name, seg_no * 16777216 AS start_lsn, (seg_no + 1) * 16777216 AS end_lsn FROM d2_catalog
WHERE name NOT LIKE '%.partial' AND timeline = (SELECT min(timeline) FROM d2_catalog WHERE name NOT LIKE '%.partial')""")
def timeline_path_alone(spark, sf_dir):
    """No history file: the oldest timeline from its beginning."""
    none = spark.createDataFrame([], "timeline bigint, parent_tli bigint, switch_lsn bigint")
    path = ordering.timeline_path(catalog(spark, sf_dir).select("timeline", "name"), none)
    return path.select("timeline", "name", "start_lsn", "end_lsn")
