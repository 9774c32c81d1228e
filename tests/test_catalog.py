import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, filters, joins, ordering, sets

SEG = 16 << 20


def names(spark, listed):
    return spark.createDataFrame([(n,) for n in listed], "name string")


def seg(timeline, no):
    return f"{timeline:08X}{no // 256:08X}{no % 256:08X}"


def deleted(spark, listed, keep):
    return sorted(r.name for r in ordering.retention_plan(names(spark, listed), keep).where("action = 'delete'").collect())


def test_retention(spark):
    forty = [seg(1, i) for i in range(40)]
    assert deleted(spark, forty, 32) == forty[:8]
    ten = [seg(1, i) for i in range(10)]
    assert deleted(spark, [*ten, seg(1, 10) + ".partial", "00000002.history"], 5) == ten[:5]
    two = [seg(t, i) for t in (1, 2) for i in range(20)]
    assert deleted(spark, two, 10) == [seg(1, i) for i in range(10)] + [seg(2, i) for i in range(10)]
    assert deleted(spark, ten[:5], 32) == []
    kept = ordering.retention_plan(names(spark, forty), 32).where("action = 'keep'").select("name")
    assert ordering.retention_plan(kept, 32).where("action = 'delete'").isEmpty()


@pytest.mark.parametrize("blocks", ["1", "5"])
def test_retention_compares_names_as_text(spark, blocks):
    spark.conf.set("spark.tidemark.scanBlocks", blocks)
    try:
        listed = [f"00000001{0:08X}{i:06X}{end}" for i in range(3) for end in ("aa", "F8", "0b", "F8")]
        kept = sorted(set(listed))[-4:]
        assert deleted(spark, listed, 4) == sorted(n for n in listed if n not in kept)
    finally:
        spark.conf.unset("spark.tidemark.scanBlocks")


def test_retention_keeps_at_least_one(spark):
    with pytest.raises(ValueError):
        ordering.retention_plan(names(spark, []), 0)


def test_retention_beyond_the_window_limit(spark, blocks):
    many = [seg(t, i) for t in (1, 2) for i in range(1300)]
    assert deleted(spark, many, 1200) == [seg(1, i) for i in range(100)] + [seg(2, i) for i in range(100)]


def test_resume_point(spark):
    listed = ["000000010000000000000001", "0000000100000000000000022", "000000010000000000000003.partial", "notes.txt", "000000020000000000000000"]
    rows = aggregates.catalog_summary(names(spark, listed)).orderBy("timeline").collect()
    # the later timeline wins although its position is lower
    assert [(r.timeline, r.segments, r.high_lsn, r.resume_lsn) for r in rows] == [(1, 1, 2 * SEG, SEG), (2, 1, SEG, SEG)]
    assert ordering.highest_segment(names(spark, [])).first().name is None
    assert [r.name for r in ordering.list_segments(names(spark, listed)).collect()] == [listed[0], listed[4]]


def test_missing_at_or_after_redo(spark):
    archive = names(spark, [seg(1, i) for i in range(6)] + [seg(2, 0), seg(1, 9) + ".partial"])
    local = names(spark, [seg(1, 4)])
    got = sorted(r.name for r in joins.missing_segments(archive, local, seg(1, 3)).collect())
    assert got == [seg(1, 3), seg(1, 5), seg(2, 0)]
    assert sorted(r.name for r in joins.missing_segments(archive, local, seg(1, 3), per_timeline=True).collect()) == [seg(1, 3), seg(1, 5)]
    assert filters.at_or_after_redo(archive, seg(2, 0)).count() == 1


def test_replay_stalls_at_a_gap(spark):
    h = ordering.replay_horizon(names(spark, [seg(1, i) for i in (3, 4, 5, 5, 7, 8)] + [seg(2, 6)]), seg(1, 4)).first()
    assert (h.last_reachable, h.first_missing, h.reachable, h.unreachable) == (5, 6, 2, 2)
    h = ordering.replay_horizon(names(spark, [seg(1, 5)]), seg(1, 4)).first()
    assert (h.last_reachable, h.first_missing, h.reachable, h.unreachable) == (None, 4, 0, 1)
    h = ordering.replay_horizon(names(spark, []), seg(1, 4)).first()
    assert (h.first_missing, h.reachable, h.unreachable) == (4, 0, 0)


def test_timeline_path_follows_ancestors(spark):
    history = spark.createDataFrame([(2, 1, 3 * SEG + 100)], "timeline bigint, parent_tli bigint, switch_lsn bigint")
    catalog = names(spark, [seg(1, i) for i in range(6)] + [seg(2, i) for i in (3, 4)])
    got = sorted(r.name for r in ordering.timeline_path(catalog, history).collect())
    # the segment with the switch point comes from the child
    assert got == [seg(1, 0), seg(1, 1), seg(1, 2), seg(2, 3), seg(2, 4)]


def test_diff_and_survivors(spark):
    a, b = names(spark, ["x", "y", "y"]), names(spark, ["y", "z"])
    assert sorted((r.name, r.side) for r in sets.catalog_diff(a, b).collect()) == [("x", "only_a"), ("y", "only_a"), ("z", "only_b")]
    assert sets.catalog_diff(a, a).isEmpty()
    assert [r.name for r in sets.survivors(a, b).collect()] == ["x"]


def coverage(spark, chunks):
    df = spark.createDataFrame(chunks, "timeline int, start_lsn bigint, n_bytes bigint")
    return {r.seg_no: r for r in aggregates.segment_coverage(df).collect()}


def test_coverage(spark):
    tail = coverage(spark, [(1, SEG - 100, 200)])
    assert (tail[0].sealed, tail[0].covered, tail[0].bytes, tail[0].last_lsn) == (True, False, 100, SEG)
    assert (tail[1].sealed, tail[1].bytes, tail[1].last_lsn) == (False, 100, SEG + 100)
    whole = coverage(spark, [(1, 0, SEG // 2), (1, SEG // 4, SEG), (None, 0, SEG), (1, 0, 10), (1, 2 * SEG, 3 * SEG)])
    assert (whole[0].covered, whole[0].name) == (True, seg(1, 0))
    assert whole[1].bytes == SEG // 4 and [whole[i].covered for i in (2, 3, 4)] == [True] * 3


def test_coverage_does_not_depend_on_chunking(spark):
    one = coverage(spark, [(1, 1000, 2 * SEG)])
    many = coverage(spark, [(1, 1000 + i * (SEG // 8), SEG // 8 + (7 if i < 15 else 0)) for i in range(16)])
    assert {k: r.asDict() for k, r in one.items()} == {k: r.asDict() for k, r in many.items()}


def test_order_and_progress(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 1)], "source string, seq bigint, lsn bigint")
    assert [(r.source, r.seq, r.prev_lsn) for r in ordering.order_violations(df).collect()] == [("a", 3, 5)]
    progress = ordering.flush_progress(df.withColumnRenamed("source", "slot")).orderBy("slot", "seq").collect()
    assert [r.flush_lsn for r in progress] == [5, 5, 5, 1]


def test_percentile_index_rule(spark):
    df = spark.createDataFrame([("g", v) for v in (40, 10, 30, 20)] + [("h", 7)], "g string, x bigint")
    rows = {r.g: tuple(r)[1:] for r in aggregates.index_percentiles(df, "g", "x").collect()}
    assert rows == {"g": (4, 30, 40, 40, 40), "h": (1, 7, 7, 7, 7)}


def test_noise_floor_and_decision(spark):
    base = spark.createDataFrame([(165.8,), (167.7,), (167.6,)], "mb double")
    floors = aggregates.noise_floor(base, ["mb"])
    row = floors.first()
    assert round(row.mb_mean, 1) == 167.0 and round(row.mb_floor, 3) == 0.007
    variants = spark.createDataFrame([("zstd", 187.9), ("off", 181.9), ("flush", 165.9), ("cool", 167.9), ("good", 100.0)], "v string, mb double")
    got = {r.v: r.decision for r in aggregates.ship_decision(variants, floors, "mb").collect()}
    assert got == {"zstd": "no-ship", "off": "no-ship", "flush": "noise", "cool": "noise", "good": "ship"}
    pct = {r.v: round(r.mb_pct, 1) for r in joins.compare_variants(variants, base, ["mb"]).collect()}
    assert (pct["zstd"], pct["off"], pct["flush"]) == (12.5, 8.9, -0.7)
    two = aggregates.noise_floor(base.limit(2), ["mb"]).first()
    assert two.mb_floor is None


def test_soak(spark):
    df = spark.createDataFrame([("ok", 100, 5, 1, 0), ("ok", 199, 14, 0, (64 << 20) - 1), ("bad", 100, 5, 2, 64 << 20), ("bad", 200, 15, 0, 0)],
                               "run string, rss_kb bigint, fds bigint, partials int, lag_bytes bigint")
    rows = {r.run: (r.rss_ok, r.fds_ok, r.partials_ok, r.lag_ok, r.passed) for r in aggregates.soak_check(df).collect()}
    assert rows == {"ok": (True,) * 5, "bad": (False,) * 5}


def test_active_sessions(spark):
    df = spark.createDataFrame([(1, 10, "client backend", "active"), (1, 11, "client backend", "idle"), (1, 12, "walsender", "active"), (1, 13, "client backend", "active"),
                                (2, None, None, None), (3, 10, "client backend", "active")], "snapshot int, pid bigint, backend_type string, state string")
    got = {r.snapshot: r.active for r in aggregates.active_sessions(df, own_pid=10).collect()}
    assert got == {1: 1, 2: None, 3: 0}


def test_pooler_cost(spark):
    df = spark.createDataFrame([("tls", 1, 0, 350, 0.0, 10.0, 718.0), ("tls", 2, 0, 670, 0.0, 10.0, 1272.0), ("tls", 3, 0, 10, 0.0, 10.0, 0.0)],
                               "series string, poolers int, ticks0 bigint, ticks1 bigint, t0 double, t1 double, tps double")
    one, two, idle = aggregates.pooler_cost(df).orderBy("poolers").collect()
    assert round(one.cores, 2) == 0.35 and round(one.us_per_txn, 1) == 487.5 and one.efficiency == 1.0
    assert round(two.per_pooler, 3) == 0.335 and round(two.efficiency, 3) == 0.886 and idle.us_per_txn is None


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "lsn bigint")
    row = aggregates.stream_stats(none, none, none).first()
    assert tuple(row) == (0, 0, "0/00000000", 0)


def test_divergence(spark):
    flush = spark.createDataFrame([("aggressive", 1000, 3), ("aggressive", 2000, 4), ("throttled", 100, 1)], "profile string, bytes_uploaded bigint, packs_uploaded bigint")
    dead = spark.createDataFrame([("aggressive", 85), ("throttled", 85)], "profile string, n_dead_tup bigint")
    after = spark.createDataFrame([("aggressive", 0), ("throttled", 85)], "profile string, n_dead_tup bigint")
    rows = {r.profile: (r.bytes, r.packs, r.dead_before, r.dead_after, r.bytes_ratio) for r in aggregates.divergence_report(flush, dead, after, "throttled").collect()}
    assert rows == {"aggressive": (3000, 7, 85, 0, 30.0), "throttled": (100, 1, 85, 85, 1.0)}
    assert aggregates.service_availability(spark.createDataFrame([("a", True), ("a", False)], "phase string, ok boolean")).first().error_rate == 0.5


def test_path_without_history(spark):
    listed = names(spark, [seg(2, 0), seg(2, 1), seg(3, 1)])
    none = spark.createDataFrame([], "timeline bigint, parent_tli bigint, switch_lsn bigint")
    assert sorted(r.name for r in ordering.timeline_path(listed, none).collect()) == [seg(2, 0), seg(2, 1)]
    assert [r.name for r in ordering.timeline_path(listed, none, latest=3).collect()] == [seg(3, 1)]
    assert ordering.timeline_path(listed.limit(0), none).count() == 0
