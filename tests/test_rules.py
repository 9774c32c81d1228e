import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import advice, decisions, filters, flow, joins, ratelimit
from tidemark.operators.scale import BLOCK, neighbour, running, scan, with_blocks

MIB = 1024 * 1024


def scale(ticks, workers=4, state=None):
    """Advice for ``(at_s, live, cores)`` ticks."""
    out, end = advice.scale_rule(pd.DataFrame(ticks, columns=["at_s", "live", "cores"]), state, workers)
    return out, end


def test_scaler_needs_two_hot_ticks_and_stops_at_the_ceiling():
    assert scale([(0, 1, None), (5, 1, 0.9), (10, 1, 0.9)])[0]["action"] == ["hold", "hold", "up"]
    out, _ = scale([(0, 4, 3.6), (5, 4, 3.6), (10, 4, 3.6)])
    assert out["action"] == ["hold"] * 3 and out["at_ceiling"] == [True] * 3
    assert scale([(0, 1, 0.75), (5, 1, 0.75)])[0]["action"] == ["hold"] * 2


def test_scaler_cooldowns():
    hot = [(5 * i, 1, 0.9) for i in range(10)]
    assert [i for i, a in enumerate(scale(hot)[0]["action"]) if a == "up"] == [1, 7]
    cold = [(5 * i, 2, 0.4) for i in range(20)]
    assert [i for i, a in enumerate(scale(cold)[0]["action"]) if a == "down"] == [5, 17]
    warm = [(0, 2, 0.4)] * 5 + [(25, 2, 1.4)] + [(30, 2, 0.4)] * 5
    assert "down" not in scale(warm)[0]["action"]
    assert "down" not in scale([(5 * i, 1, 0.0) for i in range(99)])[0]["action"]


def ticks_frame(spark, rows):
    return spark.createDataFrame(rows, "host int, pid bigint, tick bigint, cpu_ticks bigint")


def test_scaling_from_counters(spark):
    rows = [(1, 100, t, 90 * t) for t in range(3)]
    rows += [(2, 10, t, 90 * t) for t in range(3)] + [(2, 11, t, 90 * t) for t in range(3)]
    rows += [(3, 100, 0, 1000), (3, 100, 1, 1050), (3, 200, 1, 9_999_999)]
    out = advice.scale_decisions(ticks_frame(spark, rows), max_workers=2, tick_seconds=1).orderBy("host", "tick").collect()
    got = [(r.host, r.tick, r.action, r.aggregate_cores, r.at_ceiling) for r in out]
    assert got == [
        (1, 0, "hold", None, None), (1, 1, "hold", 0.9, False), (1, 2, "up", 0.9, False),
        (2, 0, "hold", None, None), (2, 1, "hold", 1.8, True), (2, 2, "hold", 1.8, True),
        (3, 0, "hold", None, None), (3, 1, "hold", 0.5, False)]
    assert [r.last_action for r in out][2] == "up"


def test_counter_rate_ignores_churn_and_resets(spark):
    rows = [(1, 1, 0, 10), (1, 1, 1, 15), (1, 2, 1, 7), (1, 1, 2, 3), (1, 2, 3, 9), (1, 1, 3, 5)]
    got = joins.counter_rate(ticks_frame(spark, rows)).orderBy("tick", "pid").collect()
    assert [(r.pid, r.tick, r.delta_ticks) for r in got] == [(1, 1, 5), (1, 2, 0), (1, 3, 2)]


@pytest.mark.parametrize("old,new,moves", [(735, 2016, True), (735, 880, False), (2016, 735, True), (2016, 2020, False), (735, 1887, True), (64, 200, False)])
def test_buffer_moves(old, new, moves):
    assert advice.buffers_moved_enough(old * MIB, new * MIB) is moves


def test_a_climb_restarts_once_after_it_settles():
    climb = [735, 863, 1119, 1375, 1631, 1887]
    samples = [(at, climb[min(at // 80, 5)] * MIB) for at in range(0, 900, 5)]
    out, _ = advice.memory_rule(pd.DataFrame(samples, columns=["at_s", "ram_bytes"]), None)
    assert [at for (at, _), r in zip(samples, out["restart"]) if r] == [490]
    assert [at for (at, _), r in zip(samples, out["reload"]) if r] == [80, 160, 240, 320, 400]


def test_five_percent_rule(spark):
    last = 4_096_000_000
    rows = [(1, 0, last), (1, 1, last + last * 4 // 100), (1, 2, last + last // 20), (1, 3, last + last * 6 // 100), (1, 4, last + last * 6 // 100), (1, 5, last)]
    df = spark.createDataFrame(rows, "host int, seq bigint, ram bigint")
    assert [r.seq for r in filters.significant_change(df, "ram", ["host"], ["seq"]).orderBy("seq").collect()] == [0, 3, 5]


def skewed_rows(n, seed=5):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        # overload, idle gaps, and a steady beat of one token per line
        phase = (i // 400) % 4
        at += {0: rng.randint(0, 900), 1: rng.randint(1500, 9000), 2: 2000, 3: rng.choice([300, 300, 300, 60_000])}[phase]
        out.append(("hot" if rng.random() < 0.7 else f"s{i % 3}", i, at))
    return out


@pytest.fixture(scope="module")
def lines(spark):
    rows = skewed_rows(6000)
    return rows, spark.createDataFrame(rows, "stream string, seq bigint, at_us bigint").cache()


def bucket(rows, rate, burst):
    state, out = {}, {}
    for stream, seq, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        tokens, last, dropped = state.get(stream, (burst * 10**6, at, 0))
        tokens = min(tokens + (at - last) * rate, burst * 10**6)
        ok = tokens >= 10**6
        out[stream, seq] = (ok, dropped if ok else 0)
        state[stream] = (tokens - 10**6 if ok else tokens, at, 0 if ok else dropped + 1)
    return out


@pytest.mark.parametrize("n", [1, 2, 9])
@pytest.mark.parametrize("burst", [50, 110])
def test_rate_limit_in_blocks_equals_one_pass(spark, lines, n, burst):
    rows, df = lines
    got = {(r.stream, r.seq): (r.passed, r.notice) for r in ratelimit.rate_limit(df, 500, burst, blocks=n).collect()}
    want = bucket(rows, 500, burst)
    assert got == want and any(not ok for ok, _ in want.values())


def test_notice_comes_before_the_line_that_passes(spark):
    rows = [("s", i, i, f"l{i}") for i in range(4)] + [("s", 4, 10_000_000, "l4"), ("s", 5, 10_000_001, "l5")]
    df = spark.createDataFrame(rows, "stream string, seq bigint, at_us bigint, line string")
    sent = ratelimit.limited_stream(ratelimit.rate_limit(df, 1, 2)).orderBy("seq", "part").collect()
    assert [r.line for r in sent] == ["l0", "l1", "[dropped 2 log lines]", "l4", "l5"]
    assert [r.dropped_count for r in sent] == [0, 0, 2, 0, 0]


@pytest.mark.parametrize("n", [3, 8])
def test_rules_in_blocks_equal_one_pass(spark, n):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else 2, i, 5 * i, rng.choice([735, 800, 1200, 1201, 2016]) * MIB if i % 40 == 0 else None) for i in range(600)]
    last, filled = 735 * MIB, []
    for host, i, at, ram in rows:
        last = ram or last
        filled.append((host, i, at, last))
    memory = spark.createDataFrame(filled, "host int, seq bigint, at_s bigint, ram_bytes bigint").cache()
    one, many = (sorted(map(tuple, advice.retune_advice(memory, blocks=b).collect())) for b in (1, n))
    assert one == many and any(r[5] for r in one)
    kept = [sorted(map(tuple, filters.significant_change(memory, "ram_bytes", ["host"], ["at_s", "seq"], blocks=b).collect())) for b in (1, n)]
    assert kept[0] == kept[1]
    cpu = [(1, p, t, 0) for t in range(150) for p in range(3)]
    total = {}
    counted = []
    for host, p, t, _ in cpu:
        total[p] = total.get(p, 0) + (rng.randint(0, 40) if (t // 30) % 2 else rng.randint(380, 520))
        counted.append((host, p, t, total[p]))
    samples = ticks_frame(spark, counted).cache()
    one, many = (sorted(map(tuple, advice.scale_decisions(samples, 5, blocks=b).collect())) for b in (1, n))
    assert one == many and {"up", "down"} <= {r[5] for r in one}


def ends_like_the_rule(summary, rule, rows, entries):
    """A block's map leads from every entry state to where the rule itself ends."""
    made = json.loads(json.dumps(summary.of(rows)))
    for entry in entries:
        assert summary.follow(made, entry) == json.loads(json.dumps(rule(rows, entry)[1])), entry


def test_maps_of_the_five_percent_rule():
    rng = random.Random(5)
    for trial in range(150):
        n = rng.randint(1, 40)
        x, kind = 1000.0, rng.choice(["walk", "rise", "noise", "jumps"])
        values = []
        for _ in range(n):
            x = {"walk": x * rng.uniform(0.96, 1.04), "rise": x * 1.013, "noise": rng.uniform(950, 1050), "jumps": rng.choice([700.0, 1000.0, 1049.0, 1051.0, 2000.0])}[kind]
            values.append(x)
        rows = pd.DataFrame({"v": values})
        entries = [None] + [{"kept": rng.uniform(500, 3000)} for _ in range(30)] + [{"kept": v} for v in values]
        ends_like_the_rule(filters.keep_summary("v", 5), lambda r, s: filters.keep_rule(r, s, "v", 5), rows, entries)
    long = pd.DataFrame({"v": [1000 + (i * 37) % 90 for i in range(5000)] + [2000]})
    ends_like_the_rule(filters.keep_summary("v", 5), lambda r, s: filters.keep_rule(r, s, "v", 5), long, [None, {"kept": 1045}, {"kept": 10}])


def test_maps_of_the_scaling_rule():
    rng = random.Random(6)
    for trial in range(60):
        at, ticks = 1000, []
        for _ in range(rng.randint(1, 30)):
            at += rng.choice([1, 5, 5, 5, 7, 70])
            live = rng.choice([0, 1, 2, 3, 4])
            ticks.append((at, live, rng.choice([None, live * 0.9, live * 0.9, live * 0.2, live * 0.2, 0.1])))
        rows = pd.DataFrame(ticks, columns=["at_s", "live", "cores"])
        entries = [None] + [{"hot": rng.randint(0, 2), "cold": rng.randint(0, 6), "acted": rng.choice([None, ticks[0][0] - rng.randint(1, 59)])} for _ in range(60)]
        ends_like_the_rule(advice.scale_summary(4), lambda r, s: advice.scale_rule(r, s, 4), rows, entries)


def test_maps_of_the_restart_rule():
    rng = random.Random(7)
    for trial in range(80):
        at, seen, moved, made = 1000, 735, 1000, []
        for _ in range(rng.randint(1, 60)):
            at += rng.choice([1, 5, 20, 60])
            if rng.random() < 0.15:
                seen, moved = rng.choice([735, 800, 1200, 2016, 4000]), at
            made.append((at, seen * MIB, seen * MIB, moved))
        rows = pd.DataFrame(made, columns=["at_s", "ram_bytes", "seen", "moved_at"])
        entries = [None] + [{"tuned": rng.choice([735, 900, 1200, 2016, 9000]) * MIB, "restarted": rng.choice([None, made[0][0] - rng.randint(1, 119)])} for _ in range(60)]
        ends_like_the_rule(advice.restart_summary(), advice.restart_rule, rows, entries)


def test_a_rising_series_needs_no_rounds(spark, monkeypatch):
    """Kept values of a steady rise differ with the start for ever: each block is read twice all the same."""
    monkeypatch.setattr(decisions, "rule_ends", None)
    rows = [(1, i, 5 * i, int(735 * MIB * 1.013 ** i)) for i in range(600)]
    memory = spark.createDataFrame(rows, "host int, seq bigint, at_s bigint, ram_bytes bigint").cache()
    for run in (lambda b: filters.significant_change(memory, "ram_bytes", ["host"], ["seq"], blocks=b), lambda b: advice.retune_advice(memory, blocks=b)):
        one, many = (sorted(map(tuple, run(b).collect())) for b in (1, 12))
        assert one == many and one
    kept = sum(advice.memory_rule(memory.orderBy("seq").toPandas(), None)[0]["reload"])
    assert kept == sum(r.reload for r in advice.retune_advice(memory, blocks=12).collect()) > 100


def test_retuning_equals_the_rule_row_by_row(spark):
    rng = random.Random(8)
    at, ram, rows = 0, 735, []
    for i in range(900):
        at += rng.choice([5, 5, 30])
        ram = rng.choice([735, 760, 800, 1200, 2016]) if rng.random() < 0.1 else ram
        rows.append((1, i, at, ram * MIB))
    memory = spark.createDataFrame(rows, "host int, seq bigint, at_s bigint, ram_bytes bigint").cache()
    want, _ = advice.memory_rule(memory.orderBy("seq").toPandas(), None)
    for blocks in (1, 7):
        got = advice.retune_advice(memory, blocks=blocks).orderBy("seq").collect()
        assert {c: [r[c] for r in got] for c in want} == want and any(want["restart"])


@pytest.mark.parametrize("n", [1, 4, 11, 60])
def test_scans_in_blocks(spark, n):
    rng = random.Random(n)
    # two thirds of the rows in one group, and a run of equal order values
    rows = [("hot" if rng.random() < 0.66 else f"g{i % 5}", rng.choice([7, rng.randint(0, 40)]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at int, seq bigint, v int").cache()
    outputs = {k: (k, F.col("v").cast("bigint")) for k in ("sum", "max", "min", "last")}
    place = scan(df, ["g"], ["at", "seq"], n).number("rn").running(outputs)
    place = place.neighbour({"prev": F.col("v")}).neighbour({"next": F.col("v")}, following=True).done()
    got = {r.seq: (r.rn, r["sum"], r["max"], r["min"], r["last"], r.prev, r.next) for r in place.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            seen = [x[3] for x in mine[:i + 1] if x[3] is not None]
            want[r[2]] = (i + 1, sum(seen) if seen else None, max(seen, default=None), min(seen, default=None), seen[-1] if seen else None,
                          mine[i - 1][3] if i else None, mine[i + 1][3] if i + 1 < len(mine) else None)
    assert got == want
    whole = running(df, [], ["at", "seq"], {"n": ("sum", F.lit(1).cast("bigint"))}, n)
    assert sorted(r.n for r in whole.collect()) == list(range(1, 301))
    assert neighbour(df, [], ["at", "seq"], {"p": F.col("seq")}, blocks=n).where("p IS NULL").count() == 1


def test_one_order_value_and_texts_are_cut_evenly(spark):
    """Ties of the first order column, one hot group, and orders that are texts: no block is large."""
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else "cold", "same", f"{i:06d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at string, seq string")
    cut, n = with_blocks(df, ["g"], ["at", "seq"], 16)
    sizes = {(r.g, r[BLOCK]): r["count"] for r in cut.groupBy("g", BLOCK).count().collect()}
    assert n == 16 and max(sizes.values()) < 2 * 4000 / 16 and len(sizes) >= 16
    numbered = scan(df, ["g"], ["at", "seq"], 16).number("rn").neighbour({"before": F.col("seq")}).done().collect()
    for g in (None, "hot", "cold"):
        mine = sorted((r for r in numbered if r.g == g), key=lambda r: r.seq)
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
        assert [r.before for r in mine] == [None] + [r.seq for r in mine[:-1]]


def test_crash_loops(spark):
    df = spark.createDataFrame([("p", 1, 5, 1), ("p", 2, 5, 1), ("p", 3, 60, 0), ("p", 4, 5, 1)], "process string, seq bigint, ran_s bigint, exit_code bigint")
    assert [(r.restart_streak, r.delay_ms) for r in flow.crash_loops(df).orderBy("seq").collect()] == [(1, 200), (2, 400), (0, 100), (1, 200)]


def test_heartbeats(spark):
    df = spark.sql("SELECT 'a' AS source, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts FROM VALUES (0), (30), (95) AS t(s)")
    got = [r.ts.second + 60 * r.ts.minute for r in flow.idle_heartbeats(df).orderBy("ts").collect()]
    assert got == [60, 90]


def test_backlog_and_lag(spark):
    events = spark.range(1, 101).select(F.col("id").alias("lsn"))
    progress = spark.createDataFrame([("a", 100), ("b", 36), ("c", 35), ("d", 0)], "subscriber string, lsn bigint")
    got = {r.subscriber: (r.pending, r.pruned) for r in flow.subscriber_backlog(events, progress).collect()}
    assert got == {"a": (0, False), "b": (64, False), "c": (65, True), "d": (100, True)}
    stats = spark.createDataFrame([("s", 1, 100, 50, 10), ("s", 2, 200 + (64 << 20), 199, 10), ("s", 3, 200 + (64 << 20), 300, 10)],
                                  "slot string, tick bigint, current_lsn bigint, flush_lsn bigint, restart_lsn bigint")
    rows = flow.replication_lag(stats).orderBy("tick").collect()
    assert [(r.lagging, r.pinned, r.over_cap) for r in rows] == [(False, False, False), (True, True, False), (False, False, False)]
    assert [r.caught_up for r in joins.caught_up(stats, 199).orderBy("tick").collect()] == [False, True, True]
