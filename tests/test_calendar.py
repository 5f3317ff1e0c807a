"""Windows of any calendar against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantlens.operators import calendar as c
from plantlens.plans import catalog

BASE = datetime(2024, 1, 1)
SECOND = 1_000_000
US = int((BASE - datetime(1970, 1, 1)).total_seconds()) * SECOND


def windows_of(rng):
    out = []
    for machine in "ab":
        for k in range(12):
            s = rng.randrange(0, 50_000)
            out.append((machine, f"S{k // 2}", k % 2, US + s * SECOND, US + (s + rng.choice([1, 60, 5_000, 40_000])) * SECOND))
    return out + [("c", "alone", 0, US, US + SECOND)]


def calendar_frame(spark, windows):
    return spark.createDataFrame(windows, "machine string, shift string, part int, s_us long, e_us long").repartition(3)


def at(second):
    return BASE + timedelta(seconds=second)


def test_windows_meet_what_overlaps_them_once(spark):
    rng = random.Random(1)
    windows = windows_of(rng)
    states = [(m, at(rng.randrange(60_000)), rng.choice(["RUN", "DOWN", "IDLE"]), f"R{i % 3}", i) for i in range(60) for m in "abd"]
    ticks = [(m, at(rng.randrange(-10, 60_000)), 1, 2) for _ in range(300) for m in "abd"]
    frame = calendar_frame(spark, windows)
    spans = catalog.segments.segments(spark.createDataFrame(states, "machine string, ts timestamp_ntz, state string, reason_code string, log_id long"))
    want, down = {}, {}
    for machine in "abd":
        own = sorted((int((t - BASE).total_seconds()) * SECOND + US, i, s, r) for m, t, s, r, i in states if m == machine)
        for (a, _, state, reason), following in zip(own, [*own[1:], None]):
            for m, shift, _, s, e in windows:
                low, high = max(a, s), min(following[0] if following else e, e)
                if m == machine and high > low:
                    want[m, shift, state] = want.get((m, shift, state), 0) + high - low
                    if state == "DOWN":
                        down[m, shift, reason] = down.get((m, shift, reason), 0) + high - low
    got = {(r.machine, r.shift, s): r[f"{s.lower()}_us"] for r in c.state_seconds(spans, frame).collect() for s in ("RUN", "DOWN", "IDLE") if r[f"{s.lower()}_us"]}
    assert got == want and {tuple(r)[:3]: r.us for r in c.downtime(spans, frame).collect()} == down
    found = {(r.machine, r.shift): (r.good, r.reject) for r in c.counts(spark.createDataFrame(ticks, "machine string, ts timestamp_ntz, good_delta int, reject_delta int"), frame).collect()}
    n = {}
    for m, t, *_ in ticks:
        us = int((t - BASE).total_seconds()) * SECOND + US
        for w, shift, _, s, e in windows:
            if w == m and s <= us < e:
                n[m, shift] = n.get((m, shift), 0) + 1
    assert found == {k: (v, 2 * v) for k, v in n.items()}


def test_coverage_of_windows(spark):
    rng = random.Random(2)
    windows = windows_of(rng)
    seen = {m: sorted({US + rng.randrange(60_000) * SECOND for _ in range(40)}) for m in "ab"}
    observed = spark.createDataFrame([(m, datetime(1970, 1, 1) + timedelta(microseconds=t)) for m, ts in seen.items() for t in ts], "machine string, ts timestamp_ntz")
    got = {(r.machine, r.shift, r.part): r for r in c.coverage(observed, calendar_frame(spark, windows), 600).collect()}
    assert len(got) == len(windows)
    for m, shift, part, s, e in windows:
        r, ts = got[m, shift, part], seen.get(m, [])
        gaps = [(b - a, -a, b) for a, b in zip(ts, ts[1:]) if b > s and a < e]
        worst = max(gaps, default=(0, -s, s))
        near = lambda edge: any(abs(t - edge) <= 600 * SECOND for t in ts)
        assert (r.s_us, r.e_us, r.start_ok, r.end_ok, r.n_observations) == (s, e, near(s), near(e), sum(s <= t <= e for t in ts))
        assert (r.max_gap_us, r.gap_from_us, r.gap_to_us, r.gaps_ok) == (worst[0], -worst[1], worst[2], worst[0] <= 600 * SECOND)


def test_a_shift_with_a_break_is_complete_without_it(spark):
    hour = 3600
    windows = calendar_frame(spark, [("a", "S", 0, US, US + 2 * hour * SECOND), ("a", "S", 1, US + 3 * hour * SECOND, US + 4 * hour * SECOND), ("b", "S", 0, US, US + hour * SECOND)])
    # silent in the break
    at_work = [300 * k for k in range(-1, 26)] + [300 * k for k in range(35, 50)]
    seen = spark.createDataFrame([("a", at(t)) for t in at_work], "machine string, ts timestamp_ntz")
    states = spark.createDataFrame([("a", at(-100), "RUN", None, 1), ("a", at(hour), "DOWN", "JAM", 2), ("a", at(3 * hour), "RUN", None, 3)], "machine string, ts timestamp_ntz, state string, reason_code string, log_id long")
    ticks = spark.createDataFrame([("a", at(k), 1, 0) for k in range(0, 5 * hour, 100)], "machine string, ts timestamp_ntz, good_delta int, reject_delta int")
    machines = spark.createDataFrame([("a", 50.0), ("b", 10.0)], "machine string, ideal_cycle_s double")
    rows = {r.machine: r for r in c.effectiveness(states, catalog.segments.segments(states), ticks, seen, machines, windows, 600).collect()}
    a = rows["a"]
    assert a.complete and (a.planned_seconds, a.run_seconds, a.down_seconds, a.good) == (3 * hour, 2 * hour, hour, 108)
    assert (a.availability, a.performance, a.quality) == (2 / 3, 108 * 50.0 / (2 * hour), 1.0)
    assert not rows["b"].complete and rows["b"].oee is None and rows["b"].run_seconds == 0


def test_empty_calendar_and_plan_without_nested_loops(spark):
    m = catalog.events(spark, "/root/testdata/sf0.001")
    none = calendar_frame(spark, windows_of(random.Random(3))).where("false")
    assert c.coverage(m, none, 600).count() == 0 and c.counts(catalog.of(m, "COUNT"), none).count() == 0
    plan = catalog.q_oee_by_calendar(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    complete = {r.complete for r in catalog.q_oee_by_calendar(spark, "/root/testdata/sf0.01").select("complete").collect()}
    assert complete == {True, False} and catalog.q_oee_by_calendar(spark, "/root/testdata/sf0.01").where(F.col("performance") > 0).count() > 0
