"""Alarms in stretches against one fold over all rows, and lines that are delivered again."""

import random

import pytest
from pyspark.sql import functions as F

from plantlens.operators import skew
from plantlens.operators.automaton import alarm_verdicts, steps
from plantlens.operators.classify import classify, with_first
from plantlens.operators.facts import facts
from plantlens.streaming.ledger import Ledger
from plantlens.streaming.stream import ingest_all
from tests.test_classifier import alarm, categories, frame, message, model, stream


def fold(rows, phase=None, at=None):
    out = []
    for new, ts in rows:
        ok = new == ("CLEAR" if phase == "RAISE" else "RAISE") and (at is None or ts >= at)
        out.append((ok, phase, at))
        if ok:
            phase, at = new, ts
    return out, (phase, at)


def random_rows(rng, n):
    return [(rng.choice(["RAISE", "CLEAR"]), 10 * i + rng.randrange(-60, 60)) for i in range(n)]


def test_steps_are_the_fold_from_every_state():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, *[12] * 200, 400]:
        rows = random_rows(rng, n)
        found = steps([p for p, _ in rows], [t for _, t in rows])
        times = {t + d for _, t in rows for d in (-1, 0, 1)} | {0}
        for phase in ("RAISE", "CLEAR"):
            limits, phases, ats = found["CLEAR" if phase == "RAISE" else "RAISE"]
            assert limits == sorted(limits) and (n < 400 or len(limits) < 8)
            for at in times:
                step = next((k for k, limit in enumerate(limits) if limit >= at), None)
                assert fold(rows, phase, at)[1] == ((phases[step], ats[step]) if step is not None else (phase, at))


@pytest.mark.parametrize("stretch", [1, 7, 100, 10_000])
def test_stretches_are_one_line(spark, stretch):
    rng = random.Random(2)
    keys = {(tag, code): random_rows(rng, n) for tag, code, n in (("a", "x", 300), ("a", "y", 1), ("b", "x", 40))}
    carried = {("a", "x"): ("RAISE", 1500), ("c", "x"): ("RAISE", 5)}
    rows = [(*key, p, t, 3 * i, f"f{i % 2}", i) for key, line in keys.items() for i, (p, t) in enumerate(line)]
    schema = "tag string, alarm_code string, phase string, ts_us long, arrival_id long, file string, line long"
    carry = spark.createDataFrame([(*k, *v) for k, v in carried.items()], "tag string, alarm_code string, phase string, ts_us long")
    for before in (None, carry):
        want = {(key, i): r for key, line in keys.items() for i, r in enumerate(fold(line, *(carried.get(key, (None, None)) if before is not None else (None, None)))[0])}
        for key in keys:
            own = spark.createDataFrame([r for r in rows if r[:2] == key], schema).repartition(3)
            got = {r.line: (r.alarm_ok, r.last_phase, r.last_us) for r in alarm_verdicts(own, before, ["arrival_id", "file", "line"], stretch).collect()}
            assert got == {i: r for (k, i), r in want.items() if k == key}


def test_one_key_spreads_over_all_tasks(spark):
    from plantlens.plans.catalog import LINE_STRETCH, events

    n = events(spark, "/root/testdata/sf0.1").count()
    rows = events(spark, "/root/testdata/sf0.1").select(F.lit("a").alias("tag"), F.lit("x").alias("alarm_code"), F.when(F.col("seq") % 3 == 0, "CLEAR").otherwise("RAISE").alias("phase"), F.col("seq").alias("ts_us"), F.col("log_id").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        by_task = alarm_verdicts(rows, None, ["line"], LINE_STRETCH).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_task) == 8 and max(r["count"] for r in by_task) < n / 4


def test_lines_delivered_again_in_one_batch(spark):
    rows = [(1, message(1, 10, good_delta=5, reject_delta=0)), (2, alarm(2, 20, "RAISE")), (3, alarm(3, 30, "CLEAR")), (4, "{"), (5, message(5, 40, tag="X"))]
    for parts in (1, 3):
        got = classify(spark.createDataFrame([r for r in rows for _ in range(3)], "arrival_id long, raw_payload string").repartition(parts))
        assert got.count() == 15 and facts(got, "COUNT").agg(F.sum("good_delta")).first()[0] == 5 and facts(got, "ALARM").count() == 2
        count = {(r.arrival_id, r.category): r["count"] for r in got.groupBy("arrival_id", "category").count().collect()}
        assert count == {(k, c): n for k in (1, 2, 3) for c, n in (("accepted", 1), ("duplicate", 2))} | {(4, "bad_payload"): 3, (5, "unknown_tag"): 3}


def test_other_content_under_the_same_arrival_id(spark):
    rows = [(1, message(1, 10), "b"), (1, message(1, 11), "a"), (1, message(1, 10), "c")]
    got = classify(spark.createDataFrame(rows, "arrival_id long, raw_payload string, file string").repartition(2))
    assert [r.category for r in got.orderBy("file").collect()] == ["accepted", "seq_conflict", "seq_conflict"]


def test_a_file_copied_within_one_batch(spark, tmp_path):
    drop, args = tmp_path / "drop", (str(tmp_path / "drop"), str(tmp_path / "ledger"), str(tmp_path / "check"))
    drop.mkdir()
    raws = stream(21, 80)
    lines = "".join(f"{i}\t{r}\n" for i, r in enumerate(raws))
    for name in "abc":
        (drop / f"{name}.txt").write_text(lines)
    ingest_all(spark, *args)
    rows = Ledger(spark, args[1]).read()
    assert rows.count() == 240
    in_a = rows.where(F.col("file").endswith("/a.txt"))
    want = model([r for r in raws for _ in range(3)])
    assert sorted((r.arrival_id, r.category) for r in rows.collect()) == sorted((k // 3, c) for k, c in enumerate(want))
    assert categories(in_a) == want[::3] and [r.line for r in in_a.orderBy("arrival_id").collect()] == sorted(r.line for r in in_a.collect())


def test_a_hot_seq_is_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 3)
    rows = [(i, "", 0, i, [7, 7, 7, i][i % 4], "same" if i % 3 else "other") for i in range(200)]
    frame_ = spark.createDataFrame(rows, "arrival_id long, file string, block long, line long, seq long, content_hash string").repartition(4)
    seen = spark.createDataFrame([(3, "old"), (11, "other")], "seq long, seen_hash string")
    for before, known in ((None, {}), (seen, {3: "old", 11: "other"})):
        first = {}
        for a, *_, seq, digest in rows:
            first.setdefault(seq, (a, digest))
        want = [(a, a == first[seq][0] and seq not in known, known.get(seq, first[seq][1])) for a, *_, seq, _ in rows]
        assert sorted((r.arrival_id, r.is_first, r.first_hash) for r in with_first(frame_, before).collect()) == want


def test_random_streams_with_redelivery(spark):
    raws = stream(5, 150)
    again = [(i, r, f) for f in ("x", "y") for i, r in enumerate(raws) if f == "x" or i % 3]
    got = classify(spark.createDataFrame(again, "arrival_id long, raw_payload string, file string").repartition(5))
    in_order = sorted(again, key=lambda r: (r[0], r[2]))
    assert [r.category for r in got.orderBy("arrival_id", "file").collect()] == model([r for _, r, _ in in_order])
    assert categories(classify(frame(spark, raws))) == model(raws)
