"""The kept grid after every batch against the grid of all facts so far."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantlens.operators import metrics
from plantlens.schema import Shifts
from plantlens.streaming import cells as kept
from plantlens.streaming.cells import Cells

SHIFTS = Shifts(base=datetime(2024, 1, 1), hours=8, count=30)
GAP = 3600
SCHEMA = "machine string, ts timestamp_ntz, type string, state string, reason_code string, good_delta int, reject_delta int, log_id long"
COLUMNS = ["machine", "k", "complete", "run_us", "down_us", "idle_us", "good", "reject", "start_ok", "end_ok", "gaps_ok", "state_ok", "max_gap_us", "gap_from_us", "gap_to_us", "n_observations", "availability", "performance", "quality", "oee"]


def fact(rng, i, at, machine):
    kind = rng.choice(["STATE", "COUNT", "HEARTBEAT", "COUNT"])
    state = rng.choice(["RUN", "DOWN", "IDLE"])
    own = (state, "R" if state == "DOWN" else None, None, None) if kind == "STATE" else (None, None, 1, 0) if kind == "COUNT" else (None,) * 4
    return (machine, SHIFTS.base + timedelta(seconds=at), kind, *own, i)


def invented(rng, n):
    """Facts in order of time, with silences of days, on edges of shifts, and outside the table."""
    out, at = [], -100_000
    for i in range(n):
        at += rng.choice([0, 600, 1800, 3600, 3600, 28_800, 150_000])
        at = at // 28_800 * 28_800 if rng.random() < 0.15 else at
        out.append(fact(rng, i, at, rng.choice("ab") if i > n // 3 else "a"))
    return out


def whole(spark, rows, machines):
    m = spark.createDataFrame(rows, SCHEMA)
    of = lambda kind: m.where(F.col("type") == kind)
    return metrics.effectiveness(of("STATE"), of("COUNT"), m, machines, SHIFTS, GAP)


def shown(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=lambda r: r[:2])


def test_cells_after_every_batch_are_the_grid(spark, tmp_path):
    rng = random.Random(2)
    rows = invented(rng, 120)
    late = [rng.random() < 0.2 for _ in rows]
    batches = [[r for i, r in enumerate(rows) if min(3, i * 4 // len(rows) + (rng.choice([1, 2]) if late[i] else 0)) == b] for b in range(4)]
    cells = Cells(spark, str(tmp_path), SHIFTS, GAP)
    for b in range(4):
        cells.update(spark.createDataFrame(batches[b], SCHEMA).repartition(2), b)
        if b == 2:  # given again
            cells.update(spark.createDataFrame(batches[b], SCHEMA), b)
        so_far = [r for batch in batches[: b + 1] for r in batch]
        machines = spark.createDataFrame([(x, 100.0) for x in {r[0] for r in so_far}], "machine string, ideal_cycle_s double")
        assert shown(cells.grid(machines)) == shown(whole(spark, so_far, machines))


def test_a_batch_reads_the_cells_it_touches(spark, tmp_path, monkeypatch):
    dense = [("a", SHIFTS.base + timedelta(seconds=600 * i), "STATE" if i % 10 == 0 else "HEARTBEAT", "RUN" if i % 10 == 0 else None, None, None, None, i) for i in range(30 * 48)]
    cells = Cells(spark, str(tmp_path), SHIFTS, GAP)
    cells.update(spark.createDataFrame(dense, SCHEMA), 0)
    looked = []
    real = Cells.of_shifts
    monkeypatch.setattr(Cells, "of_shifts", lambda self, table, schema, ks: looked.append((table, sorted(ks))) or real(self, table, schema, ks))
    written = []
    put = Cells.put
    monkeypatch.setattr(Cells, "put", lambda self, rows, table, *folders: written.append((table, rows.count())) or put(self, rows, table, *folders))
    late = ("a", SHIFTS.base + timedelta(seconds=12 * 28_800 + 1000), "STATE", "DOWN", "JAM", None, None, 5000)
    cells.update(spark.createDataFrame([late], SCHEMA), 1)
    # the shift, and its neighbours whose nearest facts outside it may hold
    assert {table for table, _ in looked} == {"cells", "facts"} and all(set(ks) <= {11, 12, 13} for _, ks in looked)
    assert dict(written) == {"facts": 1, "cells": 3}
    machines = spark.createDataFrame([("a", 100.0)], "machine string, ideal_cycle_s double")
    assert shown(cells.grid(machines)) == shown(whole(spark, [*dense, late], machines))


def test_a_batch_that_broke_off_is_given_again(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = invented(rng, 80)
    cells = Cells(spark, str(tmp_path), SHIFTS, GAP)
    cells.update(spark.createDataFrame(rows[:40], SCHEMA), 0)
    put = Cells.put

    def broken(self, frame, table, *folders):
        if table == "cells":  # some folders are replaced, others are not
            put(self, frame.where("k % 2 = 0"), table, *folders)
            raise OSError("lost")
        put(self, frame, table, *folders)

    with monkeypatch.context() as m:
        m.setattr(Cells, "put", broken)
        with pytest.raises(OSError):
            cells.update(spark.createDataFrame(rows[40:], SCHEMA), 1)
    cells.update(spark.createDataFrame(rows[40:], SCHEMA), 1)
    machines = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "machine string, ideal_cycle_s double")
    assert shown(cells.grid(machines)) == shown(whole(spark, rows, machines))


def test_an_empty_batch_and_an_empty_store(spark, tmp_path):
    cells = Cells(spark, str(tmp_path), SHIFTS, GAP)
    assert cells.read().count() == 0
    cells.update(spark.createDataFrame([], SCHEMA), 0)
    assert cells.read().count() == 0 and kept.names(kept.FACT)[0] == "machine"
