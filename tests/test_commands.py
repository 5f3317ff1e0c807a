"""The demonstration day from command to command, and the helpers that they rest on."""

import json
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantlens import __main__ as commands
from plantlens.operators.lines import followed, numbered, running_max
from plantlens.sources.scratch import counted, saved, scratch, shared_dir


class Running:
    """A session that outlives the commands."""

    def __init__(self, spark):
        self.spark = spark

    def __getattr__(self, name):
        return (lambda: None) if name == "stop" else getattr(self.spark, name)


def test_generate_ingest_report(spark, tmp_path, monkeypatch, capsys):
    class Builder:
        appName = lambda self, name: self
        getOrCreate = lambda self: Running(spark)

    monkeypatch.setattr(commands, "SparkSession", type("S", (), {"builder": Builder()}))
    drop, ledger, check, out = (str(tmp_path / n) for n in ("drop", "ledger", "check", "out"))

    def run(*args):
        monkeypatch.setattr(sys, "argv", ["plantlens", *args])
        commands.main()

    run("generate", "--drop", drop)
    capsys.readouterr()
    run("ingest", "--drop", drop, "--ledger", ledger, "--checkpoint", check)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"accepted": 10275}
    run("report", "--ledger", ledger, "--out", out)
    data = json.loads((tmp_path / "out" / "report.json").read_text())
    assert data["completeness"]["all_complete"] and data["ingest_totals"] == {"accepted": 10275}
    assert {s["good_count"] for m in data["machines"].values() for s in m.values()} >= {868, 956}
    assert (tmp_path / "out" / "report.html").stat().st_size > 1000
    run("truth")
    assert "LINE_A.CAPPER" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("unknown")


ROWS = [("a", t, i) for i, t in enumerate([0, 5, 5, 30, 95, 100, 101, 350, 351, 990])] + [("b", 100, 20), ("c", 7, 30), ("c", 7, 31)]


def test_lines_in_stretches_are_the_lines_in_one(spark):
    rows = spark.createDataFrame(ROWS, "key string, at long, id long")
    for stretch in (1, 10, 100, 10_000):
        got = {(r.key, r.id): r for r in numbered(running_max(followed(rows, ["key"], "at", "next", ["id"], stretch), "key", "id", "at", "top", 4), ["key"], "at", "nth", ["id"], stretch).collect()}
        assert len(got) == len(ROWS)
        for key in "abc":
            own = sorted((t, i) for k, t, i in ROWS if k == key)
            for n, (t, i) in enumerate(own):
                assert got[key, i].next == (own[n + 1][0] if n + 1 < len(own) else None) and got[key, i].nth == n
                assert got[key, i].top == max((u for u, j in own if j < i), default=None)
    every = sorted(r.nth for r in numbered(rows, [], "at", "nth", ["key", "id"], 10).collect())
    assert every == list(range(len(ROWS)))


def test_scratch_tables_are_emptied(spark):
    with scratch(spark):
        inner = saved(spark.range(10))
        kept = saved(spark.range(5), outer := shared_dir(spark) + "_kept")
    assert kept.count() == 5 and outer
    assert spark.read.schema("id long").parquet(inner.inputFiles()[0].rpartition("/")[0]).count() == 0


def test_saved_tables_reach_python_in_small_batches_and_are_counted(spark):
    """Texts of 20 kB: without a bound on bytes, all 1,000 are one batch."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    rows = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("0123456789"), 2000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name)
    found, many = counted(rows.mapInArrow(sizes, "n long"))
    got = [r.n for r in found.collect()]
    assert many == len(got) >= 4 and sum(got) >= 20_000_000 and max(got) < 5_000_000
    assert spark.conf.get(name) == had
    assert counted(spark.range(5).where("id > 5"))[1] == 0
