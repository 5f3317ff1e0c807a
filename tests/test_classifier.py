"""Grammar and classifier on single cases, on random streams, and cut into batches."""

import json
import random

import pytest

from plantlens.functions.grammar import parse
from plantlens.operators.classify import classify
from plantlens.streaming.ledger import Ledger
from plantlens.streaming.stream import ingest_all

FILLER = "LINE_A.FILLER"


def message(seq, at, type_="COUNT", tag=FILLER, **own):
    own = own or {"COUNT": {"good_delta": 1, "reject_delta": 0}, "STATE": {"state": "RUN", "reason_code": None}}.get(type_, {})
    h, rest = divmod(at, 3600)
    return json.dumps({"seq": seq, "ts": f"2024-01-01T{h:02}:{rest // 60:02}:{rest % 60:02}+00:00", "tag": tag, "type": type_, **own})


def alarm(seq, at, phase, code="JAM", tag=FILLER):
    return message(seq, at, "ALARM", tag, alarm_code=code, phase=phase)


OK = json.loads(message(1, 0))
CASES = [
    ("{not json", "invalid JSON"),
    (None, "invalid JSON"),
    ("[" * 100_000, "invalid JSON"),
    ("[]", "payload is not a JSON object"),
    (json.dumps(OK | {"seq": "1"}), "field seq must be an integer"),
    (json.dumps(OK | {"seq": True}), "field seq must be an integer"),
    (json.dumps(OK | {"seq": 2**63}), "field seq is out of BIGINT range"),
    (json.dumps({k: v for k, v in OK.items() if k != "seq"}), "missing field seq"),
    (json.dumps(OK | {"ts": "soon"}), "field ts is not a valid timezone-aware ISO8601 timestamp"),
    (json.dumps(OK | {"ts": "2024-01-01T00:00:00"}), "field ts is not a valid timezone-aware ISO8601 timestamp"),
    (json.dumps(OK | {"ts": "0001-01-01T00:00:00+14:00"}), "field ts is not a valid timezone-aware ISO8601 timestamp"),
    (json.dumps(OK | {"type": "X"}), "unknown type 'X'"),
    (message(1, 0, "STATE", state="SPINNING", reason_code=None), "STATE.state must be one of RUN/IDLE/DOWN"),
    (message(1, 0, "STATE", state=[], reason_code=None), "STATE.state must be one of RUN/IDLE/DOWN"),
    (message(1, 0, "STATE", state="DOWN", reason_code=""), "DOWN state requires a non-empty reason_code"),
    (message(1, 0, "STATE", state="RUN", reason_code="JAM"), "reason_code must be null unless state is DOWN"),
    (message(1, 0, good_delta=-1, reject_delta=0), "COUNT.good_delta must be an integer in [0, 2147483647]"),
    (message(1, 0, good_delta=2**40, reject_delta=0), "COUNT.good_delta must be an integer in [0, 2147483647]"),
    (message(1, 0, good_delta=0, reject_delta=0), "COUNT must have a nonzero good_delta or reject_delta"),
    (message(1, 0, "ALARM", alarm_code="", phase="RAISE"), "ALARM.alarm_code must be a non-empty string"),
    (alarm(1, 0, "MAYBE"), "ALARM.phase must be RAISE or CLEAR"),
    (message(1, 0, "HEARTBEAT", extra=1), None),
]


@pytest.mark.parametrize("raw,reason", CASES, ids=range(len(CASES)))
def test_grammar(raw, reason):
    assert parse(raw)[0] == reason


def model(raws):
    """The categories one by one, in order of arrival."""
    seen, mark, last, out = {}, {}, {}, []
    for raw in raws:
        reason, tag, kind, seq, _, ts, digest, *own = parse(raw)
        if reason:
            out.append("bad_payload")
        elif not tag.startswith("LINE_A.") or tag.endswith("SEALER"):
            out.append("unknown_tag")
        elif seq in seen:
            out.append("duplicate" if seen[seq] == digest else "seq_conflict")
        else:
            seen[seq] = digest
            delay = mark.get(tag, ts) - ts
            mark[tag] = max(mark.get(tag, ts), ts)
            if delay > 300_000_000:
                out.append("out_of_order_rejected")
                continue
            if kind == "ALARM":
                code, phase = own[4], own[5]
                before, at = last.get((tag, code), ("CLEAR", ts))
                if phase == before or ts < at:
                    out.append("alarm_out_of_order_rejected")
                    continue
                last[tag, code] = phase, ts
            out.append("accepted_late" if delay > 0 else "accepted")
    return out


def stream(seed, n=400):
    rng, out = random.Random(seed), []
    for i in range(n):
        seq, at, tag = rng.randrange(n), max(0, 60 * i + rng.randrange(-500, 500)), rng.choice([FILLER, "LINE_A.CAPPER", "LINE_A.LABELLER"])
        kind = rng.randrange(12)
        out.append(out[rng.randrange(i)] if kind == 0 and i else "{" if kind == 1 else message(seq, at, tag="LINE_A.SEALER") if kind == 2 else alarm(seq, at, rng.choice(["RAISE", "CLEAR"]), rng.choice("AB"), tag) if kind < 8 else message(seq, at, tag=tag))
    return out


def frame(spark, raws, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(raws)], "arrival_id long, raw_payload string")


def categories(df):
    return [r.category for r in df.orderBy("arrival_id").collect()]


def test_random_streams(spark):
    for seed in range(2):
        raws = stream(seed)
        assert categories(classify(frame(spark, raws))) == model(raws)


def test_limits(spark):
    raws = [message(1, 600), message(2, 300), message(3, 299), message(3, 299), message(4, 1200), message(5, 1801), alarm(6, 1801, "CLEAR"), alarm(7, 1801, "RAISE"), alarm(8, 1801, "CLEAR"), alarm(9, 1900, "RAISE"), alarm(10, 1850, "CLEAR")]
    rows = classify(frame(spark, raws)).orderBy("arrival_id").collect()
    assert [r.category for r in rows] == ["accepted", "accepted_late", "out_of_order_rejected", "duplicate", "accepted", "accepted", "alarm_out_of_order_rejected", "accepted", "accepted", "accepted", "alarm_out_of_order_rejected"]
    assert [r.gap_seconds for r in rows if r.gap_seconds] == [601.0]


def test_any_cut_into_batches_gives_the_same_ledger(spark, tmp_path):
    raws = stream(7, 240)
    book = Ledger(spark, str(tmp_path / "ledger"))
    for k, (a, b) in enumerate([(0, 1), (1, 90), (90, 240)]):
        book.append(frame(spark, raws[a:b], a), k)
    book.append(frame(spark, raws[90:240], 90), 2)  # a retry replaces its own batch
    assert categories(book.read()) == model(raws)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("not ours")
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path / "other"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    raws = stream(9, 120)
    drop, args = tmp_path / "drop", (str(tmp_path / "drop"), str(tmp_path / "ledger"), str(tmp_path / "check"))
    drop.mkdir()
    line = lambda k: (drop / f"{k}.txt").write_text("".join(f"{i}\t{raws[i]}\n" for i in range(40 * k, 40 * k + 40)))
    line(0)
    ingest_all(spark, *args)
    line(1)
    line(2)
    assert sum(ingest_all(spark, *args).values()) == 120
    assert sorted(categories(Ledger(spark, args[1]).read())) == sorted(model(raws))


def test_many_batches_give_the_same_ledger_at_a_constant_price(spark, tmp_path, monkeypatch):
    from plantlens.streaming import ledger

    monkeypatch.setattr(ledger, "RUN", 16)
    asked = []
    for name in ("exists", "children"):
        monkeypatch.setattr(ledger, name, lambda *a, real=getattr(ledger, name): asked.append(a) or real(*a))
    raws = stream(11, 90)
    book, calls, totals = Ledger(spark, str(tmp_path / "ledger")), [], {}
    for k in range(6):
        asked.clear()
        for category, n in book.append(frame(spark, raws[15 * k : 15 * k + 15], 15 * k), k).items():
            totals[category] = totals.get(category, 0) + n
        calls.append(len(asked))
    assert categories(book.read()) == model(raws)
    assert totals == book.totals() == {c: model(raws).count(c) for c in set(model(raws))}
    # two states, one list, and at most a folder for each run of seqs
    assert max(calls) <= 3 + 90 // 16 + 1 and calls[-1] <= max(calls[1:4])
    assert sorted(p.name for p in (tmp_path / "ledger" / "_state").iterdir()) == ["0", "1"]
    with pytest.raises(ValueError):
        book.append(frame(spark, raws[:10]), 3)


def test_a_batch_leaves_no_scratch(spark, tmp_path, monkeypatch):
    from plantlens.sources import scratch

    made = []
    real = scratch.shared_dir
    monkeypatch.setattr(scratch, "shared_dir", lambda s: made.append(real(s)) or made[-1])
    Ledger(spark, str(tmp_path / "ledger")).append(frame(spark, stream(3, 50)), 0)
    assert made and all(spark.read.schema("x long").parquet(p).count() == 0 for p in made)


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_crash_leaves_nothing_that_counts(spark, tmp_path, monkeypatch, step):
    raws = stream(13, 60)
    book = Ledger(spark, str(tmp_path / "ledger"))
    book.append(frame(spark, raws[:30]), 0)
    before = book.totals()
    with monkeypatch.context() as m:
        # as a driver leaves it that dies before the step, or in the middle of the last one
        real = Ledger.totals_at
        m.setattr(Ledger, step if step == "write" else "totals_at", lambda *a: (_ for _ in ()).throw(SystemExit) if step == "write" or a[1] == 0 else real(*a))
        with pytest.raises(SystemExit):
            book.append(frame(spark, raws[30:], 30), 1)
    again = Ledger(spark, str(tmp_path / "ledger"))
    assert again.batches() == [0] and categories(again.read()) == model(raws[:30]) and again.totals() == before
    if step == "commit":
        with pytest.raises(ValueError, match="given again"):
            again.append(frame(spark, raws[30:], 30), 2)
    again.append(frame(spark, raws[30:], 30), 1)
    assert categories(again.read()) == model(raws) and sum(again.totals().values()) == 60


def test_a_write_that_fails_is_made_up_for(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from plantlens.streaming import ledger

    raws = stream(17, 40)
    book = Ledger(spark, str(tmp_path / "ledger"))
    book.append(frame(spark, raws[:20]), 0)
    real = ledger.classify
    with monkeypatch.context() as m:
        # the last rows of the batch fail while it is written
        m.setattr(ledger, "classify", lambda *a, **k: real(*a, **k).withColumn("seq", F.when(F.col("arrival_id") > 35, F.raise_error(F.lit("disk full")).cast("long")).otherwise(F.col("seq"))))
        with pytest.raises(Exception, match="disk full"):
            book.append(frame(spark, raws[20:], 20), 1)
    assert categories(book.read()) == model(raws[:20])
    book.append(frame(spark, raws[20:], 20), 1)
    assert categories(book.read()) == model(raws)


def test_a_file_delivered_twice_and_broken_lines(spark, tmp_path):
    drop, args = tmp_path / "drop", (str(tmp_path / "drop"), str(tmp_path / "ledger"), str(tmp_path / "check"))
    drop.mkdir()
    raws = [message(k, 60 * k) for k in range(10)]
    lines = "".join(f"{i}\t{r}\n" for i, r in enumerate(raws))
    (drop / "a.txt").write_text(lines)
    ingest_all(spark, *args)
    (drop / "b.txt").write_text("".join(f"{100 + i}\t{r}\n" for i, r in enumerate(raws)))
    (drop / "c.txt").write_text(f"no tab here\nabc\t{raws[0]}\n{raws[1]}\n\n")
    assert ingest_all(spark, *args) == {"accepted": 10, "duplicate": 10, "bad_payload": 4}
    bad = Ledger(spark, args[1]).read().where("category = 'bad_payload'").collect()
    assert all(r.arrival_id < 0 and r.reason == "invalid JSON" for r in bad) and any("no tab here" in r.raw_payload for r in bad)


def test_state_restored_after_a_restart(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    book.append(frame(spark, [message(1, 1200), alarm(2, 1250, "RAISE")]), 0)
    later = [message(3, 800), message(1, 1200), alarm(4, 1260, "RAISE"), alarm(5, 1240, "CLEAR"), alarm(6, 1270, "CLEAR"), message(7, 1100)]
    Ledger(spark, str(tmp_path / "ledger")).append(frame(spark, later, 10), 1)
    assert categories(book.read())[2:] == ["out_of_order_rejected", "duplicate", "alarm_out_of_order_rejected", "alarm_out_of_order_rejected", "accepted", "accepted_late"]


def test_messages_of_one_file_are_parsed_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from plantlens.operators.classify import parsed_messages
    from plantlens.sources.scratch import settings

    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        rows = parsed_messages(frame(spark, stream(3, 200)).coalesce(1))
    tasks = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(tasks) > 2 and max(tasks) < 150 and sum(tasks) == 200
    lines = [r.line for r in rows.orderBy("arrival_id").collect()]
    assert lines == sorted(set(lines))
