"""Coverage on small cases, and publishing."""

import json
import os

import pytest

from plantlens.operators.classify import classify
from plantlens.plans import report
from plantlens.sources.schedule import machines_df
from tests.test_classifier import FILLER, frame, message


def built(spark, raws):
    return report.build_report(classify(frame(spark, raws)), machines_df(spark))


def test_nothing_seen_is_nine_incomplete_rows(spark):
    data = built(spark, [])
    assert len(data["completeness"]["incomplete"]) == 9 and not data["completeness"]["all_complete"]


def test_a_covered_shift_and_an_escaped_reason(spark):
    raws = [message(0, 0, "STATE")] + [message(k, 30 * k) for k in range(1, 961)] + [message(2000, 28801, "STATE", state="DOWN", reason_code="<img src=x onerror=alert(1)>")]
    data = built(spark, raws)
    first = data["machines"][FILLER]["SHIFT_1"]
    assert first["complete"] and first["availability"] == 1.0 and first["good_count"] == 959
    second = data["machines"][FILLER]["SHIFT_2"]
    assert not second["complete"] and second["oee"] is None and "SHIFT_2 window end" in second["completeness_reason"]
    page = report.render_html(data)
    assert "<img" not in page and "&lt;img src=x" in page and report.ROLE in page


def test_files_are_replaced_one_by_one(spark, tmp_path, monkeypatch):
    data = built(spark, [message(0, 0, "STATE")])
    report.publish(data, str(tmp_path))
    old = (tmp_path / "report.json").read_text()
    real = os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: (_ for _ in ()).throw(OSError("full")) if b.endswith(".json") else real(a, b))
    with pytest.raises(OSError):
        report.publish(data | {"generated_at": "later"}, str(tmp_path))
    assert "later" in (tmp_path / "report.html").read_text() and (tmp_path / "report.json").read_text() == old
    assert json.loads(old)["role"] == report.ROLE and sorted(os.listdir(tmp_path)) == ["report.html", "report.json"]


def test_orders_formulas_and_topics(spark):
    from plantlens.plans.catalog import day_ledger
    from plantlens.sources.generator import demonstration_day

    data = report.build_report(day_ledger(spark), machines_df(spark))
    assert list(data["machines"]) == [r.machine for r in machines_df(spark).collect()]
    assert data["shifts"] == ["SHIFT_1", "SHIFT_2", "SHIFT_3"] and all(list(m) == data["shifts"] for m in data["machines"].values())
    keys = [(a["machine"], a["alarm_code"]) for a in data["alarms"]]
    assert keys == sorted(keys) and list(data["ingest_totals"]) == ["accepted"]
    for machine in data["machines"].values():
        for shift in machine.values():
            seconds = list(shift["downtime_pareto"].values())
            assert seconds == sorted(seconds, reverse=True) and sum(seconds) == shift["down_seconds"]
    assert set(data["formulas"]) == {"availability", "performance", "quality", "oee"} and "Ideal Cycle Time" in data["formulas"]["performance"]
    topics = {r.topic for r in demonstration_day(spark).select("topic").distinct().collect()}
    assert topics == {f"demo/plant/{m}/{t}" for m in data["machines"] for t in ("state", "count", "alarm", "heartbeat")}


def test_refused_messages_show_only_fields_of_the_right_type(spark):
    raws = ['{"seq": 5, "tag": 7, "type": "COUNT", "ts": "soon"}', '{"seq": "5", "tag": "T", "type": [], "ts": 1}', '{"seq": 99999999999999999999, "tag": "T", "type": "X", "ts": "2024-01-01T00:00:00Z"}', "[]"]
    rows = classify(frame(spark, raws)).orderBy("arrival_id").collect()
    assert {r.category for r in rows} == {"bad_payload"} and [r.raw_payload for r in rows] == raws
    assert [(r.seq, r.tag, r.msg_type, r.ts_raw) for r in rows] == [(5, None, "COUNT", "soon"), (None, "T", None, None), (None, "T", "X", "2024-01-01T00:00:00Z"), (None, None, None, None)]
    assert all(r.ts is None and r.content_hash is None and r.state is None for r in rows)
