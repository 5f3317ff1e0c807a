"""The shift report: one Spark plan per table, a few hundred collected rows, HTML and JSON published file by file."""

from __future__ import annotations

import html
import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import alarms as alarm_ops
from plantlens.operators.facts import facts, observations, totals
from plantlens.operators.grid import MICRO, shift_table
from plantlens.operators.metrics import FORMULAS, effectiveness
from plantlens.operators.segments import downtime_pareto, segments
from plantlens.schema import GAP_S, Shifts

ROLE = "Synthetic demonstration data: every message on this page was generated."
NOTE = "Effectiveness is computed by the formulas below on planted data; it shows how the engine works and is no benchmark of a real line."
RATIOS = ("availability", "performance", "quality", "oee")


def build_report(ledger: DataFrame, machines: DataFrame, shifts: Shifts = Shifts(), gap_s: int = GAP_S) -> dict:
    """All of the report's data from one snapshot of the ledger. The keys are fixed values: readers of the JSON rely on them."""
    spark = ledger.sparkSession
    states = facts(ledger, "STATE")
    grid = effectiveness(states, facts(ledger, "COUNT"), observations(ledger), machines, shifts, gap_s)
    pareto: dict[tuple, dict[str, float]] = {}
    for r in downtime_pareto(segments(states), shifts).orderBy("machine", "k", F.desc("us"), "reason_code").collect():
        pareto.setdefault((r.machine, r.k), {})[r.reason_code] = r.us / MICRO
    order = {r.machine: i for i, r in enumerate(machines.select("machine").collect())}
    cells: dict[str, dict] = {m: {} for m in order}
    incomplete = []
    for r in sorted(grid.collect(), key=lambda r: (order[r.machine], r.k)):
        cells[r.machine][r.shift] = {
            "planned_production_seconds": r.planned_seconds,
            "run_seconds": r.run_seconds,
            "down_seconds": r.down_seconds,
            "idle_seconds": r.idle_seconds,
            "good_count": r.good,
            "reject_count": r.reject,
            "total_count": r.total,
            **{n: r[n] for n in RATIOS},
            "downtime_pareto": pareto.get((r.machine, r.k), {}),
            "complete": r.complete,
            "completeness_reason": r.completeness_reason,
        }
        if not r.complete:
            incomplete.append({"machine": r.machine, "shift": r.shift, "reason": r.completeness_reason, "start_ok": r.start_ok, "end_ok": r.end_ok, "gaps_ok": r.gaps_ok, "state_ok": r.state_ok, "max_internal_gap_seconds": r.max_gap_us / MICRO, "observation_count": r.n_observations})
    summary = alarm_ops.alarm_summary(facts(ledger, "ALARM")).orderBy("machine", "alarm_code").collect()
    return {
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "role": ROLE,
        "method_note": NOTE,
        "formulas": FORMULAS,
        "shifts": [r.shift for r in shift_table(spark, shifts).orderBy("k").collect()],
        "machines": cells,
        "alarms": [{"machine": r.machine, "alarm_code": r.alarm_code, "count": r["count"], "duration_seconds": r.us / MICRO, "open_count": r.open_count} for r in summary],
        "ingest_totals": {r.category: r.n for r in totals(ledger).orderBy("category").collect()},
        "completeness": {"all_complete": not incomplete, "incomplete": incomplete},
    }


def table(title: str, head: list[str], rows: list[list]) -> str:
    """An HTML table; every cell is escaped."""
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in row) + "</tr>"
    return f"<h2>{html.escape(title)}</h2>\n<table>\n{cells('th', head)}\n" + "\n".join(cells("td", r) for r in rows) + "\n</table>\n"


def render_html(data: dict) -> str:
    """The report as a page without scripts or outside resources."""
    grid, downtime = [], []
    for machine, shifts in data["machines"].items():
        for shift, v in shifts.items():
            shown = [f"{v[n] * 100:.1f}%" if v["complete"] else "incomplete" for n in RATIOS]
            grid.append([machine, shift, *shown, v["good_count"], v["reject_count"]])
            downtime += [[machine, shift, reason, f"{s:.0f}s"] for reason, s in sorted(v["downtime_pareto"].items(), key=lambda x: -x[1])]
    notes = [f"<p><b>Role:</b> {html.escape(data['role'])}</p>", f"<p>{html.escape(data['method_note'])}</p>", f"<p>Generated at {html.escape(data['generated_at'])}.</p>"]
    missing = data["completeness"]["incomplete"]
    if missing:
        items = "".join(f"<li>{html.escape(i['machine'])} / {html.escape(i['shift'])}: {html.escape(i['reason'])}</li>" for i in missing)
        notes.append(f'<div class="missing"><b>INCOMPLETE DATA:</b> coverage of these rows is not proven, so their ratios are withheld:<ul>{items}</ul></div>')
    parts = [
        table("Effectiveness by machine and shift", ["Machine", "Shift", "Availability", "Performance", "Quality", "OEE", "Good", "Reject"], grid),
        table("Downtime by reason", ["Machine", "Shift", "Reason", "Duration"], downtime),
        table("Alarms", ["Machine", "Code", "Count", "Duration", "Open"], [[a["machine"], a["alarm_code"], a["count"], f"{a['duration_seconds']:.0f}s", a["open_count"]] for a in data["alarms"]]),
        table("Messages by category", ["Category", "Count"], sorted(data["ingest_totals"].items())),
        table("Formulas", ["Ratio", "Formula"], list(data["formulas"].items())),
    ]
    style = "body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3rem .6rem}.missing{background:#fdd;padding:.5rem}"
    title = "Shift effectiveness report"
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head>\n<body><h1>{title}</h1>\n' + "\n".join([*notes, *parts]) + "</body></html>\n"


def replace_file(path: str, text: str) -> None:
    """Put the text at ``path`` in one step: readers see the old file or the new one."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".publish-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def publish(data: dict, folder: str) -> None:
    """Write report.html, then report.json. Each is replaced whole; whether both are of one run, ``generated_at`` in them tells."""
    os.makedirs(folder, exist_ok=True)
    replace_file(os.path.join(folder, "report.html"), render_html(data))
    replace_file(os.path.join(folder, "report.json"), json.dumps(data, indent=2, default=str))
