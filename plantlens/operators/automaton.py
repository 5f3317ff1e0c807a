"""The automaton of alarms over stretches of arrivals, as a prefix over transition functions.

An alarm of a key is accepted if its phase follows the last accepted one's (RAISE
first) and its time is not before that one's. So what a stretch of a key's rows
makes of the state before it depends on two things: which phase it waits for, and
the time so far. For a given phase that is a step function of the time. The first
row taken is the first one of that phase with a time not before it, which is one
of the stretch's successive records, and all that follows from there is fixed. The
steps are found in one pass from the back. Runs from different records soon meet,
so a step function has an entry or two, however long the stretch.

Three rounds: each stretch gives its two step functions (all stretches side by
side), these are applied one after the other along a key (a small row for each),
and each stretch is folded once more from the state that it is known to begin with.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Before any time.
EARLIEST = -(2**63)
STEPS = "tag string, alarm_code string, stretch long, raise_limits array<long>, raise_phases array<string>, raise_times array<long>, clear_limits array<long>, clear_phases array<string>, clear_times array<long>"
STATES = "tag string, alarm_code string, stretch long, phase string, us long"
OTHER = {"RAISE": "CLEAR", "CLEAR": "RAISE"}


def steps(phases: Sequence[str], times: Sequence[int]) -> dict[str, tuple[list[int], list[str], list[int]]]:
    """For either awaited phase: limits of the time before, rising, and phase and time behind the stretch; beyond the last limit nothing changes."""
    # by phase, rows that are records from where the pass has got to: the nearest is last, and times rise towards the front
    rows: dict[str, list[int]] = {"RAISE": [], "CLEAR": []}
    minus: dict[str, list[int]] = {"RAISE": [], "CLEAR": []}
    end = list(range(len(times)))
    for i in range(len(times) - 1, -1, -1):
        own, other = phases[i], OTHER[phases[i]]
        behind = bisect_right(minus[other], -times[i]) - 1
        if behind >= 0:
            end[i] = end[rows[other][behind]]
        while minus[own] and minus[own][-1] >= -times[i]:
            minus[own].pop()
            rows[own].pop()
        minus[own].append(-times[i])
        rows[own].append(i)
    out = {}
    for phase, found in rows.items():
        limits, ends = [], []
        for i in reversed(found):
            if ends and ends[-1] == end[i]:
                limits[-1] = times[i]
            else:
                limits.append(times[i])
                ends.append(end[i])
        out[phase] = (limits, [phases[j] for j in ends], [times[j] for j in ends])
    return out


def ordered(group: pa.Table, order: Sequence[str]) -> pa.Table:
    return group.sort_by([(name, "ascending") for name in order])


def steps_of(key: tuple[pa.Scalar, ...], group: pa.Table, order: Sequence[str]) -> pa.Table:
    group = ordered(group, order)
    found = steps(group["phase"].to_pylist(), group["ts_us"].to_pylist())
    lists = [part for phase in ("RAISE", "CLEAR") for part in found[phase]]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())] * 2
    names = [part.split(" ")[0] for part in STEPS.split(", ")]
    return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([x], kind) for x, kind in zip(lists, kinds, strict=True)], names=names)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each stretch, from rows of steps in order; a row without steps carries a state in its times."""
    key, phase, at = None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["tag"], row["alarm_code"]) != key:
                key, phase, at = (row["tag"], row["alarm_code"]), None, None
            if row["raise_limits"] is None:
                phase, at = row["raise_phases"][0], row["raise_times"][0]
                continue
            out.append((*key, row["stretch"], phase, at))
            awaited = "clear" if phase == "RAISE" else "raise"
            step = bisect_left(row[f"{awaited}_limits"], EARLIEST if at is None else at)
            if step < len(row[f"{awaited}_limits"]):
                phase, at = row[f"{awaited}_phases"][step], row[f"{awaited}_times"][step]
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["tag", "alarm_code", "stretch", "phase", "us"])


def verdicts_of(group: pa.Table, order: Sequence[str]) -> pa.Table:
    """What becomes of each row of a stretch, and the state before it."""
    group = ordered(group, order)
    phase, at = (group[name][0].as_py() for name in ("before_phase", "before_us"))
    oks, phases, ats = [], [], []
    for new, ts in zip(group["phase"].to_pylist(), group["ts_us"].to_pylist(), strict=True):
        ok = new == ("CLEAR" if phase == "RAISE" else "RAISE") and (at is None or ts >= at)
        oks.append(ok)
        phases.append(phase)
        ats.append(at)
        if ok:
            phase, at = new, ts
    return pa.table({"line": group["line"], "alarm_ok": pa.array(oks, pa.bool_()), "last_phase": pa.array(phases, pa.string()), "last_us": pa.array(ats, pa.int64())})


def alarm_verdicts(alarms: DataFrame, carry: DataFrame | None, order: Sequence[str], stretch: int) -> DataFrame:
    """line, alarm_ok, last_phase and last_us for rows (tag, alarm_code, phase, ts_us, line and the columns of ``order``, an arrival_id first)."""
    columns = list(dict.fromkeys(["tag", "alarm_code", "phase", "ts_us", "line", *order]))
    rows = alarms.select(*columns).withColumn("stretch", F.floor(F.col(order[0]) / stretch))
    keys = ["tag", "alarm_code", "stretch"]
    functions = rows.groupBy(*keys).applyInArrow(lambda key, group: steps_of(key, group, order), STEPS)
    if carry is not None:
        none = F.lit(None)
        start = [F.lit(EARLIEST).alias("stretch"), none.cast("array<long>"), F.array("phase"), F.array("ts_us"), none.cast("array<long>"), none.cast("array<string>"), none.cast("array<long>")]
        functions = functions.union(carry.select("tag", "alarm_code", *start))
    states = functions.repartition("tag", "alarm_code").sortWithinPartitions(*keys).mapInArrow(chained, STATES)
    known = rows.join(states.withColumnsRenamed({"phase": "before_phase", "us": "before_us"}), keys)
    return known.groupBy(*keys).applyInArrow(lambda group: verdicts_of(group, order), "line long, alarm_ok boolean, last_phase string, last_us long")
