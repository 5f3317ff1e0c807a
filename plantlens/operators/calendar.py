"""Shifts of any calendar: windows per machine, of unequal length, with breaks and overlaps.

A calendar is a table of windows (machine, shift, part, s_us, e_us), half-open and
in microseconds; a shift with breaks has several parts. Intervals meet windows by
a binned join: both are spread over the bins of time they touch, meet by machine and
bin, and a pair counts in the later of the two bins in which its sides begin, so that it is
found exactly once. There is no join on inequalities, and a busy machine's rows are
parted by time. Intervals are first cut to the calendar's first and last time, so
an open one takes no more bins than the calendar has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.alarms import raised, summed
from plantlens.operators.coverage import edges_and_gaps, silences
from plantlens.operators.grid import MICRO
from plantlens.operators.segments import by_state

WINDOW = ["machine", "shift", "part", "s_us", "e_us"]


def bin_length(windows: DataFrame) -> tuple[int, int, int]:
    """First and last time of a calendar and a length of bins: the mean length of its windows."""
    low, high, mean = windows.agg(F.min("s_us"), F.max("e_us"), F.avg(F.col("e_us") - F.col("s_us"))).first()
    return (low or 0), (high or 0), max(MICRO, int(mean or 0))


def meeting(spans: DataFrame, windows: DataFrame, low: Column, high: Column, later: int = 0) -> DataFrame:
    """Pairs of a machine's spans from ``low`` to ``high`` (half-open) and its windows that overlap; ``later``: microseconds by which windows end later for this."""
    first, last, length = bin_length(windows)
    last += later
    bins = lambda a, b: F.sequence(F.floor(a / length), F.floor((b - 1) / length))
    spans = spans.withColumns({"_low": F.greatest(low, F.lit(first)), "_high": F.least(high, F.lit(last))}).where("_low < _high")
    spans = spans.withColumn("_bin", F.explode(bins(F.col("_low"), F.col("_high"))))
    ends = F.col("e_us") + later
    windows = windows.select(*WINDOW).where(F.col("s_us") < ends).withColumn("_bin", F.explode(bins(F.col("s_us"), ends)))
    pairs = spans.join(windows, ["machine", "_bin"])
    once = F.col("_bin") == F.greatest(F.floor(F.col("_low") / length), F.floor(F.col("s_us") / length))
    return pairs.where(once & (F.col("_low") < ends) & (F.col("_high") > F.col("s_us"))).drop("_bin", "_low", "_high")


def moments(rows: DataFrame, windows: DataFrame, us: Column) -> DataFrame:
    """Pairs of rows and the windows that their time lies in."""
    return meeting(rows, windows, us, us + 1)


def state_parts(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments cut to windows: machine, shift, state, reason_code, us. A machine's last state runs on to the end of the calendar."""
    found = meeting(spans, windows, F.col("start_us"), F.coalesce("next_us", F.lit(2**62)))
    end = F.least(F.coalesce("next_us", "e_us"), "e_us")
    return found.select("machine", "shift", "state", "reason_code", (end - F.greatest("start_us", "s_us")).alias("us")).where("us > 0")


def state_seconds(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """machine, shift, run_us, down_us, idle_us."""
    return by_state(state_parts(spans, windows), "machine", "shift")


def downtime(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """machine, shift, reason_code and us of DOWN time."""
    return state_parts(spans, windows).where("state = 'DOWN'").groupBy("machine", "shift", "reason_code").agg(F.sum("us").alias("us"))


def counts(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """machine, shift, good, reject; a tick counts in every shift that it lies in."""
    found = moments(ticks.select("machine", "ts", "good_delta", "reject_delta"), windows, microseconds("ts"))
    return found.groupBy("machine", "shift").agg(F.sum(F.col("good_delta").cast("long")).alias("good"), F.sum(F.col("reject_delta").cast("long")).alias("reject"))


def alarms_by_shift(alarms: DataFrame, windows: DataFrame) -> DataFrame:
    """machine, shift of the raise, alarm_code, count, us and open_count."""
    return summed(moments(raised(alarms), windows, F.col("raised_us")), "machine", "shift", "alarm_code")


def coverage(observed: DataFrame, windows: DataFrame, gap_s: int) -> DataFrame:
    """WINDOW, start_ok, end_ok, gaps_ok, max_gap_us, gap_from_us, gap_to_us and n_observations of every window."""
    gap = gap_s * MICRO
    seen = silences(observed)
    # an observation belongs to the windows whose edges it is near, that hold it (both edges included), or that the silence behind it reaches into
    low, high = F.col("at") - gap, F.greatest(F.col("at") + gap, F.coalesce("next", "at")) + 1
    near = meeting(seen, windows, low, high, later=gap + 1)
    joined = windows.select(*WINDOW).join(near, WINDOW, "left")
    return edges_and_gaps(joined.withColumnsRenamed({"s_us": "s_start_us", "e_us": "s_end_us"}), ["machine", "shift", "part", "s_end_us"], gap).withColumnsRenamed({"s_start_us": "s_us", "s_end_us": "e_us"})


def effectiveness(states: DataFrame, spans: DataFrame, ticks: DataFrame, observed: DataFrame, machines: DataFrame, windows: DataFrame, gap_s: int) -> DataFrame:
    """Every shift of a calendar: planned and state seconds, counts, completeness and the four ratios, which are null where it is not complete.

    ``machines`` has each machine's own ideal_cycle_s. A shift is complete if each of its parts is covered, a state is
    known at its start, and its states fill its parts.
    """
    keys = ["machine", "shift"]
    covered = coverage(observed, windows, gap_s).groupBy(*keys).agg(
        F.min("s_us").alias("s_us"), F.sum(F.col("e_us") - F.col("s_us")).alias("planned_us"), *(F.bool_and(c).alias(c) for c in ("start_ok", "end_ok", "gaps_ok")), F.max("max_gap_us").alias("max_gap_us")
    )
    first = states.groupBy("machine").agg(microseconds(F.min("ts")).alias("first_us"))
    rows = covered.join(state_seconds(spans, windows), keys, "left").join(counts(ticks, windows), keys, "left")
    rows = rows.join(first, "machine", "left").join(machines.select("machine", "ideal_cycle_s"), "machine", "left")
    rows = rows.na.fill(0, ["run_us", "down_us", "idle_us", "good", "reject"])
    tiled = F.abs(F.col("run_us") + F.col("down_us") + F.col("idle_us") - F.col("planned_us")) < MICRO
    rows = rows.withColumn("state_ok", F.coalesce(F.col("first_us") <= F.col("s_us"), F.lit(False)) & tiled)
    rows = rows.withColumn("complete", F.col("start_ok") & F.col("end_ok") & F.col("gaps_ok") & F.col("state_ok"))
    seconds = {f"{n}_seconds": F.col(f"{n}_us") / MICRO for n in ("planned", "run", "down", "idle")}
    rows = rows.withColumns(seconds).withColumn("total", F.col("good") + F.col("reject"))
    ratio = lambda ok, value: F.when(F.col("complete"), F.when(ok, value).otherwise(0.0))
    rows = rows.withColumns(
        {
            "availability": ratio(F.col("planned_us") > 0, F.col("run_seconds") / F.col("planned_seconds")),
            "performance": ratio(F.col("run_us") > 0, F.col("total") * F.col("ideal_cycle_s") / F.col("run_seconds")),
            "quality": ratio(F.col("total") > 0, F.col("good") / F.col("total")),
        }
    )
    return rows.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))
