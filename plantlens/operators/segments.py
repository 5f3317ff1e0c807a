"""State segments: how long a machine was in which state, by shift and by reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.grid import MICRO, base_us, shift_index, shifts_between
from plantlens.operators.lines import STRETCH, followed
from plantlens.schema import Shifts


def segments(states: DataFrame) -> DataFrame:
    """Each state with the time of the machine's next one (null for the last); equal times follow log_id."""
    laid = [STRETCH] if STRETCH in states.columns else []
    rows = states.select("machine", "state", "reason_code", "log_id", microseconds("ts").alias("start_us"), *laid)
    return followed(rows, ["machine"], "start_us", "next_us", ["log_id"]).drop(STRETCH)


def clipped(spans: DataFrame, shifts: Shifts) -> DataFrame:
    """Segments cut to the shifts they touch: machine, k, state, reason_code, us. The last state of a machine runs on to the end of the table."""
    end = base_us(shifts) + shifts.count * shifts.seconds * MICRO
    spans = spans.withColumn("end_us", F.coalesce("next_us", F.greatest(end, F.col("start_us"))))
    spans = spans.where(F.col("end_us") > F.col("start_us"))
    cut = spans.withColumn("k", F.explode(shifts_between(shift_index(F.col("start_us"), shifts), shift_index(F.col("end_us") - 1, shifts), shifts)))
    s_start = base_us(shifts) + F.col("k").cast("long") * F.lit(shifts.seconds * MICRO)
    us = F.least(F.col("end_us"), s_start + shifts.seconds * MICRO) - F.greatest(F.col("start_us"), s_start)
    return cut.select("machine", "k", "state", "reason_code", us.alias("us"))


def by_state(parts: DataFrame, *keys: str) -> DataFrame:
    """The keys with run_us, down_us and idle_us."""
    part = lambda state: F.sum(F.when(F.col("state") == state, F.col("us")).otherwise(0))
    return parts.groupBy(*keys).agg(part("RUN").alias("run_us"), part("DOWN").alias("down_us"), part("IDLE").alias("idle_us"))


def state_seconds(spans: DataFrame, shifts: Shifts) -> DataFrame:
    """machine, k, run_us, down_us, idle_us in one pass over the segments."""
    return by_state(clipped(spans, shifts), "machine", "k")


def downtime_pareto(spans: DataFrame, shifts: Shifts) -> DataFrame:
    """machine, k, reason_code, us of DOWN time; the next state is sought before DOWN ones are picked."""
    return clipped(spans, shifts).where("state = 'DOWN'").groupBy("machine", "k", "reason_code").agg(F.sum("us").alias("us"))


def downtime_events(states: DataFrame, shifts: Shifts) -> DataFrame:
    """machine, k, reason_code and how many DOWN segments begin in the shift."""
    own = states.where("state = 'DOWN'").withColumn("k", shift_index(microseconds("ts"), shifts)).where(F.col("k").between(0, shifts.count - 1))
    return own.groupBy("machine", "k", "reason_code").agg(F.count("*").alias("n"))
