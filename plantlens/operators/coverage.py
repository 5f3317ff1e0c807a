"""Proof that a machine was heard of throughout a shift.

An observation belongs to the shifts whose edges it is near, that hold it, or
that the silence behind it reaches into; it is exploded over just those, and
all conditions of a shift are then conditional aggregates of one grouping, which
is summed up before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.grid import MICRO, base_us, shift_index, shifts_between
from plantlens.operators.lines import STRETCH, followed
from plantlens.schema import Shifts


def silences(observed: DataFrame) -> DataFrame:
    """machine, at and next: every time a machine was heard of, and the time it was heard of next."""
    laid = [STRETCH] if STRETCH in observed.columns else []
    return followed(observed.select("machine", microseconds("ts").alias("at"), *laid).distinct(), ["machine"], "at", "next").drop(STRETCH)


def edges_and_gaps(joined: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """What the observations (at, next; null where there are none) joined to windows (s_start_us, s_end_us) prove of each."""
    silence = F.when((F.col("next") > F.col("s_start_us")) & (F.col("at") < F.col("s_end_us")), F.col("next") - F.col("at"))
    longest = F.max_by(F.struct("at", "next"), F.struct(silence.alias("us"), (-F.col("at")).alias("first")))
    found = joined.groupBy(*keys, "s_start_us").agg(
        F.coalesce(F.min(F.abs(F.col("at") - F.col("s_start_us"))) <= gap, F.lit(False)).alias("start_ok"),
        F.coalesce(F.min(F.abs(F.col("at") - F.col("s_end_us"))) <= gap, F.lit(False)).alias("end_ok"),
        F.coalesce(F.max(silence), F.lit(0)).alias("max_gap_us"),
        F.when(F.max(silence).isNotNull(), longest).alias("where"),
        F.count_if(F.col("at").between(F.col("s_start_us"), F.col("s_end_us"))).alias("n_observations"),
    )
    return found.select(
        *keys,
        "s_start_us",
        "start_ok",
        "end_ok",
        (F.col("max_gap_us") <= gap).alias("gaps_ok"),
        "max_gap_us",
        F.coalesce("where.at", "s_start_us").alias("gap_from_us"),
        F.coalesce("where.next", "s_start_us").alias("gap_to_us"),
        "n_observations",
    )


def coverage(observed: DataFrame, grid: DataFrame, shifts: Shifts, gap_s: int) -> DataFrame:
    """machine, k, start_ok, end_ok, gaps_ok, max_gap_us, gap_from_us, gap_to_us, n_observations for every row of the grid.

    A shift's edge is covered by an observation at most ``gap_s`` away; silences
    count if they overlap the shift; observations on both edges are counted.
    """
    gap = gap_s * MICRO
    seen = silences(observed)
    low = shift_index(F.col("at") - gap - 1, shifts)
    high = shift_index(F.greatest(F.col("at") + gap, F.coalesce("next", F.col("at"))), shifts)
    near = seen.withColumn("k", F.explode(shifts_between(low, high, shifts)))
    # a shift's edges follow from its number, so observations are summed up before they meet the grid
    length = shifts.seconds * MICRO
    start = base_us(shifts) + F.col("k").cast("long") * length
    found = edges_and_gaps(near.withColumns({"s_start_us": start, "s_end_us": start + length}), ["machine", "k"], gap).drop("s_start_us")
    rows = grid.select("machine", "k", "s_start_us").join(found, ["machine", "k"], "left")
    none = {"start_ok": F.lit(False), "end_ok": F.lit(False), "gaps_ok": F.lit(True), "max_gap_us": F.lit(0), "gap_from_us": F.col("s_start_us"), "gap_to_us": F.col("s_start_us"), "n_observations": F.lit(0)}
    return rows.select("machine", "k", *(F.coalesce(c, value).alias(c) for c, value in none.items()))


def state_evidence(states: DataFrame, grid: DataFrame) -> DataFrame:
    """machine, k and whether a state is known at the shift's start: some state at or before it."""
    first = states.groupBy("machine").agg(microseconds(F.min("ts")).alias("first_us"))
    return grid.join(first, "machine", "left").select("machine", "k", F.coalesce(F.col("first_us") <= F.col("s_start_us"), F.lit(False)).alias("state_seen"))
