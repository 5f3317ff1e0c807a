"""The machine x shift grid and the spreading of intervals over it.

Shifts are equal windows, so the shift of a time is a division and the shifts
of an interval are a range of numbers: intervals are exploded over the shifts
they touch and meet the grid by equality, never by a join on inequalities.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.schema import Shifts

MICRO = 1_000_000


def base_us(shifts: Shifts):
    return F.lit((shifts.base - datetime(1970, 1, 1)) // timedelta(microseconds=1))


def shift_table(spark: SparkSession, shifts: Shifts) -> DataFrame:
    """k, shift, s_start_us, s_end_us; one small row per shift."""
    length = shifts.seconds * MICRO
    return spark.range(shifts.count).select(
        F.col("id").cast("int").alias("k"),
        F.concat(F.lit("SHIFT_"), (F.col("id") + 1).cast("string")).alias("shift"),
        (base_us(shifts) + F.col("id") * length).alias("s_start_us"),
        (base_us(shifts) + (F.col("id") + 1) * length).alias("s_end_us"),
    )


def dense_grid(machines: DataFrame, shifts: Shifts) -> DataFrame:
    """Every machine in every shift, whether or not it was heard of; the shift table is as small as its settings say."""
    return machines.select("machine").distinct().crossJoin(F.broadcast(shift_table(machines.sparkSession, shifts)))


def shift_index(us, shifts: Shifts):
    """Number of the shift of a time in microseconds (half-open), also outside the table."""
    return F.floor((us - base_us(shifts)) / F.lit(shifts.seconds * MICRO)).cast("int")


def shifts_between(low, high, shifts: Shifts):
    """Numbers of the table's shifts from ``low`` to ``high``, both included; empty where there are none."""
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit(shifts.count - 1))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
