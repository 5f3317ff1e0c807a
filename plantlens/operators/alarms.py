"""Alarms paired with the event that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.grid import shift_index
from plantlens.operators.lines import followed
from plantlens.schema import Shifts


def raised(alarms: DataFrame) -> DataFrame:
    """Each RAISE with the time of the next event of its machine and code (null while open)."""
    rows = alarms.select("machine", "alarm_code", "phase", "log_id", microseconds("ts").alias("raised_us"))
    return followed(rows, ["machine", "alarm_code"], "raised_us", "next_us", ["log_id"]).where("phase = 'RAISE'").drop("phase", "log_id")


def summed(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("count"), F.coalesce(F.sum(F.col("next_us") - F.col("raised_us")), F.lit(0)).alias("us"), F.count_if(F.col("next_us").isNull()).alias("open_count"))


def alarm_summary(alarms: DataFrame) -> DataFrame:
    """machine, alarm_code, count, us and open_count over the whole ledger."""
    return summed(raised(alarms), "machine", "alarm_code")


def alarms_by_shift(alarms: DataFrame, shifts: Shifts) -> DataFrame:
    """The same by the shift in which the alarm was raised; raises outside all shifts are left out."""
    pairs = raised(alarms).withColumn("k", shift_index(F.col("raised_us"), shifts))
    return summed(pairs.where(F.col("k").between(0, shifts.count - 1)), "machine", "k", "alarm_code")
