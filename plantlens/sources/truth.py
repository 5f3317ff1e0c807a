"""What the demonstration day must come to, straight from its schedule and not from messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.grid import MICRO, base_us, shift_index, shifts_between
from plantlens.schema import Shifts
from plantlens.sources import generator, schedule


def planned_segments(spark: SparkSession, shifts: Shifts = Shifts()) -> DataFrame:
    """machine, k, state, reason_code, us and whether the segment begins in the shift."""
    rows = schedule.segments_df(spark).withColumns({"a": microseconds("start"), "b": microseconds("end")})
    rows = rows.withColumn("k", F.explode(shifts_between(shift_index(F.col("a"), shifts), shift_index(F.col("b") - 1, shifts), shifts)))
    low = base_us(shifts) + F.col("k").cast("long") * F.lit(shifts.seconds * MICRO)
    return rows.select("machine", "k", "state", "reason_code", (F.least("b", low + shifts.seconds * MICRO) - F.greatest("a", low)).alias("us"), (F.col("a") >= low).alias("begins"))


def expected(spark: SparkSession, shifts: Shifts = Shifts()) -> DataFrame:
    """machine, k, seconds by state, downtime_seconds, counts and the four ratios."""
    seconds = planned_segments(spark, shifts).groupBy("machine", "k").pivot("state", ["RUN", "DOWN", "IDLE"]).agg(F.sum("us") / MICRO)
    machines = schedule.machines_df(spark)
    ticks = generator.count_messages(schedule.segments_df(spark), machines)
    counts = ticks.withColumn("k", shift_index(microseconds("ts"), shifts)).groupBy(F.col("tag").alias("machine"), "k").agg(F.sum("good_delta").alias("good"), F.sum("reject_delta").alias("reject"))
    rows = seconds.join(counts, ["machine", "k"]).join(machines, "machine").na.fill(0.0, ["RUN", "DOWN", "IDLE"])
    run, total = F.col("RUN"), F.col("good") + F.col("reject")
    rows = rows.select("machine", "k", run.alias("run_seconds"), F.col("DOWN").alias("down_seconds"), F.col("IDLE").alias("idle_seconds"), (F.col("DOWN") + F.col("IDLE")).alias("downtime_seconds"), "good", "reject", (run / shifts.seconds).alias("availability"), (total * F.col("ideal_cycle_s") / run).alias("performance"), (F.col("good") / total).alias("quality"))
    return rows.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))


def expected_downtime(spark: SparkSession, shifts: Shifts = Shifts()) -> DataFrame:
    """machine, k, reason_code, seconds and number of DOWN segments."""
    down = planned_segments(spark, shifts).where("state = 'DOWN'")
    return down.groupBy("machine", "k", "reason_code").agg((F.sum("us") / MICRO).alias("seconds"), F.count_if("begins").alias("events"))


def expected_alarms(spark: SparkSession, shifts: Shifts = Shifts()) -> DataFrame:
    """machine, shift of the raise, alarm_code, count and seconds, with totals by machine and code (k null)."""
    rows = schedule.alarms_df(spark).withColumn("k", shift_index(microseconds("raised"), shifts))
    us = microseconds("cleared") - microseconds("raised")
    sets = rows.groupingSets([[F.col("machine"), F.col("alarm_code"), F.col("k")], [F.col("machine"), F.col("alarm_code")]], "machine", "alarm_code", "k")
    return sets.agg(F.count("*").alias("count"), (F.sum(us) / MICRO).alias("seconds"))


def expected_messages(spark: SparkSession) -> DataFrame:
    """Messages by type, and all of them (type null)."""
    rows = generator.messages(schedule.segments_df(spark), schedule.alarms_df(spark), schedule.machines_df(spark))
    return message_totals(rows)


def message_totals(rows: DataFrame) -> DataFrame:
    """Rows by type, and all of them (type null)."""
    return rows.rollup("type").agg(F.count("*").alias("n"))


def same_keys(reported: DataFrame, alarms: DataFrame) -> DataFrame:
    """Every (machine, alarm_code) of a report (with ``reported``) or of a schedule, and whether it is in either."""
    planned = alarms.select("machine", "alarm_code", F.lit(True).alias("planned")).distinct()
    rows = reported.join(planned, ["machine", "alarm_code"], "full")
    return rows.select("machine", "alarm_code", F.coalesce("reported", F.lit(False)).alias("reported"), F.coalesce("planned", F.lit(False)).alias("planned"))
