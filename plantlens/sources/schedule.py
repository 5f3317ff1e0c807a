"""The demonstration day: what each machine does, and which alarms it raises."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

DAY = datetime(2024, 1, 1)

# Results are reconciled against this day. Machine, nameplate seconds per unit, every n-th unit a reject.
MACHINES = [("LINE_A.FILLER", 30.0, 23), ("LINE_A.CAPPER", 27.0, 31), ("LINE_A.LABELLER", 22.0, 17)]

# States of the day, from start to end, with the reason of a DOWN.
STATES = [
    ("LINE_A.FILLER", "RUN", "00:00", "02:30", None),
    ("LINE_A.FILLER", "DOWN", "02:30", "02:45", "JAM"),
    ("LINE_A.FILLER", "RUN", "02:45", "05:00", None),
    ("LINE_A.FILLER", "IDLE", "05:00", "05:10", None),
    ("LINE_A.FILLER", "RUN", "05:10", "08:00", None),
    ("LINE_A.FILLER", "RUN", "08:00", "10:00", None),
    ("LINE_A.FILLER", "DOWN", "10:00", "10:30", "CHANGEOVER"),
    ("LINE_A.FILLER", "RUN", "10:30", "13:45", None),
    ("LINE_A.FILLER", "DOWN", "13:45", "13:55", "NO_MATERIAL"),
    ("LINE_A.FILLER", "RUN", "13:55", "16:00", None),
    ("LINE_A.FILLER", "RUN", "16:00", "19:00", None),
    ("LINE_A.FILLER", "IDLE", "19:00", "19:20", None),
    ("LINE_A.FILLER", "RUN", "19:20", "22:00", None),
    ("LINE_A.FILLER", "DOWN", "22:00", "22:15", "JAM"),
    ("LINE_A.FILLER", "RUN", "22:15", "24:00", None),
    ("LINE_A.CAPPER", "RUN", "00:00", "01:45", None),
    ("LINE_A.CAPPER", "DOWN", "01:45", "02:05", "TOOL_WEAR"),
    ("LINE_A.CAPPER", "RUN", "02:05", "06:00", None),
    ("LINE_A.CAPPER", "IDLE", "06:00", "06:15", None),
    ("LINE_A.CAPPER", "RUN", "06:15", "08:00", None),
    ("LINE_A.CAPPER", "RUN", "08:00", "11:30", None),
    ("LINE_A.CAPPER", "DOWN", "11:30", "11:40", "JAM"),
    ("LINE_A.CAPPER", "RUN", "11:40", "14:00", None),
    ("LINE_A.CAPPER", "DOWN", "14:00", "14:25", "NO_MATERIAL"),
    ("LINE_A.CAPPER", "RUN", "14:25", "16:00", None),
    ("LINE_A.CAPPER", "RUN", "16:00", "18:30", None),
    ("LINE_A.CAPPER", "DOWN", "18:30", "18:45", "TOOL_WEAR"),
    ("LINE_A.CAPPER", "RUN", "18:45", "21:50", None),
    ("LINE_A.CAPPER", "IDLE", "21:50", "22:05", None),
    ("LINE_A.CAPPER", "RUN", "22:05", "24:00", None),
    ("LINE_A.LABELLER", "RUN", "00:00", "03:00", None),
    ("LINE_A.LABELLER", "DOWN", "03:00", "03:20", "LABEL_OUT"),
    ("LINE_A.LABELLER", "RUN", "03:20", "08:00", None),
    ("LINE_A.LABELLER", "RUN", "08:00", "09:30", None),
    ("LINE_A.LABELLER", "DOWN", "09:30", "09:45", "CHANGEOVER"),
    ("LINE_A.LABELLER", "RUN", "09:45", "12:50", None),
    ("LINE_A.LABELLER", "IDLE", "12:50", "13:00", None),
    ("LINE_A.LABELLER", "RUN", "13:00", "16:00", None),
    ("LINE_A.LABELLER", "RUN", "16:00", "20:00", None),
    ("LINE_A.LABELLER", "DOWN", "20:00", "20:30", "LABEL_OUT"),
    ("LINE_A.LABELLER", "RUN", "20:30", "23:15", None),
    ("LINE_A.LABELLER", "DOWN", "23:15", "23:25", "JAM"),
    ("LINE_A.LABELLER", "RUN", "23:25", "24:00", None),
]

# Alarms of the day, from raise to clear.
ALARMS = [
    ("LINE_A.FILLER", "TEMP_HIGH", "01:05", "01:12"),
    ("LINE_A.FILLER", "JAM", "02:30", "02:45"),
    ("LINE_A.FILLER", "CHANGEOVER", "10:00", "10:30"),
    ("LINE_A.FILLER", "NO_MATERIAL", "13:45", "13:55"),
    ("LINE_A.FILLER", "JAM", "22:00", "22:15"),
    ("LINE_A.FILLER", "VIBRATION", "20:40", "20:44"),
    ("LINE_A.CAPPER", "TOOL_WEAR", "01:45", "02:05"),
    ("LINE_A.CAPPER", "JAM", "11:30", "11:40"),
    ("LINE_A.CAPPER", "NO_MATERIAL", "14:00", "14:25"),
    ("LINE_A.CAPPER", "TOOL_WEAR", "18:30", "18:45"),
    ("LINE_A.CAPPER", "PRESSURE_LOW", "09:10", "09:14"),
    ("LINE_A.LABELLER", "LABEL_OUT", "03:00", "03:20"),
    ("LINE_A.LABELLER", "CHANGEOVER", "09:30", "09:45"),
    ("LINE_A.LABELLER", "LABEL_OUT", "20:00", "20:30"),
    ("LINE_A.LABELLER", "JAM", "23:15", "23:25"),
    ("LINE_A.LABELLER", "MISALIGN", "05:40", "05:43"),
]


def clock(text: str) -> datetime:
    hours, minutes = map(int, text.split(":"))
    return DAY + timedelta(hours=hours, minutes=minutes)


def state_rows() -> list[tuple]:
    """(machine, state, start, end, reason_code) of all segments."""
    return [(machine, state, clock(start), clock(end), reason) for machine, state, start, end, reason in STATES]


def alarm_rows() -> list[tuple]:
    """(machine, alarm_code, raised, cleared) of all alarms."""
    return [(machine, code, clock(raised), clock(cleared)) for machine, code, raised, cleared in ALARMS]


def machines_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MACHINES, "machine string, ideal_cycle_s double, reject_every_n int")


def segments_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(state_rows(), "machine string, state string, start timestamp_ntz, end timestamp_ntz, reason_code string")


def alarms_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alarm_rows(), "machine string, alarm_code string, raised timestamp_ntz, cleared timestamp_ntz")
