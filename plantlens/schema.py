"""Types, constants and settings of the telemetry engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import types as T

# Names and limits that callers and stored ledgers rely on.
TYPES = ("STATE", "COUNT", "ALARM", "HEARTBEAT")
STATES = ("RUN", "IDLE", "DOWN")
PHASES = ("RAISE", "CLEAR")
CATEGORIES = ("accepted", "accepted_late", "duplicate", "seq_conflict", "out_of_order_rejected", "alarm_out_of_order_rejected", "unknown_tag", "bad_payload")
FACT_CATEGORIES = ("accepted", "accepted_late")
#: Categories whose rows count as seen and move their tag's watermark.
SEEN_CATEGORIES = ("accepted", "accepted_late", "out_of_order_rejected", "alarm_out_of_order_rejected")
MAX_DELTA = 2_147_483_647
SEQ_MIN, SEQ_MAX = -(2**63), 2**63 - 1
GRACE_S, GAP_S, HEARTBEAT_S = 300, 600, 300

MACHINES = T.StructType([T.StructField("machine", T.StringType(), False), T.StructField("ideal_cycle_s", T.DoubleType()), T.StructField("reject_every_n", T.IntegerType())])

PARSED = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("good_delta", T.IntegerType()),
        T.StructField("reject_delta", T.IntegerType()),
        T.StructField("alarm_code", T.StringType()),
        T.StructField("phase", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("arrival_id", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("state", T.StringType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("good_delta", T.IntegerType()),
        T.StructField("reject_delta", T.IntegerType()),
        T.StructField("alarm_code", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("is_late", T.BooleanType()),
        T.StructField("gap_start", T.TimestampNTZType()),
        T.StructField("gap_seconds", T.DoubleType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("line", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Shifts:
    """Equal half-open windows that follow each other from ``base`` on; number k is called ``SHIFT_{k + 1}``."""

    base: datetime = datetime(2024, 1, 1)
    hours: int = 8
    count: int = 3

    @property
    def seconds(self) -> int:
        return self.hours * 3600

    @property
    def end(self) -> datetime:
        return self.base + timedelta(hours=self.hours * self.count)


@dataclass(frozen=True)
class Policy:
    """Which tags are known, and how late or silent telemetry may be."""

    tags: tuple[str, ...] = ("LINE_A.FILLER", "LINE_A.CAPPER", "LINE_A.LABELLER")
    grace_s: int = GRACE_S
    gap_s: int = GAP_S
    #: Arrivals that one task orders on its own when running maxima are taken.
    stretch: int = 1_000_000
    shifts: Shifts = field(default_factory=Shifts)
