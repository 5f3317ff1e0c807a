"""Fact tables as views over the ledger, so that ledger and facts cannot disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.schema import FACT_CATEGORIES

COLUMNS = {"STATE": ("state", "reason_code"), "COUNT": ("good_delta", "reject_delta"), "ALARM": ("alarm_code", "phase"), "HEARTBEAT": ()}


def accepted(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("category").isin(*FACT_CATEGORIES))


def facts(ledger: DataFrame, msg_type: str) -> DataFrame:
    """Accepted messages of a type: log_id, machine, ts, the type's own columns, seq, is_late."""
    rows = accepted(ledger).where(F.col("msg_type") == msg_type)
    return rows.select(F.col("arrival_id").alias("log_id"), F.col("tag").alias("machine"), "ts", *COLUMNS[msg_type], "seq", "is_late")


def clock_gaps(ledger: DataFrame) -> DataFrame:
    """Silences of a machine longer than the policy's gap: machine, gap_start, gap_end, gap_seconds, detected_at."""
    return ledger.where("gap_seconds is not null").select(F.col("arrival_id").alias("log_id"), F.col("tag").alias("machine"), "gap_start", F.col("ts").alias("gap_end"), "gap_seconds", F.col("received_at").alias("detected_at"))


def observations(ledger: DataFrame) -> DataFrame:
    """Distinct timestamps of accepted messages of any type, by machine."""
    return accepted(ledger).select(F.col("tag").alias("machine"), "ts").distinct()


def totals(ledger: DataFrame) -> DataFrame:
    """Messages by category; they sum to the messages received."""
    return ledger.groupBy("category").agg(F.count("*").alias("n"))


def difference(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Rows, repeats counted, of which either side has more: the row, only_in (a side's name) and n, by how many. No rows if both are equal as multisets."""
    columns = left.columns
    more = lambda a, b, name: a.exceptAll(b).groupBy(*columns).agg(F.count("*").alias("n")).select(*columns, F.lit(name).alias("only_in"), "n")
    return more(left, right.select(*columns), left_name).union(more(right.select(*columns), left, right_name))
