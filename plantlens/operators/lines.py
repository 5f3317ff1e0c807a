"""Ordered lines of rows by key, in two levels: stretches of the order, then the rows of a stretch.

A key's rows are never sorted in one task. What passes from one stretch to the
next is aggregated first, to one small row for each stretch of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a stretch of time: six hours.
STRETCH_US = 21_600_000_000
#: The column of a row's stretch, in tables that are laid out by it.
STRETCH = "stretch"


def followed(rows: DataFrame, keys: Sequence[str], at: str, out: str, ties: Sequence[str] = (), stretch: int = STRETCH_US) -> DataFrame:
    """``out``: ``at`` of the key's next row in the order of ``at`` and ``ties``; null for its last row. A column STRETCH is taken for the rows' stretches."""
    told = STRETCH in rows.columns
    s = STRETCH if told else "_stretch"
    rows = rows if told else rows.withColumn(s, F.floor(F.col(at) / stretch))
    firsts = rows.groupBy(*keys, s).agg(F.min(at).alias("_first"))
    behind = firsts.select(*keys, s, F.lead("_first").over(Window.partitionBy(*keys).orderBy(s)).alias("_behind"))
    inside = F.lead(at).over(Window.partitionBy(*keys, s).orderBy(at, *ties))
    found = rows.withColumn("_inside", inside).join(behind, [*keys, s], "left").withColumn(out, F.coalesce("_inside", "_behind")).drop("_inside", "_behind")
    return found if told else found.drop(s)


def running_max(rows: DataFrame, key: str, order: str, value: str, out: str, stretch: int, ties: Sequence[str] = ()) -> DataFrame:
    """``out``: the largest ``value`` of the key's rows before this one in ``order`` and ``ties``."""
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    tops = rows.groupBy(key, "_stretch").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "_stretch", F.max("_top").over(before).alias("_base"))
    inside = Window.partitionBy(key, "_stretch").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(tops, [key, "_stretch"]).withColumn(out, F.greatest("_base", F.max(value).over(inside))).drop("_stretch", "_base")


def numbered(rows: DataFrame, keys: Sequence[str], at: str, out: str, ties: Sequence[str] = (), stretch: int = STRETCH_US) -> DataFrame:
    """``out``: the row's number (from 0) in its key's order of ``at`` and ``ties``; without keys, in the order of all rows."""
    rows = rows.withColumn("_stretch", F.floor(F.col(at) / stretch))
    counts = rows.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    # one row per stretch, so one small window
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(at, *ties))
    return rows.withColumn("_inside", inside).join(counts, [*keys, "_stretch"]).withColumn(out, (F.col("_base") + F.col("_inside") - 1).cast("long")).drop("_stretch", "_inside", "_base")
