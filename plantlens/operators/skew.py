"""Joins of rows to one row per key, when a key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows count as hot. There are fewer of them than this number, so they are broadcast.
PARTS = 10_000
#: Rows of a key that are no burden whatever their part.
FEW = 1_000


def joined(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``rows`` with the row of ``keyed`` (saved before; ``count``: its key's number of rows, not returned) for their key."""
    total, largest = keyed.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    most = max(FEW, total // PARTS)
    if largest <= most:
        return rows.join(keyed.drop(count), list(keys))
    hot = keyed.where(F.col(count) > most).drop(count)
    frequent = rows.join(F.broadcast(hot), list(keys))
    others = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(keyed.where(F.col(count) <= most).drop(count), list(keys))
    return frequent.unionByName(others)
