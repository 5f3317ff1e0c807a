"""Facts laid out for their readers: in buckets by machine and stretch of time, in order of time within.

Segments, silences and counts all look for a machine's next or nearest rows within a stretch.
Over such a table they find them where they lie: events are not shuffled again for
each of them, only what has been summed up or is needed at a stretch's ends is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.lines import STRETCH, STRETCH_US


def laid_out(facts: DataFrame, table: str, path: str, buckets: int, stretch: int = STRETCH_US) -> DataFrame:
    """Write facts (machine, ts and others) as a table of the catalog below a path, and read it. One task writes a bucket, so there is one file for each."""
    rows = facts.withColumns({"us": microseconds("ts"), STRETCH: F.floor(microseconds("ts") / stretch)})
    rows = rows.repartition(buckets, "machine", STRETCH)
    rows.write.option("path", path).bucketBy(buckets, "machine", STRETCH).sortBy("machine", STRETCH, "us").mode("overwrite").saveAsTable(table)
    return facts.sparkSession.table(table)
