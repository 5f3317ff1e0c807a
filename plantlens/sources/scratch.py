"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files of a statement go when it ends, not when the driver's JVM happens to collect garbage; and Python is handed this much at once (the buffers of a batch double as they grow, outside the executor's heap).
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: For operators of very many small joins: each table that is broadcast takes some MB of the driver's memory and threads that stay for a minute, however few its rows.
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting (tests) gets one below its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the statements inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder (or a path got from it before) and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A saved table and its number of rows, which comes out of the pass that writes it."""
    told = Observation()
    found = saved(df.observe(told, F.count(F.lit(1)).alias("n")))
    return found, told.get["n"]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Empty the tables saved inside at the end: for callers who have written their result by then.

    Overwriting with no rows works on every store that Spark writes to; an empty folder is left of each.
    """
    mark = _tables.set([])
    try:
        yield
    finally:
        tables = _tables.get()
        _tables.reset(mark)
        for path in tables or []:
            spark.range(0).write.mode("overwrite").parquet(path)
