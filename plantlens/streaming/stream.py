"""Ingest of dropped files as a stream: the same ledger, whatever the cut into micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantlens.schema import Policy
from plantlens.streaming.ledger import Ledger
from plantlens.streaming.tail import TailSource


def messages_of(lines: DataFrame) -> DataFrame:
    """arrival_id, raw_payload, file and block of lines (arrival_id, a tab, the payload); file and block order lines of one arrival_id.

    A line of another form is a message too, refused as a bad payload: its payload
    is the line behind a mark that no JSON text begins with, and a negative number,
    from a hash of line and file, stands for its id.
    """
    tab = F.instr("value", "\t")
    number = F.expr("try_cast(substring_index(value, '\t', 1) AS long)")
    proper = (tab > 0) & number.isNotNull()
    stand_in = -1 - F.xxhash64("value", "file_path").bitwiseAND(F.lit(2**63 - 1))
    return lines.select(F.when(proper, number).otherwise(stand_in).alias("arrival_id"), F.when(proper, F.substr("value", tab + 1)).otherwise(F.concat(F.lit("?\t"), "value")).alias("raw_payload"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"))


def lines(spark: SparkSession, source: str, files_per_batch: int | None = None, growing: bool = False) -> DataFrame:
    """A stream of value, file_path and file_block_start; ``growing``: files are read on when they grow, see :mod:`tail`."""
    if growing:
        spark.dataSource.register(TailSource)
        return spark.readStream.format(TailSource.name()).option("path", source).load()
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(source).select("value", "_metadata.file_path", "_metadata.file_block_start")


def ingest(spark: SparkSession, source: str, ledger: str, checkpoint: str, policy: Policy = Policy(), files_per_batch: int | None = None, available_now: bool = True, growing: bool = False) -> StreamingQuery:
    """Start the stream. The checkpoint remembers which files, or how much of them, are done; a redelivered message is classified as a duplicate.

    No watermark of Spark's is set: it would drop late rows, which have to be logged.
    """
    book = Ledger(spark, ledger, policy)
    rows = messages_of(lines(spark, source, files_per_batch, growing))
    stream = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: book.append(batch, number) and None)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def ingest_all(spark: SparkSession, source: str, ledger: str, checkpoint: str, **how) -> dict[str, int]:
    """Read everything there is, then stop; returns the totals by category."""
    ingest(spark, source, ledger, checkpoint, **how).awaitTermination()
    return Ledger(spark, ledger).totals()
