"""Messages of a schedule as DataFrames: ticks, heartbeats, state changes and alarms in one ordered stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds, ntz
from plantlens.operators.classify import iso
from plantlens.operators.lines import numbered
from plantlens.schema import HEARTBEAT_S

MICRO = 1_000_000


def tick_times(spans: DataFrame, start: str = "start", end: str = "end", cycle_s: str = "ideal_cycle_s") -> DataFrame:
    """A row (ts added) at start + k * cycle for k = 1, 2, ... strictly before the end; spans without one give none."""
    cycle = F.round(F.col(cycle_s) * MICRO).cast("long")
    length = microseconds(F.col(end)) - microseconds(F.col(start))
    n = F.floor((length - 1) / cycle).cast("long")
    steps = F.when((length > 0) & (n >= 1), F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
    return spans.withColumn("k", F.explode(steps)).withColumn("ts", ntz(microseconds(F.col(start)) + F.col("k") * cycle)).drop("k")


def heartbeat_times(spans: DataFrame, start: str = "start", end: str = "end", every_s: float = HEARTBEAT_S) -> DataFrame:
    """A row (ts added) at start + k * interval for k = 0, 1, ...: as many as whole intervals fit."""
    step = int(every_s * MICRO)
    n = F.floor((microseconds(F.col(end)) - microseconds(F.col(start))) / step).cast("long")
    steps = F.when(n >= 1, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    return spans.withColumn("k", F.explode(steps)).withColumn("ts", ntz(microseconds(F.col(start)) + F.col("k") * step)).drop("k")


def state_messages(segments: DataFrame) -> DataFrame:
    """One at the start of every segment, also where the state does not change."""
    return segments.select(F.col("machine").alias("tag"), F.lit("STATE").alias("type"), F.col("start").alias("ts"), "state", "reason_code")


def with_rejects(ticks: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Adds reject: 1 for every ``reject_every_n``-th tick of a machine in order of time, 0 for the others."""
    rows = numbered(ticks.withColumn("_us", microseconds("ts")), ["machine"], "_us", "_nth", ties)
    return rows.withColumn("reject", ((F.col("_nth") + 1) % F.col("reject_every_n") == 0).cast("int")).drop("_us", "_nth")


def count_messages(segments: DataFrame, machines: DataFrame) -> DataFrame:
    """A unit per tick of RUN segments; every n-th of a machine's day is a reject."""
    ticks = tick_times(segments.where("state = 'RUN'").join(F.broadcast(machines), "machine"))
    return with_rejects(ticks).select(F.col("machine").alias("tag"), F.lit("COUNT").alias("type"), "ts", (1 - F.col("reject")).alias("good_delta"), F.col("reject").alias("reject_delta"))


def alarm_messages(alarms: DataFrame) -> DataFrame:
    both = alarms.select("machine", "alarm_code", F.explode(F.array(F.struct(F.lit("RAISE").alias("phase"), F.col("raised").alias("ts")), F.struct(F.lit("CLEAR").alias("phase"), F.col("cleared").alias("ts")))).alias("e"))
    return both.select(F.col("machine").alias("tag"), F.lit("ALARM").alias("type"), "e.ts", "alarm_code", "e.phase")


def heartbeat_messages(segments: DataFrame) -> DataFrame:
    days = segments.groupBy("machine").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return heartbeat_times(days).select(F.col("machine").alias("tag"), F.lit("HEARTBEAT").alias("type"), "ts")


def messages(segments: DataFrame, alarms: DataFrame, machines: DataFrame) -> DataFrame:
    """All messages with seq, numbered by time, tag and type."""
    parts = [state_messages(segments), count_messages(segments, machines), alarm_messages(alarms), heartbeat_messages(segments)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return numbered(every.withColumn("_us", microseconds("ts")), [], "_us", "seq", ["tag", "type", "alarm_code", "phase"]).drop("_us")


def payloads(rows: DataFrame) -> DataFrame:
    """arrival_id, raw_payload and topic of messages; a state's reason_code is written even if it is null."""
    when = iso(microseconds("ts")).alias("ts")
    common = [F.col("tag"), F.col("type"), F.col("seq"), when]
    plain = {"COUNT": ("good_delta", "reject_delta"), "ALARM": ("alarm_code", "phase"), "HEARTBEAT": ()}
    text = F.to_json(F.struct(*common, "state", "reason_code"), {"ignoreNullFields": "false"})
    for kind, own in plain.items():
        text = F.when(F.col("type") == kind, F.to_json(F.struct(*common, *own))).otherwise(text)
    topic = F.concat_ws("/", F.lit("demo/plant"), "tag", F.lower("type"))
    return rows.select(F.col("seq").alias("arrival_id"), text.alias("raw_payload"), topic.alias("topic"))


def demonstration_day(spark: SparkSession) -> DataFrame:
    """arrival_id, raw_payload and topic of the fixed day."""
    from plantlens.sources import schedule

    return payloads(messages(schedule.segments_df(spark), schedule.alarms_df(spark), schedule.machines_df(spark)))


def drop_files(rows: DataFrame, path: str, parts: int = 1) -> None:
    """Write messages as text lines (arrival_id, a tab, the payload) that :func:`plantlens.streaming.stream.ingest` reads; existing files stay."""
    lines = rows.select("arrival_id", F.concat_ws("\t", F.col("arrival_id").cast("string"), "raw_payload").alias("value"))
    lines.repartitionByRange(parts, "arrival_id").sortWithinPartitions("arrival_id").select("value").write.mode("append").text(path)
