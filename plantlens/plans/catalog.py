"""Queries over the testdata and their DuckDB twins.

All read whole tables. Times are added up in whole microseconds and divided
once, so both engines give the same doubles.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.grammar import html_escape, microseconds
from plantlens.operators import alarms, classify, coverage, metrics, segments
from plantlens.operators import calendar as calendars
from plantlens.operators.automaton import alarm_verdicts
from plantlens.operators.facts import clock_gaps, difference, facts, observations, totals
from plantlens.operators.grid import MICRO, dense_grid
from plantlens.operators.lines import numbered, running_max
from plantlens.plans.plant import BROKEN, CALENDAR, CYCLE_S, GAP_S, GRID, POLICY, SHIFTS, A, M, calendar, cycles, events, replayed
from plantlens.schema import Shifts
from plantlens.sources import generator, schedule, truth
from plantlens.sources.layout import laid_out
from plantlens.sources.scratch import saved, shared_dir
from plantlens.streaming.cells import Cells
from plantlens.streaming.ledger import Ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The fixed day's; they read no table, so they are run by tests only.
DAY_QUERIES: dict[str, Query] = {}
DAY_SQL: dict[str, str] = {}


def query(sql: str, queries: dict[str, Query] = QUERIES, twins: dict[str, str] = ORACLE_SQL) -> Callable[[Query], Query]:
    """Register a query with its twin."""

    def register(f: Query) -> Query:
        queries[f.__name__] = f
        twins[f.__name__] = sql
        return f

    return register


def of_day(sql: str) -> Callable[[Query], Query]:
    return query(sql, DAY_QUERIES, DAY_SQL)


def of(m: DataFrame, kind: str) -> DataFrame:
    return m.where(F.col("type") == kind)


def machines(m: DataFrame) -> DataFrame:
    return m.select("machine").distinct().withColumn("ideal_cycle_s", F.lit(CYCLE_S))


SEG = """seg AS (
  SELECT machine, state, reason_code, us, lead(us) OVER (PARTITION BY machine ORDER BY us, log_id) AS next FROM m WHERE type = 'STATE'
), cut AS (
  SELECT s.machine, k, state, reason_code, least(coalesce(next, (SELECT max(e) FROM shifts)), e) - greatest(us, s) AS us
  FROM seg s JOIN shifts ON us < e AND coalesce(next, (SELECT max(e) FROM shifts)) > s
  WHERE least(coalesce(next, (SELECT max(e) FROM shifts)), e) > greatest(us, s)
)"""
STATE_US = "coalesce(sum(CASE WHEN state = '{}' THEN us ELSE 0 END), 0)::BIGINT"


@query(f"WITH {M} SELECT machine, state, reason_code, log_id, us AS start_us, lead(us) OVER (PARTITION BY machine ORDER BY us, log_id) AS next_us FROM m WHERE type = 'STATE'")
def q_state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(of(events(spark, sf_dir), "STATE"))


@query(f"WITH {M}, {GRID}, {SEG} SELECT machine, k, {STATE_US.format('RUN')} / 1e6 AS run_seconds, {STATE_US.format('DOWN')} / 1e6 AS down_seconds, {STATE_US.format('IDLE')} / 1e6 AS idle_seconds FROM cut GROUP BY machine, k")
def q_state_seconds_by_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.state_seconds(segments.segments(of(events(spark, sf_dir), "STATE")), SHIFTS)
    return found.select("machine", "k", *((F.col(f"{s}_us") / MICRO).alias(f"{s}_seconds") for s in ("run", "down", "idle")))


@query(f"WITH {M}, {GRID} SELECT machine, k, sum(good_delta)::BIGINT AS good, sum(reject_delta)::BIGINT AS reject FROM m JOIN shifts ON us >= s AND us < e WHERE type = 'COUNT' GROUP BY machine, k")
def q_counts_by_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts(of(events(spark, sf_dir), "COUNT"), SHIFTS)


@query(f"WITH {M}, {GRID}, {SEG} SELECT machine, k, reason_code, sum(us)::BIGINT / 1e6 AS seconds FROM cut WHERE state = 'DOWN' GROUP BY machine, k, reason_code")
def q_downtime_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.downtime_pareto(segments.segments(of(events(spark, sf_dir), "STATE")), SHIFTS)
    return found.select("machine", "k", "reason_code", (F.col("us") / MICRO).alias("seconds")).orderBy("machine", "k", F.desc("seconds"), "reason_code")


@query(f"WITH {M}, {GRID} SELECT machine, k, reason_code, count(*) AS n FROM m JOIN shifts ON us >= s AND us < e WHERE type = 'STATE' AND state = 'DOWN' GROUP BY machine, k, reason_code")
def q_downtime_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.downtime_events(of(events(spark, sf_dir), "STATE"), SHIFTS)


@query(f"WITH {M} SELECT machine, ts FROM m WHERE type = 'STATE' UNION SELECT machine, ts FROM m WHERE type = 'COUNT' UNION SELECT machine, ts FROM m WHERE type = 'ALARM' UNION SELECT machine, ts FROM m WHERE type = 'HEARTBEAT'")
def q_observed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("machine", "ts").distinct()


COV = f"""obs AS (
  SELECT machine, us, lead(us) OVER (PARTITION BY machine ORDER BY us) AS next FROM (SELECT DISTINCT machine, us FROM m)
), cov AS (
  SELECT g.machine, g.k, coalesce(min(abs(us - s)) <= {GAP_S * MICRO}, false) AS start_ok, coalesce(min(abs(us - e)) <= {GAP_S * MICRO}, false) AS end_ok,
         coalesce(max(CASE WHEN next > s AND us < e THEN next - us END), 0) AS max_gap_us,
         coalesce(min(CASE WHEN next > s AND us < e THEN us END) FILTER (next - us = top), any_value(s)) AS gap_from_us,
         coalesce(min(CASE WHEN next > s AND us < e THEN next END) FILTER (next - us = top), any_value(s)) AS gap_to_us,
         count(*) FILTER (us BETWEEN s AND e) AS n_observations
  FROM (SELECT g.*, o.us, o.next, max(CASE WHEN o.next > g.s AND o.us < g.e THEN o.next - o.us END) OVER (PARTITION BY g.machine, g.k) AS top FROM grid g LEFT JOIN obs o ON o.machine = g.machine) g
  GROUP BY g.machine, g.k
)"""


@query(f"WITH {M}, {GRID}, {COV} SELECT machine, k, start_ok, end_ok, max_gap_us <= {GAP_S * MICRO} AS gaps_ok, max_gap_us, gap_from_us, gap_to_us, n_observations FROM cov")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return coverage.coverage(m, dense_grid(machines(m), SHIFTS), SHIFTS, GAP_S)


@query(f"WITH {M}, {GRID} SELECT g.machine, k, coalesce(bool_or(us <= s), false) AS state_seen FROM grid g LEFT JOIN m ON m.machine = g.machine AND m.type = 'STATE' GROUP BY g.machine, k")
def q_state_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return coverage.state_evidence(of(m, "STATE"), dense_grid(machines(m), SHIFTS))


FULL = f"""{M}, {GRID}, {SEG}, {COV}, sec AS (
  SELECT machine, k, {STATE_US.format('RUN')} AS run, {STATE_US.format('DOWN')} AS down, {STATE_US.format('IDLE')} AS idle FROM cut GROUP BY machine, k
), cnt AS (
  SELECT machine, k, sum(good_delta)::BIGINT AS good, sum(reject_delta)::BIGINT AS reject FROM m JOIN shifts ON us >= s AND us < e WHERE type = 'COUNT' GROUP BY machine, k
), ev AS (
  SELECT g.machine, g.k, coalesce((SELECT min(us) FROM m WHERE m.machine = g.machine AND type = 'STATE') <= g.s, false) AS seen FROM grid g
), cell AS (
  SELECT g.machine, g.k, g.shift, coalesce(run, 0) AS run, coalesce(down, 0) AS down, coalesce(idle, 0) AS idle, coalesce(good, 0) AS good, coalesce(reject, 0) AS reject, start_ok, end_ok,
         max_gap_us <= {GAP_S * MICRO} AS gaps_ok, max_gap_us, gap_from_us, gap_to_us, n_observations, seen AND abs(coalesce(run, 0) + coalesce(down, 0) + coalesce(idle, 0) - 28800000000) < 1000000 AS state_ok
  FROM grid g LEFT JOIN sec USING (machine, k) LEFT JOIN cnt USING (machine, k) JOIN cov USING (machine, k) JOIN ev USING (machine, k)
), full_ AS (
  SELECT *, state_ok AND start_ok AND end_ok AND gaps_ok AS complete FROM cell
)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parsed once: the branches of the grid each read the columns they need
    m = saved(events(spark, sf_dir))
    return metrics.effectiveness(of(m, "STATE"), of(m, "COUNT"), m, machines(m), SHIFTS, GAP_S)


OEE = f"""WITH {FULL}, r AS (
  SELECT machine, k, complete, run / 1e6 AS run_seconds, down / 1e6 AS down_seconds, idle / 1e6 AS idle_seconds, good, reject,
         CASE WHEN complete THEN run / 1e6 / 28800.0::DOUBLE END AS availability,
         CASE WHEN complete THEN CASE WHEN run > 0 THEN (good + reject) * {CYCLE_S}::DOUBLE / (run / 1e6) ELSE 0 END END AS performance,
         CASE WHEN complete THEN CASE WHEN good + reject > 0 THEN good::DOUBLE / (good + reject) ELSE 0 END END AS quality
  FROM full_
) SELECT *, availability * performance * quality AS oee FROM r"""
OEE_COLUMNS = ["machine", "k", "complete", "run_seconds", "down_seconds", "idle_seconds", "good", "reject", "availability", "performance", "quality", "oee"]


@query(OEE)
def q_oee_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select(*OEE_COLUMNS)


#: Buckets that facts are laid out in.
BUCKETS = 8


def over_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    m = laid_out(events(spark, sf_dir), f"plantlens_facts_{path.rpartition('/')[2]}", path, BUCKETS)
    return metrics.effectiveness(of(m, "STATE"), of(m, "COUNT"), m, machines(m), SHIFTS, GAP_S)


@query(OEE)
def q_oee_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid over facts laid out by machine and stretch: events are read where they lie and not shuffled."""
    return over_layout(spark, sf_dir).select(*OEE_COLUMNS)


#: Batches that the events are cut into, and the events that come a batch or two late.
BATCHES, LATE = 3, 13


@query(OEE)
def q_oee_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid, kept up to date cell by cell while the events come in batches, some of them late."""
    m = saved(events(spark, sf_dir))
    first, last = m.agg(F.min("log_id"), F.max("log_id")).first()
    due = F.floor((F.col("log_id") - first) * BATCHES / (last - first + 1))
    batch = F.least(F.lit(BATCHES - 1), due + F.when(F.col("seq") % LATE == 0, 1 + F.col("seq") % 2).otherwise(0))
    cells = Cells(spark, shared_dir(spark), SHIFTS, GAP_S)
    for n in range(BATCHES):
        cells.update(m.where(batch == n), n)
    return cells.grid(machines(m)).select(*OEE_COLUMNS)


@query(f"WITH {FULL} SELECT machine, bool_and(complete) AS all_complete, count(*) FILTER (NOT complete) AS n_incomplete, count(*) AS n FROM full_ GROUP BY machine")
def q_completeness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = saved(events(spark, sf_dir))
    rows = metrics.completeness(of(m, "STATE"), m, dense_grid(machines(m), SHIFTS), SHIFTS, GAP_S)
    return rows.groupBy("machine").agg(F.bool_and("complete").alias("all_complete"), F.count_if(~F.col("complete")).alias("n_incomplete"), F.count("*").alias("n"))


ISO = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S')"


@query(
    f"""WITH {FULL} SELECT machine, shift, start_ok, end_ok, gaps_ok, state_ok, max_gap_us / 1e6 AS max_gap_seconds, n_observations, concat_ws(' ',
  CASE WHEN NOT state_ok THEN 'the state of ' || machine || ' is not known throughout ' || shift || ': it has no STATE message up to the start, or its states leave a part of the shift open.' END,
  CASE WHEN NOT start_ok THEN 'no observed telemetry of ' || machine || ' lies within 7200s of the ' || shift || ' window start.' END,
  CASE WHEN NOT end_ok THEN 'no observed telemetry of ' || machine || ' lies within 7200s of the ' || shift || ' window end.' END,
  CASE WHEN NOT gaps_ok THEN 'a gap of ' || round(max_gap_us / 1e6)::BIGINT || 's without messages, ' || {ISO.format('gap_from_us')} || ' to ' || {ISO.format('gap_to_us')} || ', is longer than the 7200s allowed.' END) AS reason
FROM full_ WHERE NOT complete"""
)
def q_incomplete_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).where(~F.col("complete"))
    return rows.select("machine", "shift", "start_ok", "end_ok", "gaps_ok", "state_ok", (F.col("max_gap_us") / MICRO).alias("max_gap_seconds"), "n_observations", F.col("completeness_reason").alias("reason"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the plant's shifts: each machine over the span from its first event to its last, with a cycle time."""
    m = events(spark, sf_dir)
    return m.groupBy("machine").agg(F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("ideal_cycle_s", F.lit(977.5))


SPAN = "span AS (SELECT machine, min(us) AS a, max(us) AS b FROM m GROUP BY machine)"


@query(f"WITH {M}, {SPAN} SELECT machine, make_timestamp(a + k * 977500000) AS ts FROM (SELECT *, unnest(range(1, (b - a - 1) // 977500000 + 1)) AS k FROM span)")
def q_tick_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.tick_times(planned(spark, sf_dir)).select("machine", "ts")


@query(f"WITH {M}, {SPAN} SELECT machine, make_timestamp(a + k * 300000000) AS ts FROM (SELECT *, unnest(range(0, (b - a) // 300000000)) AS k FROM span)")
def q_heartbeat_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.heartbeat_times(planned(spark, sf_dir)).select("machine", "ts")


@query(f"WITH {M} SELECT machine, type, ts, log_id, row_number() OVER (PARTITION BY machine ORDER BY ts, type, log_id) - 1 AS seq_of_machine FROM m")
def q_event_stream_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir).select("machine", "type", "ts", "log_id", microseconds("ts").alias("us"))
    return numbered(m, ["machine"], "us", "seq_of_machine", ["type", "log_id"]).drop("us")


@query(f"WITH {M} SELECT machine, ts, log_id, (row_number() OVER (PARTITION BY machine ORDER BY ts, log_id) % 23 = 0)::INTEGER AS reject FROM m WHERE type = 'COUNT'")
def q_reject_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = of(events(spark, sf_dir), "COUNT").select("machine", "ts", "log_id", F.lit(23).alias("reject_every_n"))
    return generator.with_rejects(m, ["log_id"]).select("machine", "ts", "log_id", "reject")


@query(f"WITH {M} SELECT machine, type, count(*) AS n FROM m WHERE machine IN ('M0', 'M2', 'M4') GROUP BY machine, type")
def q_tag_registry_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = classify.by_registry(events(spark, sf_dir), "machine", ("M0", "M2", "M4"))
    return known.groupBy("machine", "type").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT machine, type, count(*) AS n FROM m WHERE machine NOT IN ('M0', 'M2', 'M4') GROUP BY machine, type")
def q_tag_registry_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, strange = classify.by_registry(events(spark, sf_dir), "machine", ("M0", "M2", "M4"))
    return strange.groupBy("machine", "type").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT coalesce(type, 'all') AS type, count(*) AS n FROM m GROUP BY ROLLUP (type)")
def q_message_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.message_totals(events(spark, sf_dir)).select(F.coalesce("type", F.lit("all")).alias("type"), "n")


PAIRS = "pairs AS (SELECT machine, alarm_code, us, next FROM (SELECT *, lead(us) OVER (PARTITION BY machine, alarm_code ORDER BY us, log_id) AS next FROM m WHERE type = 'ALARM') WHERE phase = 'RAISE')"
SUMS = "count(*) AS count, coalesce(sum(next - us), 0)::BIGINT / 1e6 AS seconds, count(*) FILTER (next IS NULL) AS open_count"


def with_seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seconds", F.col("us") / MICRO).drop("us")


@query(f"WITH {M}, {PAIRS} SELECT machine, alarm_code, {SUMS} FROM pairs GROUP BY machine, alarm_code")
def q_alarm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_seconds(alarms.alarm_summary(of(events(spark, sf_dir), "ALARM")))


@query(f"WITH {M}, {GRID}, {PAIRS} SELECT machine, k, alarm_code, {SUMS} FROM pairs JOIN shifts ON us >= s AND us < e GROUP BY machine, k, alarm_code")
def q_alarm_by_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_seconds(alarms.alarms_by_shift(of(events(spark, sf_dir), "ALARM"), SHIFTS))


@query(f"WITH {M}, {PAIRS} SELECT machine, alarm_code, {SUMS} FROM pairs GROUP BY ROLLUP (machine, alarm_code)")
def q_alarm_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = alarms.raised(of(events(spark, sf_dir), "ALARM"))
    return pairs.rollup("machine", "alarm_code").agg(F.count("*").alias("count"), (F.coalesce(F.sum(F.col("next_us") - F.col("raised_us")), F.lit(0)) / MICRO).alias("seconds"), F.count_if(F.col("next_us").isNull()).alias("open_count"))


#: DuckDB: segments, cut to the windows of the calendar, and what was observed of each window.
CUTS = """seg AS (
  SELECT machine, state, reason_code, us, lead(us) OVER (PARTITION BY machine ORDER BY us, log_id) AS next FROM m WHERE type = 'STATE'
), cut AS (
  SELECT c.machine, shift, state, reason_code, least(coalesce(next, e), e) - greatest(us, s) AS us
  FROM seg JOIN cal c ON c.machine = seg.machine AND us < e AND coalesce(next, e) > s WHERE least(coalesce(next, e), e) > greatest(us, s)
)"""
WINDOWS_COVERED = f"""obs AS (
  SELECT machine, us, lead(us) OVER (PARTITION BY machine ORDER BY us) AS next FROM (SELECT DISTINCT machine, us FROM m)
), win AS (
  SELECT c.*, o.us, o.next, max(CASE WHEN o.next > s AND o.us < e THEN o.next - o.us END) OVER (PARTITION BY c.machine, shift, part) AS top FROM cal c LEFT JOIN obs o ON o.machine = c.machine
), cov AS (
  SELECT machine, shift, part, s, e, coalesce(min(abs(us - s)) <= {GAP_S * MICRO}, false) AS start_ok, coalesce(min(abs(us - e)) <= {GAP_S * MICRO}, false) AS end_ok,
         coalesce(max(top), 0) AS max_gap_us, coalesce(min(CASE WHEN next > s AND us < e AND next - us = top THEN us END), s) AS gap_from_us,
         coalesce(min(CASE WHEN next > s AND us < e AND next - us = top THEN next END), s) AS gap_to_us, count(*) FILTER (us BETWEEN s AND e) AS n_observations
  FROM win GROUP BY machine, shift, part, s, e
)"""


@query(f"WITH {M}, {CALENDAR}, {CUTS} SELECT machine, shift, {STATE_US.format('RUN')} / 1e6 AS run_seconds, {STATE_US.format('DOWN')} / 1e6 AS down_seconds, {STATE_US.format('IDLE')} / 1e6 AS idle_seconds FROM cut GROUP BY machine, shift")
def q_state_seconds_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    found = calendars.state_seconds(segments.segments(of(m, "STATE")), calendar(m))
    return found.select("machine", "shift", *((F.col(f"{s}_us") / MICRO).alias(f"{s}_seconds") for s in ("run", "down", "idle")))


@query(f"WITH {M}, {CALENDAR}, {CUTS} SELECT machine, shift, reason_code, sum(us)::BIGINT / 1e6 AS seconds FROM cut WHERE state = 'DOWN' GROUP BY machine, shift, reason_code")
def q_downtime_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return with_seconds(calendars.downtime(segments.segments(of(m, "STATE")), calendar(m)))


@query(f"WITH {M}, {CALENDAR} SELECT c.machine, shift, sum(good_delta)::BIGINT AS good, sum(reject_delta)::BIGINT AS reject FROM m JOIN cal c ON c.machine = m.machine AND us >= s AND us < e WHERE type = 'COUNT' GROUP BY c.machine, shift")
def q_counts_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return calendars.counts(of(m, "COUNT"), calendar(m))


@query(f"WITH {M}, {CALENDAR}, {WINDOWS_COVERED} SELECT machine, shift, part, s AS s_us, e AS e_us, start_ok, end_ok, max_gap_us <= {GAP_S * MICRO} AS gaps_ok, max_gap_us, gap_from_us, gap_to_us, n_observations FROM cov")
def q_coverage_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return calendars.coverage(m, calendar(m), GAP_S)


@query(f"WITH {M}, {CALENDAR}, {PAIRS} SELECT p.machine, shift, alarm_code, {SUMS} FROM pairs p JOIN cal c ON c.machine = p.machine AND us >= s AND us < e GROUP BY p.machine, shift, alarm_code")
def q_alarms_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return with_seconds(calendars.alarms_by_shift(of(m, "ALARM"), calendar(m)))


@query(
    f"""WITH {M}, {CALENDAR}, {CUTS}, {WINDOWS_COVERED}, sec AS (
  SELECT machine, shift, {STATE_US.format('RUN')} AS run, {STATE_US.format('DOWN')} AS down, {STATE_US.format('IDLE')} AS idle FROM cut GROUP BY machine, shift
), cnt AS (
  SELECT c.machine, shift, sum(good_delta)::BIGINT AS good, sum(reject_delta)::BIGINT AS reject FROM m JOIN cal c ON c.machine = m.machine AND us >= s AND us < e WHERE type = 'COUNT' GROUP BY c.machine, shift
), sh AS (
  SELECT machine, shift, min(s) AS s, sum(e - s)::BIGINT AS planned, bool_and(start_ok AND end_ok AND max_gap_us <= {GAP_S * MICRO}) AS covered FROM cov GROUP BY machine, shift
), r AS (
  SELECT sh.machine, sh.shift, planned / 1e6 AS planned_seconds, coalesce(run, 0) AS run, coalesce(down, 0) AS down, coalesce(idle, 0) AS idle, coalesce(good, 0) AS good, coalesce(reject, 0) AS reject, cycle,
         covered AND coalesce((SELECT min(us) FROM m WHERE m.machine = sh.machine AND type = 'STATE') <= sh.s, false) AND abs(coalesce(run, 0) + coalesce(down, 0) + coalesce(idle, 0) - planned) < 1000000 AS complete
  FROM sh LEFT JOIN sec USING (machine, shift) LEFT JOIN cnt USING (machine, shift) JOIN cyc USING (machine)
), x AS (
  SELECT machine, shift, planned_seconds, complete, run / 1e6 AS run_seconds, down / 1e6 AS down_seconds, idle / 1e6 AS idle_seconds, good, reject,
         CASE WHEN complete THEN run / 1e6 / planned_seconds END AS availability,
         CASE WHEN complete THEN CASE WHEN run > 0 THEN (good + reject) * cycle / (run / 1e6) ELSE 0 END END AS performance,
         CASE WHEN complete THEN CASE WHEN good + reject > 0 THEN good::DOUBLE / (good + reject) ELSE 0 END END AS quality
  FROM r
) SELECT *, availability * performance * quality AS oee FROM x"""
)
def q_oee_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    rows = calendars.effectiveness(of(m, "STATE"), segments.segments(of(m, "STATE")), of(m, "COUNT"), m, cycles(m), calendar(m), GAP_S)
    return rows.select("machine", "shift", "planned_seconds", "complete", "run_seconds", "down_seconds", "idle_seconds", "good", "reject", "availability", "performance", "quality", "oee")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(replayed(spark, sf_dir), POLICY)


@query(f"WITH RECURSIVE {M}, {A} SELECT arrival_id, category FROM z")
def q_classify_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("arrival_id", "category")


#: DuckDB: messages of which whole blocks were delivered twice or three times under the same arrival_id; every copy but the first of a seq is a duplicate.
TWICE = """t AS (
  SELECT z.arrival_id, seq, CASE WHEN copy > 0 AND category NOT IN ('bad_payload', 'unknown_tag', 'seq_conflict') THEN 'duplicate' ELSE category END AS category
  FROM (SELECT *, unnest(range(CASE arrival_id // 1000 % 7 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 1 END)) AS copy FROM z) z
)"""


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of messages of which whole blocks were delivered again, under the same arrival_ids."""
    block = F.floor(F.col("arrival_id") / 1000) % 7
    times = F.when(block == 3, 2).when(block == 5, 3).otherwise(1)
    again = replayed(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return classify.classify(again.select("arrival_id", "raw_payload", F.concat(F.lit("delivery "), F.col("copy").cast("string")).alias("file")), POLICY)


@query(f"WITH RECURSIVE {M}, {A}, {TWICE} SELECT arrival_id, seq, category, count(*) AS n FROM t GROUP BY ALL")
def q_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered line has one row, whatever came twice; n counts the lines of an arrival_id in a category."""
    # a refused text shows the seq it claims, which the twin does not know
    seq = F.when(F.col("category") != "bad_payload", F.col("seq")).alias("seq")
    return redelivered(spark, sf_dir).select("arrival_id", seq, "category").groupBy("arrival_id", "seq", "category").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {M}, {A} SELECT z.tag AS machine, sum(good_delta)::BIGINT AS good, sum(reject_delta)::BIGINT AS reject, count(*) AS n_messages
  FROM z JOIN m USING (seq) WHERE category IN ('accepted', 'accepted_late') AND type = 'COUNT' GROUP BY z.tag"""
)
def q_redelivered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of accepted messages: the same whether or not blocks were delivered again."""
    ticks = facts(redelivered(spark, sf_dir), "COUNT")
    return ticks.groupBy("machine").agg(F.sum(F.col("good_delta").cast("long")).alias("good"), F.sum(F.col("reject_delta").cast("long")).alias("reject"), F.count("*").alias("n_messages"))


#: Times that the ledger is closed and opened again while the events come in.
RESTARTS = 3


@query(f"WITH RECURSIVE {M}, {A} SELECT arrival_id, category, CASE WHEN category <> 'bad_payload' THEN seq END AS seq FROM z")
def q_restarted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written in batches, each by a new process that restores seqs, watermarks and alarms from what lies there."""
    m = saved(replayed(spark, sf_dir))
    first, last = m.agg(F.min("arrival_id"), F.max("arrival_id")).first()
    # ranges, so that a batch skips what lies in others
    begins, path = [first - (first - last - 1) * n // RESTARTS for n in range(RESTARTS + 1)], shared_dir(spark)
    for n in range(RESTARTS):
        Ledger(spark, path, POLICY).append(m.where((F.col("arrival_id") >= begins[n]) & (F.col("arrival_id") < begins[n + 1])), n)
    return Ledger(spark, path, POLICY).read().select("arrival_id", "category", F.when(F.col("category") != "bad_payload", F.col("seq")).alias("seq"))


def logged(text: str) -> str:
    """DuckDB: which of a broken text's own fields may be shown: those of the right type, (tag, type, seq, ts) of an event or as they stand."""
    try:
        m = json.loads(text.replace("<seq>", "1"))
    except ValueError:
        m = {}
    m = m if isinstance(m, dict) else {}
    own = {"<tag>": "machine", "<at>": "told_at"}
    shown = lambda v: (own.get(v) or f"'{v}'") if isinstance(v, str) else "NULL"
    number = "seq" if type(m.get("seq")) is int and m["seq"] < 2**63 else "NULL"
    return f"{{'tag': {shown(m.get('tag'))}, 'msg_type': {shown(m.get('type'))}, 'seq': {number}, 'ts_raw': {shown(m.get('ts'))}}}"


@query(
    f"""WITH {M}, t AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS told_at FROM m), x AS (
  SELECT log_id + 9 AS arrival_id, [{', '.join(logged(text) for text, _ in BROKEN)}][(seq // 11) % {len(BROKEN)} + 1] AS f FROM t WHERE seq % 11 = 5
) SELECT arrival_id, f.tag AS tag, f.msg_type AS msg_type, f.seq AS seq, f.ts_raw AS ts_raw FROM x
UNION ALL SELECT log_id + 7, NULL, NULL, NULL, NULL FROM t WHERE seq % 40 = 0"""
)
def q_refused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of refused messages: only fields of the right type."""
    return ledger(spark, sf_dir).where("category = 'bad_payload'").select("arrival_id", "tag", "msg_type", "seq", "ts_raw")


@query(f"WITH RECURSIVE {M}, {A} SELECT category, count(*) AS n FROM z GROUP BY category")
def q_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {M}, {A} SELECT arr AS arrival_id, seq, rn = 1 AS is_first, h0 = h AS same FROM b")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.parsed_messages(replayed(spark, sf_dir))
    known, _ = classify.by_registry(rows.where("reason is null"), "tag", POLICY.tags)
    return classify.with_first(known.select(*classify.ORDER, "seq", "content_hash")).select("arrival_id", "seq", "is_first", (F.col("content_hash") == F.col("first_hash")).alias("same"))


@query(f"WITH RECURSIVE {M}, {A} SELECT arrival_id, seq, tag AS machine, CASE category WHEN 'duplicate' THEN 'seq ' || seq || ' already ingested' ELSE 'seq ' || seq || ' already ingested with different content (content hash mismatch)' END AS reason FROM z WHERE category IN ('duplicate', 'seq_conflict')")
def q_seq_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where(F.col("category").isin("duplicate", "seq_conflict")).select("arrival_id", "seq", F.col("tag").alias("machine"), "reason")


@query(f"WITH {M} SELECT machine, log_id, max(us) OVER (PARTITION BY machine ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark_us FROM m")
def q_watermark_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir).select("machine", "log_id", microseconds("ts").alias("us"))
    return running_max(m, "machine", "log_id", "us", "mark_us", 5000).select("machine", "log_id", "mark_us")


@query(f"WITH RECURSIVE {M}, {A} SELECT arr AS arrival_id, cat AS category, CASE WHEN cat <> 'accepted' THEN (mark - us)::BIGINT END AS delay_us FROM d")
def q_late_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.parsed_messages(replayed(spark, sf_dir))
    # as counts, so that the order of alarms plays no part
    rows = rows.where(F.col("reason").isNull() & F.col("tag").isin(*POLICY.tags)).drop("reason").withColumn("msg_type", F.lit("COUNT"))
    late = classify.decided(rows, POLICY).where("is_first").join(rows.select("line", "arrival_id", "ts_us"), "line")
    return late.select("arrival_id", "category", F.when(F.col("category") != "accepted", F.col("mark_us") - F.col("ts_us")).alias("delay_us"))


@query(f"WITH RECURSIVE {M}, {A} SELECT tag AS machine, make_timestamp(mark) AS gap_start, make_timestamp(us) AS gap_end, (us - mark) / 1e6 AS gap_seconds FROM z WHERE category = 'accepted' AND us - mark > 600000000")
def q_clock_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock_gaps(ledger(spark, sf_dir)).select("machine", "gap_start", "gap_end", "gap_seconds")


@query(f"WITH RECURSIVE {M}, {A} SELECT arr AS arrival_id, ok AS alarm_ok FROM f WHERE i > 0")
def q_alarm_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(spark, sf_dir).where((F.col("msg_type") == "ALARM") & F.col("category").isin("accepted", "accepted_late", "alarm_out_of_order_rejected"))
    return found.select("arrival_id", (F.col("category") != "alarm_out_of_order_rejected").alias("alarm_ok"))


#: Arrivals of one stretch of the single line; far fewer than in production, so that a small table has many.
LINE_STRETCH = 2_000


@query(
    f"""WITH RECURSIVE {M}, e AS (
  SELECT log_id, us, raises, row_number() OVER (ORDER BY log_id) AS i FROM (SELECT log_id, us, (seq * 7919 // 13) % 5 < 3 AS raises FROM m)
), f AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS log_id, false AS ok, false AS up, -9223372036854775807::BIGINT AS at
  UNION ALL
  SELECT e.i, e.log_id, e.raises <> f.up AND e.us >= f.at, CASE WHEN e.us >= f.at THEN e.raises ELSE f.up END, CASE WHEN e.raises <> f.up AND e.us >= f.at THEN e.us ELSE f.at END
  FROM f JOIN e ON e.i = f.i + 1
) SELECT log_id, ok AS alarm_ok FROM f WHERE i > 0"""
)
def q_alarm_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as alarms of a single line: one key, which is followed in stretches side by side."""
    e = events(spark, sf_dir)
    raises = F.floor(F.col("seq") * 7919 / 13) % 5 < 3
    rows = e.select(F.lit("LINE").alias("tag"), F.lit("ANY").alias("alarm_code"), F.when(raises, "RAISE").otherwise("CLEAR").alias("phase"), microseconds("ts").alias("ts_us"), F.col("log_id").alias("line"))
    return alarm_verdicts(rows, None, ["line"], LINE_STRETCH).select(F.col("line").alias("log_id"), "alarm_ok")


@query(f"WITH RECURSIVE {M}, {A}, w AS (SELECT z.tag, g.alarm_code, arg_max(g.phase, z.arrival_id) AS phase, arg_max(z.us, z.arrival_id) AS ts_us FROM z JOIN g ON g.arr = z.arrival_id WHERE z.category IN ('accepted', 'accepted_late') GROUP BY z.tag, g.alarm_code) SELECT * FROM w")
def q_last_alarm_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.carry_of(ledger(spark, sf_dir)).alarms


@query(f"WITH RECURSIVE {M}, {A} SELECT tag, max(us) AS mark_us FROM z WHERE category NOT IN ('bad_payload', 'unknown_tag', 'duplicate', 'seq_conflict') GROUP BY tag")
def q_watermark_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.carry_of(ledger(spark, sf_dir)).marks


#: Why a planted broken text is refused, by its place in the list; the ids of planted ones end in 9.
REASON_LIST = "[" + ", ".join("'" + reason.replace("'", "''") + "'" for _, reason in BROKEN) + "]"


@query(
    f"""WITH RECURSIVE {M}, {A} SELECT arr AS arrival_id, CASE WHEN bad AND arr % 10 = 9 THEN ({REASON_LIST})[(arr // 110) % {len(BROKEN)} + 1] WHEN bad THEN 'invalid JSON'
  ELSE 'tag ''MX'' not in known machine registry' END AS reason FROM a WHERE bad OR tag = 'MX'"""
)
def q_grammar_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where(F.col("category").isin("bad_payload", "unknown_tag")).select("arrival_id", "reason")


@query(
    f"""WITH {M}, t AS (
  SELECT *, ', "tag": "' || machine || '", "ts": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00", "type": "HEARTBEAT"}}' AS rest FROM m WHERE type = 'HEARTBEAT'
) SELECT log_id AS arrival_id, sha256('{{"seq": ' || seq || rest) AS content_hash FROM t WHERE seq % 97 <> 5
UNION ALL SELECT log_id + 505, sha256('{{"note": "changed", "seq": ' || seq || rest) FROM t WHERE seq % 97 = 5 AND seq % 75 = 0"""
)
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).where((F.col("msg_type") == "HEARTBEAT") & F.col("category").isin(*classify.SEEN_CATEGORIES))
    return rows.select("arrival_id", "content_hash")


@query("SELECT event_id, replace(replace(replace(replace(replace(event_type || '<' || props || '>&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM events")
def q_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", html_escape(F.concat("event_type", F.lit("<"), "props", F.lit(">&'"))).alias("escaped"))


PLANTED = "p AS (SELECT machine, alarm_code, phase FROM m WHERE type = 'ALARM')"


@query(
    f"""WITH RECURSIVE {M}, {A}, {PLANTED}, t AS (
  SELECT tag AS machine, g.alarm_code, g.phase FROM (SELECT arrival_id FROM z WHERE category IN ('accepted', 'accepted_late')) z JOIN g ON g.arr = z.arrival_id
) SELECT machine, alarm_code, phase, 'planted' AS only_in, count(*) AS n FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM t) GROUP BY ALL
UNION ALL SELECT machine, alarm_code, phase, 'accepted', count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM p) GROUP BY ALL"""
)
def q_alarm_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of alarms that were planted but not accepted so often, or accepted more often than planted."""
    keys = ["machine", "alarm_code", "phase"]
    return difference(of(events(spark, sf_dir), "ALARM").select(*keys), facts(ledger(spark, sf_dir), "ALARM").select(*keys), "planted", "accepted")


@query(f"WITH {M} SELECT machine, ts, row_number() OVER (PARTITION BY machine ORDER BY ts) AS place FROM (SELECT DISTINCT machine, ts FROM m)")
def q_observed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine's observed times in their order."""
    seen = events(spark, sf_dir).select("machine", "ts").distinct().withColumn("us", microseconds("ts"))
    return numbered(seen, ["machine"], "us", "nth").select("machine", "ts", (F.col("nth") + 1).alias("place"))


@query(f"WITH {M}, {GRID}, {SEG} SELECT machine, k, reason_code, us AS down_us, row_number() OVER (PARTITION BY machine, k ORDER BY us DESC, reason_code) AS place FROM (SELECT machine, k, reason_code, sum(us)::BIGINT AS us FROM cut WHERE state = 'DOWN' GROUP BY machine, k, reason_code)")
def q_pareto_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of a shift's downtime in order of their time, longest first; a shift has as many rows as reasons."""
    found = segments.downtime_pareto(segments.segments(of(events(spark, sf_dir), "STATE")), SHIFTS)
    place = F.row_number().over(Window.partitionBy("machine", "k").orderBy(F.desc("us"), "reason_code"))
    return found.select("machine", "k", "reason_code", F.col("us").alias("down_us"), place.cast("long").alias("place"))


@query(f"WITH RECURSIVE {M}, {A}, {PAIRS} SELECT 'alarm' AS list, machine || ' ' || alarm_code AS name, row_number() OVER (ORDER BY machine, alarm_code) AS place FROM (SELECT DISTINCT machine, alarm_code FROM pairs) UNION ALL SELECT 'category', category, row_number() OVER (ORDER BY category) FROM (SELECT DISTINCT category FROM z)")
def q_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lists of alarms and of categories in their order; both are as short as the report."""
    summary = alarms.alarm_summary(of(events(spark, sf_dir), "ALARM")).select(F.lit("alarm").alias("list"), F.concat_ws(" ", "machine", "alarm_code").alias("name"), F.struct("machine", "alarm_code").alias("key"))
    named = totals(ledger(spark, sf_dir)).select(F.lit("category").alias("list"), F.col("category").alias("name"), F.struct(F.col("category").alias("machine"), F.lit("").alias("alarm_code")).alias("key"))
    return summary.union(named).select("list", "name", F.row_number().over(Window.partitionBy("list").orderBy("key")).cast("long").alias("place"))


def values(rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


def second(at) -> int:
    """Seconds since the day's midnight."""
    return int((at - schedule.DAY).total_seconds())


#: DuckDB: the fixed day's states, alarms, machines, shifts, ticks and what they come to.
DAY = f"""st(machine, state, a, b, reason_code) AS {values([(m, s, second(a), second(b), r) for m, s, a, b, r in schedule.state_rows()])},
al(machine, alarm_code, a, b) AS {values([(m, c, second(a), second(b)) for m, c, a, b in schedule.alarm_rows()])},
mc(machine, cycle, n) AS {values([(m, int(c), n) for m, c, n in schedule.MACHINES])},
sh AS (SELECT k::INTEGER AS k, k * 28800 AS s, (k + 1) * 28800 AS e FROM range(3) r(k)),
part AS (SELECT machine, k, state, reason_code, least(b, e) - greatest(a, s) AS sec, a >= s AS begins FROM st JOIN sh ON a < e AND b > s),
sec AS (
  SELECT machine, k, sum(CASE WHEN state = 'RUN' THEN sec ELSE 0 END)::DOUBLE AS run_seconds, sum(CASE WHEN state = 'DOWN' THEN sec ELSE 0 END)::DOUBLE AS down_seconds,
         sum(CASE WHEN state = 'IDLE' THEN sec ELSE 0 END)::DOUBLE AS idle_seconds FROM part GROUP BY machine, k
), tick AS (
  SELECT machine, n, a + cycle * i AS t FROM (SELECT machine, n, cycle, a, unnest(range(1, (b - a - 1) // cycle + 1)) AS i FROM st JOIN mc USING (machine) WHERE state = 'RUN')
), cnt AS (
  SELECT machine, (t // 28800)::INTEGER AS k, sum(1 - r)::BIGINT AS good, sum(r)::BIGINT AS reject
  FROM (SELECT machine, t, (row_number() OVER (PARTITION BY machine ORDER BY t) % n = 0)::INTEGER AS r FROM tick) GROUP BY ALL
), day AS (
  SELECT machine, k, run_seconds, down_seconds, idle_seconds, good, reject, run_seconds / 28800 AS availability, (good + reject) * cycle::DOUBLE / run_seconds AS performance, good::DOUBLE / (good + reject) AS quality
  FROM sec JOIN cnt USING (machine, k) JOIN mc USING (machine)
)"""


def day_ledger(spark: SparkSession) -> DataFrame:
    return saved(classify.classify(generator.demonstration_day(spark)))


@of_day(f"WITH {DAY} SELECT *, availability * performance * quality AS oee, true AS complete FROM day")
def q_demonstration_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed day from generator to effectiveness."""
    book = day_ledger(spark)
    rows = metrics.effectiveness(facts(book, "STATE"), facts(book, "COUNT"), observations(book), schedule.machines_df(spark), Shifts(), 600)
    return rows.select("machine", "k", "run_seconds", "down_seconds", "idle_seconds", "good", "reject", "availability", "performance", "quality", "oee", "complete")


@of_day(f"WITH {DAY} SELECT *, availability * performance * quality AS oee, down_seconds + idle_seconds AS downtime_seconds FROM day")
def q_demonstration_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed day comes to by its schedule alone."""
    return truth.expected(spark)


DOWN = f"WITH {DAY} SELECT machine, k, reason_code, sum(sec)::DOUBLE AS seconds, count(*) FILTER (begins) AS events FROM part WHERE state = 'DOWN' GROUP BY machine, k, reason_code"


@of_day(DOWN)
def q_demonstration_downtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downtime by reason of the fixed day, from its messages."""
    states = facts(day_ledger(spark), "STATE")
    seconds = segments.downtime_pareto(segments.segments(states), Shifts())
    events_ = segments.downtime_events(states, Shifts())
    return seconds.join(events_, ["machine", "k", "reason_code"], "left").select("machine", "k", "reason_code", (F.col("us") / MICRO).alias("seconds"), F.coalesce("n", F.lit(0)).alias("events"))


@of_day(DOWN)
def q_demonstration_downtime_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.expected_downtime(spark)


@of_day(f"WITH {DAY} SELECT machine, (a // 28800)::INTEGER AS k, alarm_code, count(*) AS count, sum(b - a)::DOUBLE AS seconds, 0::BIGINT AS open_count FROM al GROUP BY ALL")
def q_demonstration_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of the fixed day by shift, from its messages."""
    return with_seconds(alarms.alarms_by_shift(facts(day_ledger(spark), "ALARM"), Shifts()))


@of_day(f"WITH {DAY} SELECT machine, alarm_code, (a // 28800)::INTEGER AS k, count(*) AS count, sum(b - a)::DOUBLE AS seconds FROM al GROUP BY GROUPING SETS ((machine, alarm_code, (a // 28800)::INTEGER), (machine, alarm_code))")
def q_demonstration_alarm_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.expected_alarms(spark)


@of_day(f"WITH {DAY} SELECT DISTINCT machine, alarm_code, true AS reported, true AS planned FROM al")
def q_demonstration_alarm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of alarms in the report and in the schedule; both sides hold the same."""
    reported = alarms.alarm_summary(facts(day_ledger(spark), "ALARM")).select("machine", "alarm_code", F.lit(True).alias("reported"))
    return truth.same_keys(reported, schedule.alarms_df(spark))


@of_day(
    f"""WITH {DAY}, n(type, n) AS (
  SELECT 'STATE', count(*) FROM st UNION ALL SELECT 'ALARM', 2 * count(*) FROM al UNION ALL SELECT 'COUNT', count(*) FROM tick UNION ALL SELECT 'HEARTBEAT', 288 * count(*) FROM mc
) SELECT type, n::BIGINT AS n FROM n UNION ALL SELECT NULL, sum(n)::BIGINT FROM n"""
)
def q_demonstration_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.expected_messages(spark)


@of_day("SELECT 'accepted' AS category, (SELECT n FROM (WITH " + DAY + " SELECT (SELECT count(*) FROM st) + 2 * (SELECT count(*) FROM al) + (SELECT count(*) FROM tick) + 288 * (SELECT count(*) FROM mc) AS n))::BIGINT AS n")
def q_demonstration_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the fixed day are accepted."""
    return totals(day_ledger(spark))
