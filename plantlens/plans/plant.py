"""The testdata's `events` read as telemetry of a plant, in Spark and in DuckDB SQL.

Machines are user groups, a message's type follows the event type, and its
sequence number is the event's. Every eleventh event arrives six places late.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.grammar import microseconds
from plantlens.operators.classify import iso
from plantlens.operators.grid import base_us
from plantlens.schema import Policy, Shifts

SHIFTS = Shifts(base=datetime(2024, 1, 1), hours=8, count=90)
#: The data are sparse; two hours leave both complete and incomplete shifts.
GAP_S = 7200
POLICY = Policy(tags=tuple(f"M{i}" for i in range(5)), gap_s=600, shifts=SHIFTS)
CYCLE_S = 400.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """machine, ts, type, state, reason_code, alarm_code, phase, good_delta, reject_delta, seq, log_id (order of arrival)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind = F.when(F.col("event_type") == "error", "STATE").when(F.col("event_type") == "signup", "ALARM").when(F.col("event_type") == "view", "HEARTBEAT").otherwise("COUNT")
    state = F.when(F.col("user_id") % 3 == 0, "DOWN").when(F.col("user_id") % 3 == 1, "IDLE").otherwise("RUN")
    reject = F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    rows = e.select("ts", "event_id", "user_id", k.alias("key"), kind.alias("type"), state.alias("state0"), reject.alias("reject0"))
    of = lambda t, c: F.when(F.col("type") == t, c)
    return rows.select(
        F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string")).alias("machine"),
        "ts",
        "type",
        of("STATE", F.col("state0")).alias("state"),
        F.when((F.col("type") == "STATE") & (F.col("state0") == "DOWN"), F.concat(F.lit("R"), (F.col("key") % 4).cast("string"))).alias("reason_code"),
        of("ALARM", F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string"))).alias("alarm_code"),
        of("ALARM", F.when(F.col("key") % 2 == 0, "RAISE").otherwise("CLEAR")).alias("phase"),
        of("COUNT", 1 - F.col("reject0")).alias("good_delta"),
        of("COUNT", F.col("reject0")).alias("reject_delta"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 10 + F.when(F.col("event_id") % 11 == 0, 61).otherwise(0)).alias("log_id"),
    )


#: DuckDB: the same rows as view m.
M = """m AS (
  SELECT machine, ts, type, CASE WHEN type = 'STATE' THEN state0 END AS state,
         CASE WHEN type = 'STATE' AND state0 = 'DOWN' THEN 'R' || (key % 4) END AS reason_code,
         CASE WHEN type = 'ALARM' THEN 'A' || (user_id % 4) END AS alarm_code,
         CASE WHEN type = 'ALARM' THEN CASE WHEN key % 2 = 0 THEN 'RAISE' ELSE 'CLEAR' END END AS phase,
         CASE WHEN type = 'COUNT' THEN 1 - reject0 END AS good_delta, CASE WHEN type = 'COUNT' THEN reject0 END AS reject_delta,
         event_id AS seq, event_id * 10 + CASE WHEN event_id % 11 = 0 THEN 61 ELSE 0 END AS log_id, epoch_us(ts) AS us
  FROM (SELECT *, 'M' || (user_id % 5) AS machine, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS key,
               CASE event_type WHEN 'error' THEN 'STATE' WHEN 'signup' THEN 'ALARM' WHEN 'view' THEN 'HEARTBEAT' ELSE 'COUNT' END AS type,
               CASE user_id % 3 WHEN 0 THEN 'DOWN' WHEN 1 THEN 'IDLE' ELSE 'RUN' END AS state0,
               CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS reject0
        FROM events)
)"""
#: DuckDB: shifts (k, shift, s, e in microseconds) and the machine x shift grid.
GRID = """shifts AS (
  SELECT k::INTEGER AS k, 'SHIFT_' || (k + 1) AS shift, epoch_us(TIMESTAMP '2024-01-01') + k * 28800000000 AS s, epoch_us(TIMESTAMP '2024-01-01') + (k + 1) * 28800000000 AS e FROM range(90) r(k)
), grid AS (
  SELECT machine, k, shift, s, e FROM (SELECT DISTINCT machine FROM m), shifts
)"""


HOUR, MINUTE = 3_600_000_000, 60_000_000


def calendar(m: DataFrame) -> DataFrame:
    """Windows for each day on which a machine was heard of: an early shift with a break, a late one that overlaps it on some days, and one over midnight, of lengths that differ by machine and day."""
    days = m.select("machine", F.floor((microseconds("ts") - base_us(SHIFTS)) / (24 * HOUR)).alias("d")).distinct()
    number, o = F.substring("machine", 2, 9).cast("long"), base_us(SHIFTS) + F.col("d") * 24 * HOUR
    early = o + 5 * HOUR + number * 17 * MINUTE
    window = lambda shift, part, s, e: F.struct(F.lit(shift).alias("name"), F.lit(part).alias("part"), s.alias("s_us"), e.alias("e_us"))
    windows = F.array(
        window("EARLY", 0, early, early + 225 * MINUTE),
        window("EARLY", 1, early + 255 * MINUTE, o + 13 * HOUR + F.col("d") % 4 * 20 * MINUTE),
        window("LATE", 0, o + 13 * HOUR, o + 1350 * MINUTE + number * 10 * MINUTE),
        window("NIGHT", 0, o + 23 * HOUR, o + 28 * HOUR + F.col("d") % 3 * 30 * MINUTE),
    )
    rows = days.select("machine", "d", F.explode(windows).alias("w")).where((F.col("w.name") != "LATE") | (F.col("d") % 7 != 6))
    return rows.select("machine", F.concat(F.lit("D"), F.col("d").cast("string"), F.lit(" "), F.col("w.name")).alias("shift"), "w.part", "w.s_us", "w.e_us")


def cycles(m: DataFrame) -> DataFrame:
    """Machines with ideal cycles of their own."""
    return m.select("machine").distinct().withColumn("ideal_cycle_s", 260.0 + 35.5 * F.substring("machine", 2, 9).cast("long"))


#: DuckDB: the calendar and the cycles.
CALENDAR = """days AS (
  SELECT DISTINCT machine, (us - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS d, substr(machine, 2)::BIGINT AS i FROM m
), o AS (SELECT *, epoch_us(TIMESTAMP '2024-01-01') + d * 86400000000 AS o FROM days),
cal AS (
  SELECT machine, 'D' || d || ' ' || w.name AS shift, w.part::INTEGER AS part, w.s AS s, w.e AS e FROM (
    SELECT machine, d, unnest([
      {'name': 'EARLY', 'part': 0, 's': o + 18000000000 + i * 1020000000, 'e': o + 18000000000 + i * 1020000000 + 13500000000},
      {'name': 'EARLY', 'part': 1, 's': o + 18000000000 + i * 1020000000 + 15300000000, 'e': o + 46800000000 + d % 4 * 1200000000},
      {'name': 'LATE', 'part': 0, 's': o + 46800000000, 'e': o + 81000000000 + i * 600000000},
      {'name': 'NIGHT', 'part': 0, 's': o + 82800000000, 'e': o + 100800000000 + d % 3 * 1800000000}]) AS w FROM o)
  WHERE w.name <> 'LATE' OR d % 7 <> 6
), cyc AS (SELECT machine, 260.0::DOUBLE + 35.5 * i AS cycle FROM (SELECT DISTINCT machine, i FROM days))"""


# The reasons.
#: Payloads that the grammar refuses, one for each rule, and why; <seq>, <at> and <tag> stand for an event's own.
BROKEN = [
    ("", "invalid JSON"),
    ("[1, 2]", "payload is not a JSON object"),
    ('{"ts": "<at>", "tag": "<tag>", "type": "HEARTBEAT"}', "missing field seq"),
    ('{"seq": "<seq>", "ts": "<at>", "tag": "<tag>", "type": "HEARTBEAT"}', "field seq must be an integer"),
    ('{"seq": 1.5, "ts": "<at>", "tag": "<tag>", "type": "HEARTBEAT"}', "field seq must be an integer"),
    ('{"seq": 9223372036854775808, "ts": "<at>", "tag": "<tag>", "type": "HEARTBEAT"}', "field seq is out of BIGINT range"),
    ('{"seq": <seq>, "ts": "<at>", "type": "HEARTBEAT"}', "missing field tag"),
    ('{"seq": <seq>, "ts": "<at>", "tag": 7, "type": "HEARTBEAT"}', "field tag must be a string"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>"}', "missing field type"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": null}', "field type must be a string"),
    ('{"seq": <seq>, "tag": "<tag>", "type": "HEARTBEAT"}', "missing field ts"),
    ('{"seq": <seq>, "ts": "soon", "tag": "<tag>", "type": "HEARTBEAT"}', "field ts is not a valid timezone-aware ISO8601 timestamp"),
    ('{"seq": <seq>, "ts": "2024-01-01T00:00:00", "tag": "<tag>", "type": "HEARTBEAT"}', "field ts is not a valid timezone-aware ISO8601 timestamp"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "X"}', "unknown type 'X'"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "STATE", "state": "SPINNING", "reason_code": null}', "STATE.state must be one of RUN/IDLE/DOWN"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "STATE", "state": "DOWN", "reason_code": null}', "DOWN state requires a non-empty reason_code"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "STATE", "state": "RUN", "reason_code": "R1"}', "reason_code must be null unless state is DOWN"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "COUNT", "good_delta": -1, "reject_delta": 0}', "COUNT.good_delta must be an integer in [0, 2147483647]"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "COUNT", "good_delta": 1, "reject_delta": 2147483648}', "COUNT.reject_delta must be an integer in [0, 2147483647]"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "COUNT", "good_delta": 0, "reject_delta": 0}', "COUNT must have a nonzero good_delta or reject_delta"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "ALARM", "alarm_code": "", "phase": "RAISE"}', "ALARM.alarm_code must be a non-empty string"),
    ('{"seq": <seq>, "ts": "<at>", "tag": "<tag>", "type": "ALARM", "alarm_code": "A1", "phase": "MAYBE"}', "ALARM.phase must be RAISE or CLEAR"),
]


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival_id and raw_payload of all events, with replays, conflicts, cut-off and otherwise broken texts and unknown tags put in."""
    m = events(spark, sf_dir).withColumn("at", iso(microseconds("ts")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: F.col(c).cast("string")
    body = (
        F.when(F.col("type") == "STATE", F.concat(F.lit(', "state": '), quoted(F.col("state")), F.lit(', "reason_code": '), F.coalesce(quoted(F.col("reason_code")), F.lit("null"))))
        .when(F.col("type") == "COUNT", F.concat(F.lit(', "good_delta": '), number("good_delta"), F.lit(', "reject_delta": '), number("reject_delta")))
        .when(F.col("type") == "ALARM", F.concat(F.lit(', "alarm_code": '), quoted(F.col("alarm_code")), F.lit(', "phase": '), quoted(F.col("phase"))))
        .otherwise("")
    )
    text = lambda tag, note: F.concat(F.lit('{"seq": '), number("seq"), F.lit(', "ts": '), quoted(F.col("at")), F.lit(', "tag": '), quoted(tag), F.lit(', "type": '), quoted(F.col("type")), body, F.lit(note), F.lit("}"))
    own = text(F.when(F.col("seq") % 97 == 5, "MX").otherwise(F.col("machine")), "")
    copy = lambda arrival, payload: F.struct(arrival.alias("arrival_id"), payload.alias("raw_payload"))
    broken = F.element_at(F.array(*(F.lit(text) for text, _ in BROKEN)), (F.floor(F.col("seq") / 11) % len(BROKEN) + 1).cast("int"))
    for sign, value in (("<seq>", number("seq")), ("<at>", F.col("at")), ("<tag>", F.col("machine"))):
        broken = F.replace(broken, F.lit(sign), value)
    m, own = m.withColumn("own", own), F.col("own")
    copies = F.array(
        copy(F.col("log_id"), own),
        F.when(F.col("seq") % 50 == 0, copy(F.col("log_id") + 303, own)),
        F.when(F.col("seq") % 75 == 0, copy(F.col("log_id") + 505, text(F.col("machine"), ', "note": "changed"'))),
        F.when(F.col("seq") % 40 == 0, copy(F.col("log_id") + 7, F.substring(own, 1, 30))),
        F.when(F.col("seq") % 11 == 5, copy(F.col("log_id") + 9, broken)),
    )
    # what filters inside an array is not compiled, nor is all that it is given
    return m.select(F.explode(copies).alias("c")).where("c is not null").select("c.arrival_id", "c.raw_payload")


#: DuckDB: the same messages as view a, typed: bad for cut-off texts, h stands for the content.
A = """a AS (
  SELECT log_id AS arr, seq, us, type, alarm_code, phase, CASE WHEN seq % 97 = 5 THEN 'MX' ELSE machine END AS tag, false AS bad, CASE WHEN seq % 97 = 5 THEN 'mx' ELSE 'own' END AS h FROM m
  UNION ALL SELECT log_id + 303, seq, us, type, alarm_code, phase, CASE WHEN seq % 97 = 5 THEN 'MX' ELSE machine END, false, CASE WHEN seq % 97 = 5 THEN 'mx' ELSE 'own' END FROM m WHERE seq % 50 = 0
  UNION ALL SELECT log_id + 505, seq, us, type, alarm_code, phase, machine, false, 'changed' FROM m WHERE seq % 75 = 0
  UNION ALL SELECT log_id + 7, NULL, NULL, NULL, NULL, NULL, NULL, true, NULL FROM m WHERE seq % 40 = 0
  UNION ALL SELECT log_id + 9, NULL, NULL, NULL, NULL, NULL, NULL, true, NULL FROM m WHERE seq % 11 = 5
), b AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arr) AS rn, first_value(h) OVER (PARTITION BY seq ORDER BY arr) AS h0 FROM a WHERE NOT bad AND tag <> 'MX'
), c AS (
  SELECT *, max(us) OVER (PARTITION BY tag ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b WHERE rn = 1
), d AS (
  SELECT *, CASE WHEN mark IS NULL OR us >= mark THEN 'accepted' WHEN mark - us <= 300000000 THEN 'accepted_late' ELSE 'out_of_order_rejected' END AS cat FROM c
), g AS (
  SELECT arr, tag, alarm_code, phase, us, row_number() OVER (PARTITION BY tag, alarm_code ORDER BY arr) AS i FROM d WHERE type = 'ALARM' AND cat <> 'out_of_order_rejected'
), f AS (
  SELECT tag, alarm_code, 0::BIGINT AS i, NULL::BIGINT AS arr, false AS ok, 'CLEAR' AS lp, -9223372036854775807::BIGINT AS lt FROM g GROUP BY tag, alarm_code
  UNION ALL
  SELECT g.tag, g.alarm_code, g.i, g.arr, g.phase <> f.lp AND g.us >= f.lt, CASE WHEN g.phase <> f.lp AND g.us >= f.lt THEN g.phase ELSE f.lp END, CASE WHEN g.phase <> f.lp AND g.us >= f.lt THEN g.us ELSE f.lt END
  FROM f JOIN g ON g.tag = f.tag AND g.alarm_code = f.alarm_code AND g.i = f.i + 1
), z AS (
  SELECT arr AS arrival_id, 'bad_payload' AS category, NULL::BIGINT AS seq, NULL AS tag, NULL::BIGINT AS us, NULL::BIGINT AS mark FROM a WHERE bad
  UNION ALL SELECT arr, 'unknown_tag', seq, tag, NULL, NULL FROM a WHERE NOT bad AND tag = 'MX'
  UNION ALL SELECT arr, CASE WHEN h = h0 THEN 'duplicate' ELSE 'seq_conflict' END, seq, tag, NULL, NULL FROM b WHERE rn > 1
  UNION ALL SELECT d.arr, CASE WHEN f.ok = false THEN 'alarm_out_of_order_rejected' ELSE d.cat END, d.seq, d.tag, d.us, d.mark FROM d LEFT JOIN f ON d.arr = f.arr
)"""
