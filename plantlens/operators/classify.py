"""Classification of messages: eight categories as joins, windows and an automaton.

* Arrivals have a total order: by arrival_id, file and line. A line delivered
  again, under the same arrival_id too, is a row of its own in every step.
* A seq is decided by its first well-formed message of a known tag, whatever
  became of that one; later ones are duplicates or, with other content, conflicts.
* A tag's watermark is the largest timestamp so far. A row older than it is
  late within the grace period and rejected beyond it. No row is dropped.
* Alarms of a (tag, code) must alternate, beginning with RAISE, and not go back
  in time; see :mod:`automaton`.

The watermark is a running maximum in two levels (stretches of arrivals, then
rows of a stretch), and so is the automaton, so that a busy key still spreads
over all tasks. All steps work on narrow rows; payloads are joined at the end.

``carry`` holds what earlier batches have decided; see :func:`carry_of`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import parsed
from plantlens.functions.grammar import microseconds, ntz, quoted
from plantlens.operators.automaton import alarm_verdicts
from plantlens.operators.lines import running_max
from plantlens.operators.skew import joined
from plantlens.schema import LEDGER, SEEN_CATEGORIES, Policy
from plantlens.sources.scratch import saved

MICRO = 1_000_000
#: The order of arrivals: a line delivered again has the arrival_id of the first, but a place of its own.
ORDER = ["arrival_id", "file", "block", "line"]


@dataclass
class Carry:
    """seen(seq, hash), marks(tag, mark_us) and alarms(tag, alarm_code, phase, ts_us) from earlier batches."""

    seen: DataFrame
    marks: DataFrame
    alarms: DataFrame


def carry_of(ledger: DataFrame) -> Carry:
    """What a ledger says about seqs, watermarks and alarms; aggregates only."""
    seen = ledger.where(F.col("category").isin(*SEEN_CATEGORIES))
    alarms = ledger.where((F.col("msg_type") == "ALARM") & F.col("category").isin("accepted", "accepted_late"))
    return Carry(
        seen.select("seq", F.col("content_hash").alias("seen_hash")),
        seen.groupBy("tag").agg(microseconds(F.max("ts")).alias("mark_us")),
        alarms.groupBy("tag", "alarm_code").agg(F.max_by(F.struct("phase", "ts"), F.struct("ts", *ORDER)).alias("last")).select("tag", "alarm_code", "last.phase", microseconds(F.col("last.ts")).alias("ts_us")),
    )


def iso(us) -> object:
    """UTC ISO text of microseconds, with a fraction only where there is one."""
    whole = F.replace(F.substring(ntz(us).cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    return F.concat(whole, F.when(us % MICRO != 0, F.concat(F.lit("."), F.lpad((F.pmod(us, F.lit(MICRO))).cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def by_registry(rows: DataFrame, column: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose name is in the registry, and all others; the registry is a short list of settings."""
    known = F.coalesce(F.col(column).isin(*names), F.lit(False))
    return rows.where(known), rows.where(~known)


def firsts(rows: DataFrame, seen: DataFrame | None, own: Sequence[str] = ()) -> DataFrame:
    """The first row of each seq, saved: seq, ORDER, content_hash and its ``own`` columns, the seq's number of rows as n, and seen_hash if it was ``seen`` (seq, seen_hash) before.

    A seq that is delivered again and again is summed up before anything is shuffled.
    """
    # a row's line is its own, so nothing behind ORDER decides
    found = rows.groupBy("seq").agg(F.min(F.struct(*ORDER, "content_hash", *own)).alias("first"), F.count("*").alias("n")).select("seq", "first.*", "n")
    return saved(found.withColumn("seen_hash", F.lit(None).cast("string")) if seen is None else found.join(seen, "seq", "left"))


def deciding(found: DataFrame) -> DataFrame:
    """What rows of a seq are held against, from ``firsts``: seq, first_line, null if the seq was seen before, first_hash and n."""
    return found.select("seq", F.when(F.col("seen_hash").isNull(), F.col("line")).alias("first_line"), F.coalesce("seen_hash", "content_hash").alias("first_hash"), "n")


def with_first(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds is_first and first_hash: the first row of each seq decides it, unless it was ``seen`` (seq, seen_hash) before. Rows of a frequent seq are not brought together."""
    rows = joined(rows, deciding(firsts(rows, seen)), ["seq"], "n")
    return rows.withColumn("is_first", F.coalesce(F.col("line") == F.col("first_line"), F.lit(False))).drop("first_line")


def decided(rows: DataFrame, policy: Policy, carry: Carry | None = None) -> DataFrame:
    """What becomes of parsed rows of known tags, without their payloads: line, is_first, mark_us, category, alarm_ok, last_phase and last_us."""
    found = firsts(rows, None if carry is None else carry.seen, ["tag", "msg_type", "ts_us", "alarm_code", "phase"])
    # only rows of seqs that came more than once or before are read again
    again = deciding(found.where((F.col("n") > 1) | F.col("seen_hash").isNotNull()))
    repeats = joined(rows.select("seq", "line", "content_hash"), again, ["seq"], "n").where(~F.col("line").eqNullSafe(F.col("first_line")))
    repeats = repeats.select("line", F.lit(False).alias("is_first"), F.when(F.col("content_hash") == F.col("first_hash"), "duplicate").otherwise("seq_conflict").alias("category"))
    fresh = found.where("seen_hash is null").select(*ORDER, F.lit(True).alias("is_first"), "tag", "msg_type", "ts_us", "alarm_code", "phase")
    fresh = running_max(fresh, "tag", ORDER[0], "ts_us", "mark_us", policy.stretch, ORDER[1:])
    if carry is not None:
        fresh = fresh.join(F.broadcast(carry.marks.withColumnRenamed("mark_us", "_carried")), "tag", "left").withColumn("mark_us", F.greatest("mark_us", "_carried")).drop("_carried")
    delay = F.col("mark_us") - F.col("ts_us")
    fresh = fresh.withColumn("category", F.when(F.col("mark_us").isNull() | (delay <= 0), "accepted").when(delay <= policy.grace_s * MICRO, "accepted_late").otherwise("out_of_order_rejected"))
    # three ways lead from here, so what has been found is written
    fresh = saved(fresh.select(*ORDER, "is_first", "tag", "msg_type", "ts_us", "alarm_code", "phase", "mark_us", "category"))
    is_alarm = (F.col("msg_type") == "ALARM") & (F.col("category") != "out_of_order_rejected")
    verdicts = alarm_verdicts(fresh.where(is_alarm), None if carry is None else carry.alarms, ORDER, policy.stretch)
    out = ["line", "is_first", "mark_us", "category"]
    alarms = fresh.where(is_alarm).select(*out).join(verdicts, "line")
    alarms = alarms.withColumn("category", F.when(~F.col("alarm_ok"), "alarm_out_of_order_rejected").otherwise(F.col("category")))
    return fresh.where(~is_alarm).select(*out).unionByName(repeats, allowMissingColumns=True).unionByName(alarms, allowMissingColumns=True)


# Texts logged with the categories.
REASONS = {
    "seq": "seq {seq} already ingested",
    "conflict": "seq {seq} already ingested with different content (content hash mismatch)",
    "late": "ts is {late}s older than latest accepted ({grace}s grace window exceeded)",
    "phase": "alarm {tag}/{alarm_code} phase {phase} out of order (last accepted phase was {last}, expected '{expected}')",
    "back": "alarm {tag}/{alarm_code} ts {ts} precedes the last accepted event's ts {last_ts} for this (machine, alarm_code) - cannot be paired by timestamp",
    "unknown_tag": "tag {tag} not in known machine registry",
}


def told(name: str, **values) -> object:
    """A text of REASONS with columns in its places."""
    parts = re.split(r"\{(\w+)\}", REASONS[name])
    return F.concat(*(F.lit(p) if k % 2 == 0 else (values[p] if p in values else F.col(p)).cast("string") for k, p in enumerate(parts)))


def reason_of(policy: Policy) -> object:
    """The text logged with each category."""
    late = F.format_string("%.1f", (F.col("mark_us") - F.col("ts_us")) / MICRO)
    expected = F.when(F.col("last_phase") == "RAISE", "CLEAR").otherwise("RAISE")
    last = F.coalesce(F.concat(F.lit("'"), F.col("last_phase"), F.lit("'")), F.lit("None"))
    alarm = F.when(F.col("phase") != expected, told("phase", last=last, expected=expected)).otherwise(told("back", ts=iso(F.col("ts_us")), last_ts=iso(F.col("last_us"))))
    return (
        F.when(F.col("category") == "duplicate", told("seq"))
        .when(F.col("category") == "seq_conflict", told("conflict"))
        .when(F.col("category") == "out_of_order_rejected", told("late", late=late, grace=F.lit(str(float(policy.grace_s)))))
        .when(F.col("category") == "alarm_out_of_order_rejected", alarm)
    )


def placed(messages: DataFrame) -> DataFrame:
    """Messages with what orders those of one arrival_id: file and block, where there are any, and line, which is a row's own and rises along a file."""
    kept = {name: F.col(name) if name in messages.columns else F.lit(none) for name, none in (("file", ""), ("block", 0))}
    return messages.select("arrival_id", "raw_payload", kept["file"].cast("string").alias("file"), kept["block"].cast("long").alias("block"), F.monotonically_increasing_id().alias("line"))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Messages (arrival_id, raw_payload, maybe file and block) with their fields or the reason of refusal, written once for the branches that follow.

    Those of a batch may lie side by side in a few files, so they are spread over all tasks first.
    """
    return saved(placed(messages).repartition("line").withColumn("p", parsed("raw_payload")).select("arrival_id", "raw_payload", "file", "block", "line", "p.*"))


def classify(messages: DataFrame, policy: Policy = Policy(), carry: Carry | None = None, ready: bool = False) -> DataFrame:
    """The ledger rows of messages (as for parsed_messages; ``ready``: as that gives them): one row for each, in exactly one category."""
    rows = messages if ready else parsed_messages(messages)
    bad = rows.where("reason is not null").withColumn("category", F.lit("bad_payload"))
    good = rows.where("reason is null").drop("reason")
    registered, strange = by_registry(good, "tag", policy.tags)
    strange = strange.withColumns({"category": F.lit("unknown_tag"), "reason": told("unknown_tag", tag=quoted("tag")), "content_hash": F.lit(None).cast("string")})
    # payloads meet what was decided by the row's own number, and are moved only here
    known = registered.join(decided(registered, policy, carry), "line").withColumn("reason", reason_of(policy))
    every = known.unionByName(bad, allowMissingColumns=True).unionByName(strange, allowMissingColumns=True)
    fact = F.col("category").isin("accepted", "accepted_late")
    gap = (F.col("category") == "accepted") & (F.col("ts_us") - F.col("mark_us") > policy.gap_s * MICRO)
    out = every.withColumns(
        {
            "received_at": F.current_timestamp(),
            "ts": F.when(F.col("category").isin(*SEEN_CATEGORIES), ntz(F.col("ts_us"))),
            "is_late": F.when(fact, F.col("category") == "accepted_late"),
            "gap_start": F.when(gap, ntz(F.col("mark_us"))),
            "gap_seconds": F.when(gap, (F.col("ts_us") - F.col("mark_us")) / MICRO),
        }
    )
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER))
