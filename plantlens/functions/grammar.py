"""Grammar of a message: from payload text to typed fields or the reason of refusal (:mod:`columns` has it by columns).

The standard library's JSON and ISO parsers decide what is well-formed, as
Spark's own differ on duplicate keys, trailing text and basic ISO forms. Rules
are tables; per row a few dictionary look-ups are left.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plantlens.schema import MAX_DELTA, PARSED, PHASES, SEQ_MAX, SEQ_MIN, STATES, TYPES

FIELDS = PARSED.fieldNames()
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def whole(value) -> bool:
    return type(value) is int


def utc_microseconds(text) -> int | None:
    """Microseconds since 1970 of an ISO text with a zone; None for anything else."""
    if not isinstance(text, str):
        return None
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return None if at.tzinfo is None else (at.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
    except (ValueError, OverflowError):
        return None


def delta(name: str):
    return (lambda m: whole(m.get(name)) and 0 <= m[name] <= MAX_DELTA), f"COUNT.{name} must be an integer in [0, {MAX_DELTA}]"


# The reasons of refusal, here and in ENVELOPE and refusal.
#: Per type, tests in the order in which they refuse, each with its reason.
RULES = {
    "STATE": [
        (lambda m: isinstance(m.get("state"), str) and m["state"] in STATES, "STATE.state must be one of RUN/IDLE/DOWN"),
        (lambda m: m["state"] != "DOWN" or (isinstance(m.get("reason_code"), str) and m["reason_code"] != ""), "DOWN state requires a non-empty reason_code"),
        (lambda m: m["state"] == "DOWN" or m.get("reason_code") is None, "reason_code must be null unless state is DOWN"),
    ],
    "COUNT": [
        delta("good_delta"),
        delta("reject_delta"),
        (lambda m: m["good_delta"] or m["reject_delta"], "COUNT must have a nonzero good_delta or reject_delta"),
    ],
    "ALARM": [
        (lambda m: isinstance(m.get("alarm_code"), str) and m["alarm_code"] != "", "ALARM.alarm_code must be a non-empty string"),
        (lambda m: isinstance(m.get("phase"), str) and m["phase"] in PHASES, "ALARM.phase must be RAISE or CLEAR"),
    ],
    "HEARTBEAT": [],
}
ENVELOPE = [(name, test, text) for name, test, text in (("seq", whole, "integer"), ("tag", lambda v: isinstance(v, str), "string"), ("type", lambda v: isinstance(v, str), "string"))]


def refusal(message) -> str | None:
    """Why a decoded message is no valid one; None if it is."""
    if not isinstance(message, dict):
        return "payload is not a JSON object"
    for name, test, kind in ENVELOPE:
        if name not in message:
            return f"missing field {name}"
        if not test(message[name]):
            return f"field {name} must be {'an' if kind == 'integer' else 'a'} {kind}"
    if not SEQ_MIN <= message["seq"] <= SEQ_MAX:
        return "field seq is out of BIGINT range"
    if "ts" not in message:
        return "missing field ts"
    if utc_microseconds(message["ts"]) is None:
        return "field ts is not a valid timezone-aware ISO8601 timestamp"
    if message["type"] not in TYPES:
        return f"unknown type {message['type']!r}"
    return next((reason for test, reason in RULES[message["type"]] if not test(message)), None)


def content_hash(message: dict) -> str:
    """Hash of the whole message, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(message, sort_keys=True).encode("utf-8", "surrogatepass")).hexdigest()


def parse(raw: str | None) -> tuple:
    """The fields of PARSED for one payload."""
    try:
        message = json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return ("invalid JSON", *[None] * (len(FIELDS) - 1))
    reason = refusal(message)
    m = message if isinstance(message, dict) else {}
    text = lambda name: m[name] if isinstance(m.get(name), str) else None
    number = lambda name, least, most: m[name] if whole(m.get(name)) and least <= m[name] <= most else None
    shown = (text("tag"), text("type"), number("seq", SEQ_MIN, SEQ_MAX), text("ts"))
    if reason is not None:
        return (reason, *shown, *[None] * (len(FIELDS) - 5))
    own = {"STATE": ("state", "reason_code"), "COUNT": ("good_delta", "reject_delta"), "ALARM": ("alarm_code", "phase"), "HEARTBEAT": ()}[m["type"]]
    return (None, *shown, utc_microseconds(m["ts"]), content_hash(m), *(m.get(n) if n in own else None for n in FIELDS[7:]))


@F.pandas_udf(StringType())
def quoted(values: pd.Series) -> pd.Series:
    """A value as it is shown in reasons, in quotes."""
    return values.map(repr, na_action="ignore")


def ntz(us) -> object:
    """A zoneless UTC timestamp from microseconds, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def microseconds(ts) -> object:
    """Microseconds since 1970 of a zoneless timestamp; differences of such timestamps know no zone and no summer time."""
    span = (F.col(ts) if isinstance(ts, str) else ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda name: F.extract(F.lit(name), span)
    whole_seconds = part("DAY").cast("long") * 86_400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return whole_seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def html_escape(text) -> object:
    """The text with the five signs of HTML replaced."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text
