"""The grammar over whole columns: plain messages are read and tested by Arrow's kernels, all others one by one.

A payload is plain if it is one flat object of known fields, each at most once, with whole
numbers of up to 18 digits and printable ASCII strings without escapes. Such payloads
have one reading only, so Arrow's JSON reader and the standard library's agree
on them. They are typed together as columns. Those that pass every rule, with a UTC time in the
common form, are done; their canonical text is put together by columns, and hashed.
All other payloads, valid or not, go to :func:`plantlens.functions.grammar.parse`, so
this module decides nothing about what is refused and why.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as arrow_json
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plantlens.functions.grammar import FIELDS, parse
from plantlens.schema import MAX_DELTA, PARSED, PHASES, STATES

KIND = to_arrow_type(PARSED)
NUMBERS = ("seq", "good_delta", "reject_delta")
TEXTS = ("ts", "tag", "type", "state", "reason_code", "alarm_code", "phase")
#: A message's own fields besides the common ones.
OWN = {"STATE": ("state", "reason_code"), "COUNT": ("good_delta", "reject_delta"), "ALARM": ("alarm_code", "phase"), "HEARTBEAT": ()}
TEXT = r'"[ !#-\[\]-~]*"'
FIELD = rf'("({"|".join(NUMBERS)})" ?: ?(0|-?[1-9][0-9]{{0,17}})|"({"|".join(TEXTS)})" ?: ?{TEXT}|"reason_code" ?: ?null)'
PLAIN = rf"^\{{{FIELD}(, ?{FIELD})*\}}$"
SCHEMA = pa.schema([(n, pa.int64()) for n in NUMBERS] + [(n, pa.string()) for n in TEXTS])
UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{6})?(Z|\+00:00)$"
SECOND = "%Y-%m-%dT%H:%M:%S"


def every(*masks: pa.Array) -> pa.Array:
    """Where all hold; what is not known does not."""
    out = masks[0]
    for mask in masks[1:]:
        out = pc.and_kleene(out, mask)
    return pc.fill_null(out, False)


def plain(raw: pa.Array) -> pa.Array:
    """Payloads of the plain form; some may still have a field twice, which is rare."""
    return every(pc.match_substring_regex(raw, PLAIN))


def once(raw: pa.Array) -> pa.Array:
    """Plain payloads with no field twice; inside their texts there is no quotation mark."""
    return every(*(pc.less_equal(pc.count_substring_regex(raw, f'"{n}" ?:'), 1) for n in (*NUMBERS, *TEXTS)))


def microseconds(text: pa.Array) -> pa.Array:
    """Microseconds since 1970 of UTC times in the common form, null for others and for days that there are not."""
    fits = pc.match_substring_regex(text, UTC)
    text = pc.if_else(fits, text, None)
    whole = pc.utf8_slice_codeunits(text, 0, 19)
    at = pc.strptime(whole, format=SECOND, unit="us", error_is_null=True)
    # a day that there is not is taken for one of the next month, and then reads otherwise
    number = lambda i: pc.utf8_slice_codeunits(text, i, i + 2).cast(pa.int64())
    same = every(pc.equal(pc.day(at), number(8)), pc.equal(pc.hour(at), number(11)), pc.equal(pc.minute(at), number(14)), pc.equal(pc.second(at), number(17)))
    part = pc.utf8_slice_codeunits(text, 20, 26)
    part = pc.if_else(pc.equal(pc.utf8_slice_codeunits(text, 19, 20), "."), part, "0").cast(pa.int64())
    return pc.if_else(same, pc.add(at.cast(pa.int64()), part), None)


def valid(rows: dict[str, pa.Array]) -> pa.Array:
    """Rows that pass every rule."""
    kind, down = rows["type"], pc.equal(rows["state"], "DOWN")
    reason = rows["reason_code"]
    among = lambda name, values: pc.is_in(rows[name], value_set=pa.array(values))
    count = lambda name: every(pc.greater_equal(rows[name], 0), pc.less_equal(rows[name], MAX_DELTA))
    state = every(pc.equal(kind, "STATE"), among("state", STATES), pc.if_else(down, pc.fill_null(pc.not_equal(reason, ""), False), pc.is_null(reason)))
    ticks = every(pc.equal(kind, "COUNT"), count("good_delta"), count("reject_delta"), pc.greater(pc.add(rows["good_delta"], rows["reject_delta"]), 0))
    alarm = every(pc.equal(kind, "ALARM"), pc.not_equal(rows["alarm_code"], ""), among("phase", PHASES))
    of_kind = pc.or_(pc.or_(state, ticks), pc.or_(alarm, pc.fill_null(pc.equal(kind, "HEARTBEAT"), False)))
    return every(of_kind, pc.is_valid(rows["seq"]), pc.is_valid(rows["tag"]), pc.is_valid(rows["ts_us"]))


def canonical(rows: dict[str, pa.Array], raw: pa.Array) -> pa.Array:
    """The text of messages with their fields in order, as the standard library would write them."""
    parts = []
    for name in sorted((*NUMBERS, *TEXTS)):
        value = rows[name].cast(pa.string())
        if name in TEXTS:
            value = pc.binary_join_element_wise('"', value, '"', "")
        shown = pc.fill_null(pc.binary_join_element_wise(f', "{name}": ', value, ""), "")
        if name == "reason_code":  # the only field that may be there and null
            null = pc.and_(pc.is_null(rows[name]), pc.match_substring(raw, '"reason_code"'))
            shown = pc.if_else(null, ', "reason_code": null', shown)
        parts.append(shown)
    return pc.binary_join_element_wise("{", pc.utf8_slice_codeunits(pc.binary_join_element_wise(*parts, ""), 2), "}", "")


def read(raw: pa.Array) -> dict[str, pa.Array]:
    """Fields of plain payloads, and ts_us."""
    if not len(raw):
        return {n: pa.array([], SCHEMA.field(n).type) for n in SCHEMA.names} | {"ts_us": pa.array([], pa.int64())}
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(raw)], raw), "\n")[0].as_buffer()
    options = arrow_json.ParseOptions(explicit_schema=SCHEMA, newlines_in_values=False, unexpected_field_behavior="error")
    table = arrow_json.read_json(pa.BufferReader(text), read_options=arrow_json.ReadOptions(use_threads=False, block_size=max(1 << 20, text.size + 1)), parse_options=options)
    rows = {n: table[n].combine_chunks() for n in SCHEMA.names}
    return rows | {"ts_us": microseconds(rows["ts"])}


def parsed_rows(raw: pa.Array) -> pa.StructArray:
    """The fields of PARSED for a column of payloads."""
    at = pc.indices_nonzero(plain(raw))
    done = pa.array([], KIND)
    if len(at):
        some = raw.take(at)
        try:
            rows = read(some)
        except pa.ArrowInvalid:
            at = at.take(pc.indices_nonzero(once(some)))
            some = raw.take(at)
            rows = read(some)
        kept = pc.indices_nonzero(valid(rows))
        at, some, rows = at.take(kept), some.take(kept), {n: c.take(kept) for n, c in rows.items()}
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in canonical(rows, some).to_pylist()]
        own = {n: pc.if_else(pc.equal(rows["type"], kind), rows[n], None) for kind, names in OWN.items() for n in names}
        found = {"tag": rows["tag"], "msg_type": rows["type"], "seq": rows["seq"], "ts_raw": rows["ts"], "ts_us": rows["ts_us"], "content_hash": pa.array(digests, pa.string()), **own}
        done = pa.StructArray.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(len(at), f.type) for f in KIND], fields=list(KIND))
    is_done = pc.is_in(pa.array(range(len(raw)), pa.uint64()), value_set=at.cast(pa.uint64()))
    rest = pc.indices_nonzero(pc.invert(is_done))
    one_by_one = [dict(zip(FIELDS, parse(p), strict=True)) for p in raw.take(rest).to_pylist()]
    both = pa.concat_arrays([done, pa.array(one_by_one, KIND)])
    order = pc.sort_indices(pa.concat_arrays([at.cast(pa.uint64()), rest.cast(pa.uint64())]))
    return both.take(order)


@F.arrow_udf(PARSED)
def parsed(raw: pa.Array) -> pa.Array:
    return parsed_rows(raw)
