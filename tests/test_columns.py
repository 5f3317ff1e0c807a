"""Payloads by columns against payloads one by one."""

import json
import random

import pyarrow as pa

from plantlens.functions import columns as c
from plantlens.functions.grammar import FIELDS, parse
from tests.test_classifier import CASES, stream

ATS = ["2024-01-01T00:00:00+00:00", "2024-02-29T23:59:59.000001Z", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "2024-13-01T00:00:00Z", "2024-01-01T00:00:00.5+00:00", "2024-01-01T02:00:00+02:00", "2024-01-01", "soon", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999Z", "1969-12-31T23:59:59.999999Z", "2024-04-31T00:00:00Z", "2024-01-00T00:00:00Z"]
VALUES = [0, 1, -1, 5, 10**17, 10**18, 2**63, 2**63 - 1, -(2**63), 2147483647, 2147483648, 1.0, 1.5, True, None, "", "x", "RUN", "DOWN", "IDLE", "RAISE", "CLEAR", "é", 'a"b', "a\\b", "\n", "\x7f", "state", '":', [], {}, {"seq": 1}]


def one_by_one(raws):
    return [dict(zip(FIELDS, parse(r), strict=True)) for r in raws]


def same(raws):
    got = c.parsed_rows(pa.array(raws, pa.string())).to_pylist()
    want = one_by_one(raws)
    for raw, g, w in zip(raws, got, want, strict=True):
        assert g == w, raw


def test_cases_and_streams():
    same([raw for raw, _ in CASES])
    for seed in range(5):
        same(stream(seed, 400))
    same([])
    same([None, "", "{}"])
    twice = '{"seq": 1, "ts": "2024-01-01T00:00:00Z", "tag": "a", "type": "HEARTBEAT", "tag": "b"}'
    same([twice])
    same([twice, stream(1, 5)[0], twice.replace('"tag": "b"', '"note": 1')])


def invented(rng):
    kind = rng.choice(["STATE", "COUNT", "ALARM", "HEARTBEAT"])
    m = {"seq": rng.randrange(-5, 100), "ts": ATS[0] if rng.random() < 0.7 else rng.choice(ATS), "tag": rng.choice(["A.B", "x y", ""]), "type": kind}
    m |= {"STATE": {"state": "RUN", "reason_code": None}, "COUNT": {"good_delta": 1, "reject_delta": 0}, "ALARM": {"alarm_code": "J", "phase": "RAISE"}, "HEARTBEAT": {}}[kind]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        m[rng.choice([*m, "state", "reason_code", "good_delta", "alarm_code", "note"])] = rng.choice(VALUES)
    for name in list(m):
        if rng.random() < 0.02:
            del m[name]
    items = list(m.items())
    rng.shuffle(items)
    text = "{" + rng.choice([", ", ",", " , ", ",  "]).join(f"{json.dumps(k)}{rng.choice([': ', ':', ' : ', ' :'])}{json.dumps(v, ensure_ascii=rng.random() < 0.5)}" for k, v in items) + "}"
    spoil = rng.random()
    if spoil < 0.03:
        text = text[: rng.randrange(len(text) + 1)]
    elif spoil < 0.06:
        text = text.replace(rng.choice(list(text)), rng.choice(["", "-0", "01", "\n", " ", "\t", "NaN", '"']), 1)
    elif spoil < 0.09:
        text = text[:-1] + ', "seq": 7, "tag": "again"}'
    elif spoil < 0.11:
        text = rng.choice([" ", "\n", "﻿", ""]) + text + rng.choice([" ", "\n", "x", ""])
    return text


def test_invented_payloads():
    rng = random.Random(12)
    raws = [invented(rng) for _ in range(12_000)]
    same(raws)
    taken = sum(c.plain(pa.array(raws)).to_pylist())
    assert 2_500 < taken < 11_500
    for _ in range(300):  # small columns, so that one odd payload meets few others
        same([invented(rng) for _ in range(rng.randrange(1, 4))])


def test_most_messages_of_a_stream_are_plain():
    raws = [r for r in stream(1, 400) if parse(r)[0] is None]
    assert all(c.plain(pa.array(raws)).to_pylist())
