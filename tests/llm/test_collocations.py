"""Collocations against their twin and a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from plantlens.llm import collocations as c
from plantlens.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, max_n=5, least=3, share=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, max_n + 1):
                counts.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    common = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, a in common.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                inner = (p[0], *p[i:j])
                if len(inner) < len(p) and 100 * a >= share * counts[inner]:
                    dropped.add(inner)
    out = {}
    for p, a in common.items():
        if p not in dropped:
            cuts = [(1000 * a * totals[p[0]] // (counts[p[:k]] * counts[(p[0], *p[k:])]), k, counts[p[:k]], counts[(p[0], *p[k:])]) for k in range(2, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def mined(spark, rows, parts=5, **how):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(map(tuple, c.collocations(frame, **({"least": 3} | how)).select(COLUMNS).collect()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_collocations_meet_their_twin(spark, duck, compared, sf):
    compared(queries.op12_collocations(spark, f"/root/testdata/{sf}"), duck(sf), c.COLLOCATION_SQL)


def invented(rng, n=400):
    words = np.array(["the", "of", "Oak", "élan", "a", "b'c", "x-1", "ZÄ", "lo", " ", "\x1cq", "日本"])
    marks = np.array([" ", "  ", "\t", ". ", ",", "\n", " \r\n", "!?", "\x0b", "\x0c"])
    shares = [0.6, 0.1, 0.05, *[0.25 / 7] * 7]
    picked = lambda k: "".join(w + m for w, m in zip(words[np.minimum(rng.geometric(0.3, k) - 1, 11)], rng.choice(marks, k, p=shares)))
    return [(str(rng.choice(["en", "de"])) if rng.random() > 0.1 else None, picked(int(rng.integers(0, 40)))) for _ in range(n)]


def test_collocations_by_plain_counting(spark, monkeypatch):
    rows = invented(np.random.default_rng(4)) + [("und", "the of the of"), (None, None), ("en", ""), ("en", " \n"), ("fr", "once only")] * 2
    want = brute(rows)
    assert len(want) > 200 and mined(spark, rows) == want
    assert mined(spark, rows, share=70, top=7) == brute(rows, share=70, top=7)
    assert mined(spark, rows, max_n=2) == brute(rows, max_n=2)
    assert mined(spark, rows, max_n=6, least=2) == brute(rows, max_n=6, least=2)
    # small portions, many rounds of the stack
    for name, value in (("PORTION", 50), ("COUNTED", 20), ("COMBINED", 30), ("STACKED", 16)):
        monkeypatch.setattr(c, name, value)
    assert mined(spark, rows) == want


@pytest.mark.parametrize("listed", [0, 1, 5, 12])
def test_words_beyond_the_list_are_counted_as_texts(spark, listed):
    rows = invented(np.random.default_rng(5), 150)
    assert mined(spark, rows, most_listed=listed) == brute(rows)


def test_stack_over_borders_equals_one_pass():
    rng = np.random.default_rng(6)
    ids = rng.integers(-1, 4, size=3000)
    k1, k2 = c.suffixes_of(ids, 5)
    batch = c.combined([(k1, k2)])
    k1, k2, n = (x.to_numpy()[::-1] for x in batch.columns)

    def sums(cuts, least):
        out = Counter()
        for low, high in zip([0, *cuts], [*cuts, len(n)]):
            stack, some = c.Stack(5, least), np.arange(low, high)
            for part in np.array_split(some, 3):
                if len(part):
                    for a, b, m in stack.push(k1[part], k2[part], n[part]):
                        out[a, b] += m
            for a, b, m in stack.end():
                out[a, b] += m
        return {p: m for p, m in out.items() if m >= least}

    whole = sums([], 1)
    assert whole and all(sums(sorted(rng.integers(1, len(n), size=5).tolist()), least) == {p: m for p, m in whole.items() if m >= least} for least in (1, 5, 40))


def test_a_hot_phrase_a_long_text_and_repeated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [("en", "hot pair " * 3000), ("en", " ".join(f"w{x}" for x in rng.integers(50, size=60_000)))] + [("en", "hot pair of words, said again")] * 500
    assert mined(spark, rows, least=100) == brute(rows, least=100)


def test_large_counts_do_not_overflow(spark):
    phrases = spark.createDataFrame([("en", "x y", 10**13), ("en", "x y z", 10**12)], "lang string, phrase string, a long")
    parts = phrases.union(spark.createDataFrame([("en", "x", 10**14), ("en", "y", 9 * 10**13), ("en", "z", 8 * 10**13), ("en", "y z", 7 * 10**12)], phrases.schema))
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    got = {r.phrase: (r.l, r.r, r.score) for r in c.scored(phrases, parts, totals).collect()}
    assert got == {"x y": (10**14, 9 * 10**13, 1000 * 10**28 // (9 * 10**27)), "x y z": (10**13, 8 * 10**13, 1000 * 10**27 // (8 * 10**26))}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "lang string, text string, phrase int, a int")
    assert c.collocations(empty).collect() == [] and c.collocations(empty).columns == COLUMNS
    rows = spark.createDataFrame([("en", "one two", 1, 2, 3)] * 3, "lang string, text string, phrase int, a int, k1 int")
    assert [tuple(r) for r in c.collocations(rows, least=3).collect()] == [("en", 1, "one two", 3, 3, 3, 6, 2000)]
