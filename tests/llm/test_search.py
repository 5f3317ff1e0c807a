"""Exact top-k search against its twin and brute force in integers of any size."""

import numpy as np
import pytest

from plantlens.llm import queries
from plantlens.llm import top_search as t


def brute(rows, k=5):
    vectors = []
    for i, v in rows:
        if v is not None and None not in v and np.isfinite(np.array(v, dtype=float) * 256).all():
            vectors.append((i, [int(x) for x in np.floor(np.array(v, dtype=float) * 256)]))
    out = []
    for a, (i, v) in enumerate(vectors):
        if i is not None and i % 50 == 0:
            scores = []
            for b, (j, w) in enumerate(vectors):
                if a != b and len(v) == len(w):
                    score = sum(x * y for x, y in zip(v, w))
                    scores.append((-max(-t.LARGEST, min(t.LARGEST, score)), j is None, j))
            scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scores[:k])]
    return sorted(map(str, out))


def searched(spark, rows, parts=3, k=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    return sorted(str(tuple(r)) for r in t.top_search(frame, k=k).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_search_meets_its_twin(spark, duck, compared, sf):
    compared(queries.op13_topk_search(spark, f"/root/testdata/{sf}"), duck(sf), t.TOP_SQL)


def test_search_in_many_tiles_with_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "TILE", 20)
    monkeypatch.setattr(t, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) / 4 for x in rng.integers(-2, 3, size=4)]) for i in rng.integers(0, 400, size=600)]
    rows += [(50, [1.0, 1.0, 1.0, 1.0])] * 7 + [(7, [1.0, 1.0, 1.0, 1.0])] * 3 + [(i, [0.5]) for i in (100, 3, 4)]
    assert searched(spark, rows) == brute(rows)


def test_search_with_wide_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** int(rng.integers(-2, 12))]) for i in range(300)]
    rows += [(1000 + 50 * i, [float(x) for x in rng.normal(size=3) * 1e9]) for i in range(4)]
    rows += [(2000, [1e300, -1e300, 1.0]), (2001, [1e300, 1e300, 1.0]), (2050, [2.0**52, 1.0, -(2.0**52)]), (2051, [1.0, 3.0, 1.0])]
    assert searched(spark, rows) == brute(rows)


def test_vectors_that_take_no_part(spark):
    rows = [(0, None), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, [float("inf"), 0.0]), (200, [1e308, 0.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (250, [1.0, 1.0]), (1, [1.0, 1.0]), (-50, [-1.0, 2.0]), (300, []), (301, []), (350, [1.0, 2.0, 3.0])]
    assert searched(spark, rows) == brute(rows)
    assert searched(spark, rows, k=1) == brute(rows, k=1)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, row int, raw string")
    assert t.top_search(empty).collect() == [] and t.top_search(empty).columns == ["query_id", "rank", "vec_id", "score"]
    rows = spark.createDataFrame([(0, [1.0], 5, "x", 1), (1, [2.0], 5, "x", 2)], "vec_id long, embedding array<float>, row int, raw string, part int")
    assert [tuple(r) for r in t.top_search(rows).collect()] == [(0, 1, 1, 256 * 512)]


def test_choice_of_ties():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 4, size=(200, 40)).astype(float)
    for k in (1, 3, 39, 40, 50):
        got = [list(np.flatnonzero(m)) for m in t.chosen(scores, k)]
        assert got == [sorted(sorted(range(40), key=lambda j: (-row[j], j))[:k]) for row in scores]
