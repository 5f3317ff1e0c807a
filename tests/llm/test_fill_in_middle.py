"""Fill-in-the-middle texts against their twin, plain slicing and the text itself."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plantlens.llm import fill_in_middle as f
from plantlens.llm import queries
from plantlens.llm.elias_fano import BLOCK, Boundaries

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}" if form == "spm" else f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"
    return doc_id, n, form, i, j - i, out, text


def cut(spark, rows, parts=4):
    made = f.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    rows = made.withColumn("restored", f.restored(F.col("form"), F.col("output"))).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_meet_their_twin(spark, duck, compared, sf):
    compared(queries.op11_fill_in_middle(spark, f"/root/testdata/{sf}"), duck(sf), f.FIM_SQL)


def test_cuts_by_plain_slicing(spark):
    rng = random.Random(8)
    letters = "abc <>PSM\n\té日本𝄞́\x00"
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 7, 300])))) for i in range(-50, 700)]
    rows += [(1000, "x<P>y"), (1001, "<S>"), (1002, "<<M>"), (1003, "<"), (1004, "<P"), (None, "no id"), (None, "no id"), (5, None), (6, ""), (2**62, "far")]
    rows += [(k, "the same text for all ünd sundry") for k in range(2000, 2400)] + [(7, "one row, many times")] * 300
    got = cut(spark, rows)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_hot_texts_are_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(f, "HOT", 5)
    rows = [(k, ["first", "sécond", "third"][k % 3]) for k in range(200)] + [(k, f"own {k}") for k in range(200, 300)]
    assert cut(spark, rows) == sorted((plain(*r) for r in rows), key=str)


def test_index_holds_each_text_once(spark):
    rows = [(k, ["a", "b", "a", None, ""][k % 5]) for k in range(50)]
    index = f.text_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.n, r.n_docs) for r in index.collect()) == [(0, 20), (1, 10), (1, 20)]


def test_texts_of_one_name_stay_apart(spark):
    """A document meets only the list of a text with its own digest, second hash and length."""
    named = f.named(spark.createDataFrame([(1, "aé"), (2, "bb"), (3, "aé")], "doc_id long, text string")).collect()
    assert named[0].digest == named[2].digest and named[0].n_bytes == 3 and len({bytes(r.digest) for r in named}) == 2


def test_long_text(spark):
    rows = [(3, "ab é 日" * 400_000), (4, "x" * 1_000_000)]
    assert cut(spark, rows) == sorted((plain(*r) for r in rows), key=str)


def test_boundaries_select_every_code_point():
    rng = random.Random(9)
    for letters, k in (("a", BLOCK * 20), ("日", 5000), ("𝄞", 5000), ("aé日𝄞", 20_000), ("a", 0), ("é", 1)):
        text = "".join(rng.choices(letters, k=k))
        bounds, at = Boundaries.of(text.encode()), 0
        for i, c in enumerate(text):
            if k < 10 or i % 37 == 0 or i in (k - 1, k - 2):
                assert bounds.select(i) == at
            at += len(c.encode())
        assert bounds.n == k and bounds.select(k) == at
        assert len(bounds.high) + len(bounds.low) + len(bounds.ones) <= 4 + len(text.encode()) * 0.5 + k * 0.3 + 8


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digest int, copy int")
    assert f.digests(empty).collect() == [] and f.digests(empty).columns == COLUMNS
    rows = spark.createDataFrame([(1, "one text", 2, 3, 4)], "doc_id long, text string, digest int, n int, place int")
    want = plain(1, "one text")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [tuple(r) for r in f.digests(rows).collect()] == [(*want[:5], sha(want[5]), sha(want[6]))]
