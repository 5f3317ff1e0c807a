"""The stages of the corpus pipeline, each on what its predecessor kept, against brute force and row accounts."""

import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantlens.llm import mixing, toxicity
from plantlens.sources.scratch import saved
from tests.llm.test_joins import brute
from tests.llm.test_texts import TOKEN, WORD, base

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage takes and gives."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", "src0", 0), (None, "a text without id, one two three", "en", None, 32), (10**6 + 2, "again and again the same row here", "en", "src1", 33), (10**6 + 2, "again and again the same row here", "en", "src1", 33)], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.unionByName(odd.select(*(odd[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields)))
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF_DIR))
        out[name] = (docs, after)
        docs = after
    return out


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_names_and_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    first = stages["toxicity"][0].schema.names
    assert all(after.schema.names == first for name, (_, after) in stages.items() if name != "packing")


def test_toxic_documents_go_and_no_others(stages, spark):
    before, after = stages["toxicity"]
    verdicts = toxicity.toxicity(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    kept = sorted(str(r.doc_id) for r in verdicts if r.predicted == 0)
    assert 0 < len(kept) < before.count() and sorted(str(r.doc_id) for r in after.collect()) == kept
    assert set(map(str, rows(after))) <= set(map(str, rows(before)))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    texts = {}
    for r in before.collect():
        texts[r.doc_id if r.doc_id is not None else -1] = r.text
    wordless = [r for r in before.collect() if not WORD.search(r.text or "")]
    want = sorted(i for i, n, c in brute(list(texts.items())) if i == c and n) + sorted(r.doc_id for r in wordless)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in after.collect()) == sorted(want)


def test_personal_data_is_masked_and_nothing_else(stages):
    before, after = stages["personal_data"]
    assert before.count() == after.count()
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not base(r.text) and not TOKEN.search(r.text or "")
        assert (r.text is None) == (old[r.doc_id] is None)
        if r.text is not None and not re.search(r"[0-9@]", old[r.doc_id]):
            assert r.text == old[r.doc_id]


def test_the_mix_takes_what_it_planned(stages):
    before, after = stages["mixing"]
    plan = mixing.mix(before).collect()
    assert sum(len(WORD.findall(r.text)) for r in after.collect()) == sum(r.taken for r in plan)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in plan if r.taken}


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    # copies cut short by the mix have an id of their own here
    tokens = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == tokens
    own = {}
    for r in before.collect():
        own.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    held = {}
    for r in after.collect():
        crc = lambda ids: zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))  # noqa: E731, B023
        assert any(len(ids) == r.doc_tokens and r.start + r.length <= len(ids) and crc(ids) == r.ids_crc32 for ids in own[r.doc_id])
        held.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    # of each document, as often as it comes, every token lies in one piece
    for (doc_id, size), pieces in held.items():
        times = sum(len(ids) == size for ids in own[doc_id])
        covered = Counter(place for start, length in pieces for place in range(start, start + length))
        assert set(covered) == set(range(size)) and set(covered.values()) == {times}
    assert {(i, len(ids)) for i, lists in own.items() for ids in lists} == set(held)


def test_empty_tables_pass_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF_DIR))
        assert docs.count() == 0


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k} and {k * k}", "s", "x", k, "y", [k]) for k in range(12)] + [(3, None, None, None, None, None, None)], "doc_id long, text string, source string, row string, component long, key string, ids array<long>")
    names = docs.schema.names
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF_DIR))
        assert docs.schema.names == names and docs.count() > 0
    assert saved(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)).count() > 0


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF_DIR))
    held = lambda frame: sorted(tuple(r) for r in frame.select("doc_id", "doc_tokens", "ids_crc32", "start", "length").collect())
    got = corpus_pipeline.run(spark, SF_DIR)
    # a row of a repeated one stays, so the result is that of the table without them
    assert got.schema.names == docs.schema.names and Counter(r[:2] for r in held(got)).keys() == Counter(r[:2] for r in held(docs)).keys()
    assert got.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0] > 0
