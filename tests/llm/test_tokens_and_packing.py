"""Token counts and packing against the tokenizers library, on all of sf0.001 and on odd texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantlens.llm import packing, words_bpe
from plantlens.llm.packing import hilbert, pack
from plantlens.llm.queries import VOCAB
from plantlens.llm.token_counts import token_counts
from plantlens.llm.word_hash import word_hashes
from plantlens.llm.words_bpe import encode

ODD = [
    None,
    "",
    " ",
    "\n\n\t",
    "a",
    "Hello, World! don't we'll THEY'RE it's 12345",
    "<|endoftext|>",
    "x<|startoftext|>y <|endoftext|> z <|nothing|>",
    "Straße ÀÉÎ é ΑΣ ΣΑΣ İstanbul",
    "日本語 テキスト 한국어 😀😀 👩‍👩‍👧",
    "a b c​d \u0000 ﻿",
    "www....----===== $$$ %%% &lt;&gt;",
    "x" * 50_000,
    "word " * 20_000,
    "\x0b\x0c a\rb\u0085c",
    "Ꟛ Ƛ Ɤ Ƛ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_counts_of_odd_texts(spark, library):
    got = sorted(tuple(r) for r in token_counts(odd(spark), VOCAB).collect())
    texts = [(i, t) for i, t in enumerate(ODD)] + [(4, "a")]
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts)
    assert got == want


def test_counts_of_all_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, VOCAB).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert got == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert token_counts(empty, VOCAB).count() == 0
    assert pack(empty, VOCAB).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    order = np.argsort(hilbert(points, 4))
    assert len(set(hilbert(points, 4).tolist())) == 16**3
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def packed_is_whole(library, rows, texts, length=2048):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for doc, spans in by_doc.items():
        assert sum(n for _, n in spans) % len(ids[doc]) == 0
    ends = []
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
        ends.append(at)
    assert sum(e < length for e in ends) <= 1


def test_packing_is_whole(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed_is_whole(library, pack(docs, VOCAB).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    packed_is_whole(library, pack(odd(spark), VOCAB).collect(), list(enumerate(ODD)))


def test_packing_in_many_cells(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pack(docs, VOCAB, cell_tokens=5_000)
    rows = found.collect()
    assert found.rdd.getNumPartitions() > 10
    packed_is_whole(library, rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    again = pack(docs, VOCAB, cell_tokens=5_000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_in_few_large_cells(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = pack(docs, VOCAB, cell_tokens=5_000).collect()
    monkeypatch.setattr(packing, "MOST_CELLS", 3)
    few = pack(docs, VOCAB, cell_tokens=5_000)
    assert few.rdd.getNumPartitions() <= 3
    # where cells begin changes no piece
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many))


def test_cells_are_cut_by_tokens(spark):
    # a third of all rows are short texts of one place, and one text is longer than a cell
    rows = [(0, 1)] * 3_000 + [(k, 100 + k % 50) for k in range(1, 6_000)] + [(4_000, 90_000)]
    ready = spark.createDataFrame(rows, "at long, n long").repartition(7)
    bounds = packing.cell_bounds(ready, 20)
    assert 10 <= len(bounds) < 20 and (np.diff(bounds) > 0).all() and bounds[0] > 0
    weights = np.zeros(len(bounds) + 1)
    for at, n in rows:
        weights[np.searchsorted(bounds, at, side="right")] += -(-n // packing.WEIGHT)
    assert weights[1:].max() < 4 * sum(-(-n // packing.WEIGHT) for _, n in rows) / 20


def test_packing_without_ids_and_with_other_columns(spark):
    rows = [(None, f"text number {k} " * (k % 9), "x", k) for k in range(300)] + [(None, None, "y", 1), (7, "", "z", 2), (7, "", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, n long")
    got = pack(docs, VOCAB, cell_tokens=500).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    spans = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in pack(docs.repartition(3), VOCAB, cell_tokens=500).collect())


def thue_morse(n, other=0):
    return "".join("ab"[(bin(k).count("1") + other) % 2] for k in range(n))


LONG = [" ".join(thue_morse(n, o) for o in (0, 1)) for n in (512, 1024, 2048, 4096)] + ["acgt" * 20_000 + "x", "".join(chr(97 + (k * k * 7919 + k) % 26) for k in range(300_000))]
NEW = ["".join(map(chr, range(0x10940, 0x1095A))) + "abc", "a\u0558b \U0003d000 \U00011de0\U00011de1 \u1c89x"]


def test_long_words_and_newer_letters(library):
    for text in LONG + NEW:
        assert encode([text], VOCAB)[0].tolist() == library.encode(text, add_special_tokens=False).ids
    hashes, _, _ = word_hashes(" ".join(LONG[:4]).encode())
    assert len(set(hashes.tolist())) == 8


def test_words_of_one_hash_are_told_apart(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    few = lambda raw: (word_hashes(raw)[0] % np.uint64(40), *word_hashes(raw)[1:])
    for name, value in (("word_hashes", few), ("REMEMBERED", 500)):
        words_bpe.remembered.cache_clear()
        with monkeypatch.context() as m:
            m.setattr(words_bpe, name, value)
            got = [ids.tolist() for k in range(0, len(texts), 20) for ids in encode(texts[k : k + 20], VOCAB)]
        assert got == want
    words_bpe.remembered.cache_clear()


def test_vocabularies_whose_symbols_are_not_in_order_of_rank(monkeypatch):
    own = words_bpe.vocab(VOCAB)
    assert own.ordered
    words = [b"banana", b"hahahaha", b"aaaaaaa", b"x" * 900, b"abcab" * 200]
    flat, sizes = np.frombuffer(b"".join(words), dtype=np.uint8), np.array(list(map(len, words)))
    together = own.merged(flat, sizes)
    monkeypatch.setattr(own, "ordered", False)
    one_by_one = own.merged(flat, sizes)
    assert all((a == b).all() for a, b in zip(together, one_by_one))
