"""Shingle join and vector join against brute force."""

import re

import numpy as np
import pytest

from plantlens.llm import components as c
from plantlens.llm.metric_join import metric_join
from plantlens.llm.ngram_join import ngram_join, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    holders, links = {}, []
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    tried = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in tried:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    of = least(list(sets), links)
    return sorted((i, len(sets[i]), of[i]) for i in sets)


def test_shingle_join_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, ngram_join(docs).collect())) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(10**6, size=n))


def test_shingle_join_on_chains_and_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "Only four words here"), (4, "only four words HERE"), (5, "ÀB c d e f"), (6, "àb c d e f")]
    base = words(rng, 200).split()
    for k in range(40):  # a chain: each differs from the next by a word or two
        base[(7 * k) % 200] = f"new{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(200 + k, words(rng, 60)) for k in range(20)] + [(300 + k, "same text repeated " * 30) for k in range(50)]
    edge = words(rng, 104).split()  # 100 shingles: losing the last n words leaves exactly (100 - n) in common
    rows += [(400, " ".join(edge)), (401, " ".join(edge[:84])), (402, " ".join(edge[20:83]))]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    kept = one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n long string".replace("n long string", "n string")))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_shingle_join_random_mutations(spark):
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for _ in range(30):
        text = words(rng, int(rng.integers(5, 90))).split()
        for _ in range(int(rng.integers(1, 9))):
            own = list(text)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = f"m{rng.integers(5)}"
            rows.append((at, " ".join(own)))
            at += 1
    assert sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_shingle_join_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == sorted([(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)], key=lambda x: x[:2])
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_with_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, a, "x")]  # id 1 stands for all
    rows += [(None, b, "x"), (None, b, "x"), (None, b + " tail", "x")]  # no id at all: one of the three
    rows += [(9, c, "x"), (None, "head " + c, "x"), (None, "head " + c, "x")]  # near copies without id
    rows += [(7, d, "x"), (7, e, "x")]  # unlike texts of one id
    rows += [(3, "", "x"), (3, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert [r for r in got if r[0] == 1] in ([(1, a, "x")], [(1, a, "y")])
    loose = [r for r in got if r[0] is None and r[1]]
    assert len(loose) == 1 and loose[0][1] in (b, b + " tail")
    rest = sorted(str(r) for r in got if r[0] in (2, 3, 7, 9) or not r[1])
    assert rest == sorted(map(str, [(9, c, "x"), (7, d, "x"), (7, e, "x"), (3, "", "x"), (3, "", "x"), (None, None, "x")]))
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in one_of_each(docs.repartition(3)).collect())
    many = spark.createDataFrame([(5, a)] * 3000 + [(None, a)] * 3000 + [(6, a)], "doc_id long, text string")
    assert [tuple(r) for r in one_of_each(many).collect()] == [(5, a)]


def test_shingle_join_of_texts_that_a_polynomial_confuses(spark):
    tm = lambda n, o: "".join("ab"[(bin(k).count("1") + o) % 2] for k in range(n))
    rows = [(2 * k + o, " ".join(tm(n, (j + o) % 2) for j in range(12))) for k, n in enumerate((1024, 2048)) for o in (0, 1)]
    rows += [(10 + o, " ".join(f"{tm(1024, o)}{j}" for j in range(9))) for o in (0, 1)]
    assert sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_shingle_join_in_small_blocks_and_stars(spark, monkeypatch):
    from plantlens.llm import ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 4)
    monkeypatch.setattr(m, "STAR", 3)
    monkeypatch.setattr(m, "DRAWS", ())
    rng = np.random.default_rng(11)
    common, rows = words(rng, 30), []
    for k in range(60):  # all share a passage, few are alike, in sizes from 35 to 95 words
        own = words(rng, 5 + k)
        rows += [(10 * k, f"{common} {own}"), (10 * k + 1, f"{common} {own} tail")]
    rows += [(1000 + k, f"{common} same text repeated {k}") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, token string, n long")
    assert sorted(map(tuple, ngram_join(docs).collect())) == brute(rows)


@pytest.mark.parametrize("draws", [(), (1, 2)])
def test_groups_of_several_members_are_paired_and_expanded(spark, monkeypatch, draws):
    from plantlens.llm import ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "DRAWS", draws)
    paired, expand = [], m.expanded
    monkeypatch.setattr(m, "expanded", lambda pairs, *rest: paired.append(pairs.where("a.whole or b.whole").count()) or expand(pairs, *rest))
    # one prefix for all, whatever follows: the first shingles of the order are those of the head, as the tails' are frequent
    monkeypatch.setattr(m, "frequent", lambda own, k: listed)
    rng = np.random.default_rng(21)
    pool = [words(rng, 12) for _ in range(40)]
    rows = []
    for h in range(3):  # heads that differ by a word are held by groups of their own
        head = words(rng, 30).split()
        for v in range(4):
            own = list(head)
            own[29 - v] = f"v{v}"
            for k in range(9):  # members of a group: 12 words of tails that are alike, or not
                rows.append((len(rows), " ".join([*own, pool[(7 * k + v * (k % 2)) % 40], pool[k % 3]])))
    listed_rows = np.unique(np.concatenate([x >> np.uint64(4) for x in m.shingle_sets([f"{t} {u}" for t in pool for u in pool[:3]], 5)]))
    maybe = np.zeros(1 << m.LIST_BITS, dtype=bool)
    maybe[listed_rows >> np.uint64(60 - m.LIST_BITS)] = True
    listed = listed_rows, np.ones(len(listed_rows), dtype=np.uint8), np.packbits(maybe, bitorder="little")
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert sum(paired) > 0


def test_shingle_join_broadcasts_no_table_and_takes_few_statements(spark):
    """Each broadcast table takes some MB of the driver's memory, and each statement its plan."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = max(e.executionId() for e in seen())
    name = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(name)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + f" x{i // 3}") for i in range(30)], "doc_id long, text string")
    ngram_join(docs)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    own = [e.physicalPlanDescription() for e in seen() if e.executionId() > before]
    assert 10 < len(own) < 35
    assert not [p for p in own if "BroadcastExchange" in p]
    assert spark.conf.get(name) == had


def test_filter_grows_with_what_is_needed():
    from plantlens.llm import ngram_join as m

    assert m.filter_size(0) == m.filter_size(10_000) == m.FILTER_WORDS
    assert all(63 * m.filter_size(n) >= 16 * n for n in (10**6, 10**7, 3 * 10**7))
    assert m.filter_size(10**12) == m.FILTER_MOST


def test_unlike_texts_of_one_id_give_the_same_on_every_run(spark):
    rng = np.random.default_rng(12)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, words(rng, 50))]
    runs = [sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())) for n in (1, 4)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch, order):
    n, steps = 1000, []
    names = {"rising": list(range(n)), "mixed": np.random.default_rng(4).permutation(n).tolist()}[order]
    links = list(zip(names, names[1:])) + [(2000 + k, 2999) for k in range(50)] + [(5, 5), (3000, 3001), (3001, 3000)]
    real = c.saved
    monkeypatch.setattr(c, "saved", lambda df: steps.append(1) or real(df))
    got = {r.node: r.component for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = [x for x in links if x[0] != x[1]]
    assert got == least(sorted({i for x in linked for i in x}), linked)
    # tables written, two for a pointer step: the chain takes ten steps in one round, or few steps in each of a few rounds
    assert len(steps) <= 50, len(steps)


def test_links_that_come_later(spark):
    rng = np.random.default_rng(13)
    links = [tuple(map(int, rng.choice(300, size=2, replace=False))) for _ in range(260)]
    known, frame = None, lambda part: spark.createDataFrame(part, "a long, b long")
    for part in (links[:100], links[100:180], links[180:181], links[181:]):
        known = c.components(frame(part)) if known is None else c.with_links(known, frame(part))
    assert {r.node: r.component for r in known.collect()} == least(sorted({i for x in links for i in x}), links)
    assert known.count() == len({i for x in links for i in x}) and c.with_links(known, frame([])).count() == known.count()


def test_no_links(spark):
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, t=0.95):
    """One row per vector, by place; ids may be null or repeated."""
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    scaled = [np.array(rows[k][1], dtype=np.float64) / np.abs(rows[k][1]).max() for k in ok]
    x = np.stack([v / np.linalg.norm(v) for v in scaled])
    links, pairs = [0] * len(rows), []
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= t, 1))):
        pairs.append((ok[i], ok[j]))
        links[ok[i]] += 1
        links[ok[j]] += 1
    of = least(range(len(rows)), pairs)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[of[k]] = min(i, names.get(of[k], i))
    key = lambda r: (r[0] is None, *map(str, r))
    return sorted(((i, links[k], names.get(of[k]), i is not None and names[of[k]] == i) for k, (i, _) in enumerate(rows)), key=key)


def shown(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vector_join_on_all_embeddings(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute_vectors([(r.vec_id, r.embedding) for r in rows.select("vec_id", "embedding").collect()])
    assert shown(metric_join(rows)) == want


def test_vector_join_edges_and_blocks(spark, monkeypatch):
    from plantlens.llm import metric_join as m

    monkeypatch.setattr(m, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(40, size=900)] + 0.18 * rng.standard_normal((900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [1e300] * 16), (2006, [1.0] * 16), (2007, (5 * x[1]).tolist()), (2008, [1e-200] * 16)]
    rows += [(None, x[2].tolist()), (None, x[2].tolist()), (None, None), (None, rng.standard_normal(16).tolist()), (3, x[40].tolist()), (3, x[3].tolist()), (4000, [1.0, 2.0]), (4001, [2.0, 4.0])]
    same = [r for r in rows if r[1] is None or len(r[1]) != 2]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, digest string, cell long")
    got = shown(metric_join(docs))
    short = [(4000, 1, 4000, True), (4001, 1, 4000, False)]
    assert [r for r in got if r not in short] == brute_vectors(same) and all(r in got for r in short)
    assert metric_join(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def planted_vectors(rng, n, dim=64):
    """Vectors of which every tenth has near copies, just within and just out of reach."""
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for k in range(0, n - 5, 10):
        for j, cosine in enumerate((0.99, 0.951, 0.9500001, 0.949)):
            away = rng.normal(size=dim)
            away -= away @ base[k] * base[k]
            base[k + 1 + j] = cosine * base[k] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    return base


def linked_pairs(x, least=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    short, out = unit.astype(np.float32), []
    for k in range(0, len(x), 1000):
        i, j = np.nonzero(short[k : k + 1000] @ short.T >= least - 1e-4)
        i += k
        kept = (i < j) & (np.einsum("ij,ij->i", unit[i], unit[j]) >= least)
        out += zip(i[kept].tolist(), j[kept].tolist())
    return out


def test_few_pairs_of_planted_vectors_are_multiplied(spark, monkeypatch):
    from collections import Counter

    from plantlens.llm import metric_join as m

    monkeypatch.setattr(m, "BLOCK", 1024)
    kept, real = [], m.saved
    monkeypatch.setattr(m, "saved", lambda df, *a: kept.append(real(df, *a)) or kept[-1])
    x = planted_vectors(np.random.default_rng(20), 8_000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = sorted(tuple(r) for r in m.metric_join(frame).collect())
    pairs = linked_pairs(x)
    assert len(pairs) >= 3 * 800
    degree, of = Counter(i for p in pairs for i in p), least(range(len(x)), pairs)
    assert got == [(i, degree[i], of[i], of[i] == i) for i in range(len(x))]
    # the whole vectors of a pair are multiplied if the pair is found by the short ones
    close = next(k for k in kept if k.columns == ["code", "side", "short", "dim", "cell", "kind", "i", "j"])
    tried = sum(int(found.sum()) for block in blocks_of(close) for _, _, found in m.close_strips(block, 0.95))
    assert len(pairs) <= tried < 0.02 * len(x) * (len(x) - 1) / 2


def blocks_of(close):
    import pyarrow as pa

    groups = {}
    for r in close.collect():
        groups.setdefault((r.dim, r.cell, r.kind, r.i, r.j), []).append({"side": r.side, "short": bytes(r.short)})
    return [pa.Table.from_pylist(rows) for rows in groups.values()]


def test_short_vectors_never_part_what_is_close():
    from plantlens.llm import metric_join as m

    rng = np.random.default_rng(21)
    for dim in (1, 2, 5, 16, 17, 33, 64, 200):
        x = planted_vectors(rng, 60, dim) if dim > 1 else np.sign(rng.normal(size=(60, 1)))
        basis = np.linalg.qr(m.unit([v.tobytes() for v in rng.normal(size=(min(m.SPAN, 40), dim))])[: min(m.SPAN, dim)].T)[0]
        short = m.shortened(x, basis).astype(np.float64)
        assert np.allclose(np.linalg.norm(short, axis=1), 1, atol=1e-5)
        assert (short @ short.T >= x @ x.T - m.MARGIN).all()
