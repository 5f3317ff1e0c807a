"""Personal data, quality, mixing, archives and toxicity against brute force, oracles and held-out labels."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest

from plantlens.llm import mixing, pii, quality_classifier, quality_rules, queries, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    None, "", "a@b.c", "x@@y.com z@w", "a.b@c.d@e.f", "é@x.org 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567 +12 +49..30--1234567 call 555-123-4567", "name (at) host (dot) org", "1" * 5000, "+1" * 2000, "a@" * 3000 + "b.c", "tel 4111111111111111111111", "0 " * 4000, "😀 a@b.co 😀 10.0.0.1",
]


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def documents(spark, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def odd(spark, texts=ODD):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("of", ["all", "odd"])
def test_base_spans(spark, of):
    docs = documents(spark) if of == "all" else odd(spark)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.pii(docs).collect():
        own = base(texts[r.doc_id])
        spelled = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in own) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))


def test_added_phones_keep_their_opening_bracket():
    text = "call (555) 123-4567"
    found = pii.candidates(text)
    assert [c[:4] for c in found] == [(5, 19, 3, False)]
    # the gazetteer's vote comes third
    assert found[0][4][3] == "y"
    assert pii.redacted(text, lambda places: True) == "call [PHONE]" and pii.redacted(text, lambda places: False) == text
    assert [c[:3] for c in pii.candidates("(555) 123-4567")] == [(0, 14, 3)]
    assert [c[:3] for c in pii.candidates("fax ((555) 123-4567 or (+1 555 123-4567)")] == [(5, 19, 3), (24, 39, 3)]


def test_masking_keeps_rows_and_leaves_no_base_span(spark):
    docs = odd(spark).selectExpr("doc_id", "text", "cast(length(text) as int) as n_chars", "'x' as label")
    out = pii.redacted_documents(docs)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.text is None) == (ODD[r.doc_id] is None)
        assert r.text is None or r.n_chars == len(r.text)
        assert not base(r.text)


TOKEN = re.compile(r'token = "([0-9a-f]{40})"')


def test_secrets_are_found_and_masked(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {i: [m.span(1) for m in TOKEN.finditer(t)] for i, t in texts.items() if TOKEN.search(t)}
    got = {r.doc_id: r for r in pii.pii(docs).collect()}
    assert len(planted) > 5
    for i, spans in planted.items():
        assert {f"secret:{a}:{b}" for a, b in spans} <= set(got[i].spans.split(",")) and got[i].n_secret >= len(spans)
    masked = {r.doc_id: r.text or "" for r in pii.redacted_documents(docs).collect()}
    assert not any(TOKEN.search(t) for t in masked.values())
    # documents without any span are left alone
    assert all(masked[i] == t for i, t in texts.items() if not got[i].spans)


PLANTED = {
    "email": ["write to {}", "Kontakt: {}", "correo {}", "courriel : {}", "mail {}"],
    "phone": ["call {}", "Anruf unter {}", "tel. {}", "llame al {}", "appelez {}"],
    "card": ["card {}", "Kreditkarte {}", "tarjeta {}", "carte {}", "visa {}"],
    "secret": ['token = "{}"', "passwort: {}", "clave={}", 'mot de passe = "{}"', "api_key: {}"],
}
DECOYS = ["order {}", "ISBN {}", "Rechnung {}", "pedido {}", "commande {}", "commit {}", "version {}", "chapitre {}"]


def planted_corpus(n=1200, seed=6):
    """Texts with spans that no base rule finds, and with decoys: (text, {(kind, start, end)})."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(10, size=k)))
    filler = lambda: " ".join(pick(["lorem", "und", "de", "la", "the", "of", "dans", "mit", "con", "words"]) for _ in range(12))

    def checked(number):
        return next(number[:-1] + str(d) for d in range(10) if pii.luhn(number[:-1] + str(d)))

    def value(kind, true):
        if kind == "email":
            return f"{pick(['ann', 'bob', 'eva'])}{digits(2)} (at) {pick(['host', 'mail'])}{digits(1)} (dot) {pick(['com', 'de', 'fr'])}"
        if kind == "phone":
            return f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{digits(4)}"
        if kind == "card":
            return "-".join(re.findall("....", "9" + digits(15)))
        return "".join(pick("abcdef0123456789") for _ in range(40)) if true else "-".join("".join(pick("abcdef0123456789") for _ in range(k)) for k in (8, 4, 4, 4, 12))

    out = []
    for k in range(n):
        text, spans = filler() + " ", set()
        if k % 3 < 2:
            kind = ["email", "phone", "secret"][k // 3 % 3]
            true = k % 3 == 0 or kind == "email"
            before, after = pick(PLANTED[kind] if true else DECOYS).split("{}")
            span = value(kind, true) if true or kind == "secret" else value("card", False)
            text += before
            if true:
                spans.add((kind, len(text), len(text) + len(span)))
            text += span + after + " "
        # base spans teach what kinds look like
        text += filler() + pick([f" +1 ({digits(3)}) 555-{digits(4)} ", f" x{digits(2)}@mail{digits(1)}.example.com ", f" card {checked('4' + digits(15))} ", " "]) + filler()
        out.append((text, spans))
    return out


def test_added_spans_on_planted_texts(spark):
    """Recall and precision of the added spans; the figures are in the README."""
    corpus = planted_corpus()
    rows = pii.pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], "doc_id long, text string")).collect()
    hits = wanted = added = 0
    for r in rows:
        text, spans = corpus[r.doc_id]
        got = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} - {(kind, a, b) for a, _, b, kind in base(text)}
        hits, wanted, added = hits + len(got & spans), wanted + len(spans), added + len(got)
    print("recall", hits / wanted, "precision", hits / added)
    assert hits / wanted > 0.95 and hits / added > 0.95


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(9)
    truth = rng.random(20_000) < 0.35
    right = np.array([0.95, 0.8, 0.7, 0.9, 0.85, 0.75])
    counts = {}
    for t in truth:
        vote = ["-" if rng.random() < 0.1 else "yn"[int((rng.random() < q) != t)] for q in right]
        name = "3" + "".join(vote)
        counts[name] = counts.get(name, 0) + 1
    table, sure = pii.reliabilities(counts)
    for j, q in enumerate(right):
        for c, vote in ((1, 0), (0, 1)):
            own = table[3, c, j]
            assert own[vote] / (own[0] + own[1]) == pytest.approx(q, abs=0.03)
    assert sum(counts[n] * p for n, p in sure.items()) / len(truth) == pytest.approx(0.35, abs=0.02)
    assert pii.reliabilities({})[1] == {}


def test_personal_data_in_odd_tables(spark):
    rows = [(1, "a@b.co", "x", True), (1, "a@b.co", "x", True), (None, "ip 10.0.0.1", None, None), (2, None, "y", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string, base boolean")
    got = pii.pii(docs).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, "ip:3:11"), (1, "email:0:6"), (1, "email:0:6"), (2, "")]
    masked = pii.redacted_documents(docs)
    assert masked.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text or "", r.places or "") for r in masked.collect()) == [(0, "ip [IP]", ""), (1, "[EMAIL]", "x"), (1, "[EMAIL]", "x"), (2, "", "y")]
    assert pii.pii(docs.limit(0)).count() == 0 and pii.redacted_documents(docs.limit(0)).count() == 0


def test_looser_emails_of_any_length():
    name, host = "n" * 300, "h" * 200
    text = f"mail {name} (at) {host} [dot] org, x(at)y, [at] (at) z.de a [at] b.fr" + " (at)" * 3000
    found = [text[a:b] for a, b in pii.loose_emails(text)]
    assert found == [f"{name} (at) {host} [dot] org", "a [at] b.fr"]


def test_rules_counts(spark):
    texts = [None, "", " \n", "w " * 60, "a b c a b c a b c", "one\ntwo\none\n\n \none ", "x # y * <z>", "é à\n" * 30] + [r.text for r in documents(spark).limit(300).collect()]
    rows = quality_rules.quality_rules(odd(spark, texts), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {i + j for i, x in enumerate(windows) if x in again for j in range(3)}
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_trees_are_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) - x[:, 1]) > 0.1).astype(float)
    trees = quality_rules.grow(x, y, [1, -1, 0])
    grid = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 40)
        assert (sign * np.diff(trees.score(g.reshape(-1, 3)).reshape(50, 40), axis=1) >= -1e-12).all()
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.9


def test_flattened_trees_against_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    trees = quality_rules.grow(x, y, [0, 1, 0, -1], trees=25)

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    assert trees.score(x) == pytest.approx([sum(walk(int(r), row) for r in trees.roots) for row in x])


def auc(pos, neg):
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


@pytest.mark.parametrize("of", ["trees", "classifier"])
def test_quality_on_labels_not_fitted(spark, of):
    docs, labels = documents(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted, other = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    found = quality_rules.quality_rules(docs, fitted).select("doc_id", "score") if of == "trees" else quality_classifier.quality_classifier(docs, fitted).select("doc_id", "score")
    got = found.join(other, "doc_id").toPandas()
    assert auc(got[got.quality == 1]["score"].to_numpy(), got[got.quality == 0]["score"].to_numpy()) > 0.97


ODD_LABELS = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (999, 1, 1)]


def odd_table(spark):
    rows = [(1, "good text of a few words " * 12, "a", "x", "s1", "en"), (1, "other text of that id " * 12, "a", "x", "s1", None), (2, "!!! ### " * 60, "b", None, None, "en"), (2, "!!! ### " * 60, "b", None, None, "en"), (3, None, None, None, None, None), (None, "no id", "c", "z", "s2", "de"), (4, "", "d", "d", "s1", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, host string, source string, lang string")


def test_quality_of_odd_tables(spark):
    docs, labels = odd_table(spark), spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")
    for work in (quality_rules.quality_rules, quality_classifier.quality_classifier):
        for known in (labels, labels.limit(0), labels.where("doc_id = 3")):
            runs = [sorted(map(str, work(docs.repartition(n), known).collect())) for n in (1, 3)]
            assert runs[0] == runs[1] and len(runs[0]) == 7
            assert work(docs.limit(0), known).count() == 0
    blank = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}[3]
    assert blank.base_failed and not blank.kept and blank.n_words == 0


def test_many_sites_are_salted(spark, monkeypatch):
    docs, labels = odd_table(spark), spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")
    plain = sorted(map(str, quality_classifier.quality_classifier(docs, labels).collect()))
    monkeypatch.setattr(quality_classifier, "MOST_BROADCAST", 0)
    assert sorted(map(str, quality_classifier.quality_classifier(docs, labels).collect())) == plain


def test_quality_posteriors_follow_from_evidence(spark):
    docs = documents(spark)
    got = quality_classifier.quality_classifier(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["kept"] == (got["score"] >= 0.5)).all()
    of = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id")
    rates, posts = of.groupby("source", dropna=False)["evidence"].mean(), of.groupby("source", dropna=False)["host_posterior"].first()
    overall = of["evidence"].mean()
    # shrunk: between the host's own rate and the overall one
    assert ((posts - overall).abs() <= (rates - overall).abs() + 1e-3).all()
    nothing = quality_classifier.quality_classifier(docs.limit(0), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert nothing.count() == 0


def test_quality_scores_against_a_plain_recomputation(spark):
    docs = documents(spark, "sf0.001").selectExpr("doc_id", "text", "concat('h', doc_id % 7 * (doc_id % 3)) as host", "if(doc_id % 2 = 0, concat('p', doc_id), if(doc_id % 5 = 0, null, 'index')) as path")
    lone = spark.createDataFrame([(10**6, "one page of a host", "lone", "p"), (10**6 + 1, None, None, None)], docs.schema)
    docs = docs.unionByName(lone)
    got = quality_classifier.quality_classifier(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), host_col="host", path_col="path").collect()
    of = {r.doc_id: (r.host, (r.host, r.path)) for r in docs.select("doc_id", "host", "path").collect()}
    own = {r.doc_id: r.evidence for r in got}
    assert len(got) == len(of) == len(own) and len(set(own.values())) > 2

    def totals(level):
        sums = {}
        for i, site in of.items():
            n, good = sums.get(site[level], (0, 0.0))
            sums[site[level]] = (n + 1, good + own[i])
        return sums

    def strength(sums):
        n, rates = np.array([v[0] for v in sums.values()]), np.array([v[1] / v[0] for v in sums.values()])
        mean = (n * rates).sum() / n.sum()
        spread = max(rates.var(ddof=1) - mean * (1 - mean) * (1 / n).mean(), 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 1), 10_000)

    hosts, paths = totals(0), totals(1)
    assert sum(n == 1 for n, _ in paths.values()) > 50 and hosts["lone"][0] == hosts[None][0] == 1
    overall = (sum(own.values()) + 1) / (len(own) + 2)
    m_host, m_path = strength(hosts), strength(paths)
    clip, odds = lambda p: min(max(p, 1e-6), 1 - 1e-6), lambda p: np.log(p / (1 - p))
    for r in got:
        (n, good), (path_n, path_good) = hosts[of[r.doc_id][0]], paths[of[r.doc_id][1]]
        host = (good + m_host * overall) / (n + m_host)
        prior = clip((path_good - r.evidence + m_path * host) / (path_n - 1 + m_path))
        score = 1 / (1 + np.exp(odds(overall) - odds(clip(r.evidence)) - odds(prior)))
        assert (r.host_posterior, r.path_posterior, r.score) == pytest.approx((host, prior, score), abs=1e-6)
        assert path_n > 1 or r.path_posterior == pytest.approx(host, abs=1e-6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_twins(spark, duck, compared, name):
    compared(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), duck("sf0.01"), queries.ORACLE_SQL[name])


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}" if i % 9 else None, "x") for i in range(500)] + [(900, None, "s1", "x"), (900, "", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby(["target", "source_size"]).agg(taken=("taken", "sum")).reset_index()
    assert ((by["taken"] - by["target"]).abs() <= 1).all() and (by["target"] <= 3 * by["source_size"] + 1e-6).all()
    out = mixing.mixed_documents(docs, part_words=200)
    assert out.columns == docs.columns and out.rdd.getNumPartitions() > 5
    mixed = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == got["taken"].sum()
    # in training order, with as many copies of each row as passes take it
    due = {r.doc_id: r.position for r in got.itertuples() if r.taken}
    firsts = list(dict.fromkeys(r.doc_id for r in mixed))
    assert sorted(firsts) == sorted(due) and all(due[a] <= due[b] + 1e-12 for a, b in zip(firsts, firsts[1:]))
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in got.itertuples():
        if r.taken:
            assert copies[r.doc_id] == -(-r.taken // r.size)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_repeated_rows_and_nulls_keep_their_places_in_the_mix(spark):
    rows = [(1, "a b c", None, "s"), (1, "a b c", "s", None), (1, "a b c", None, "s"), (2, "d e f", "s", "x"), (None, "g h", "s", "x"), (None, "g h", "s", "x"), (3, "", "s", "x"), (4, None, "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 string")
    plan = mixing.mix(docs).collect()
    out = mixing.mixed_documents(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == sum(r.taken for r in plan) == 16
    assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()} | {(i, t[:1], s, k) for i, t, s, k in rows if t} | {(i, t[:3], s, k) for i, t, s, k in rows if t}


def damaged(data: bytes) -> bytes:
    at = len(data) // 2
    return data[:at] + b"junk!" + data[at + 9 :]


def test_salvage_finds_what_is_whole(spark, tmp_path):
    parts = [warc.member(warc.record(i, f"http://h/{i}", (b"<p>%d</p>" % i) * 40, hashlib.sha256((b"<p>%d</p>" % i) * 40).hexdigest(), None, False)) for i in range(9)]
    plain = gzip.decompress(parts[8])
    broken = bytearray(parts[3])
    broken[len(broken) // 2] ^= 255
    data = parts[0] + b"noise" + parts[1] + bytes(broken) + parts[4] + parts[5][:60] + parts[6] + plain + plain[:100] + parts[7]
    rows = list(warc.salvage(data))
    assert rows[0][0] == 0 and rows[-1][1] == len(data) and all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))
    ids = [warc.number(r[3]["warc-record-id"]) for r in rows if r[2] is None]
    assert ids == [0, 1, 4, 6, 8, 7]
    gaps = sum(r[1] - r[0] for r in rows if r[2])
    assert gaps == len(b"noise") + len(broken) + 60 + 100
    (tmp_path / "a.warc.gz").write_bytes(data)
    read = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.page_id for r in read if r.gap is None] == ids and sum(r.end - r.begin for r in read if r.gap) == gaps


def test_salvage_of_a_member_with_several_records():
    parts = [warc.record(i, f"http://h/{i}", b"<p>%d</p>" % i * 40, "", None, False) for i in range(6)]
    broken = parts[2].replace(b"<p>2</p>", b"<p>X</p>")
    content = b"noise" + parts[0] + parts[1] + broken + parts[3] + parts[4][:90]
    data = warc.member(parts[5]) + gzip.compress(content) + warc.member(parts[5]) + gzip.compress(b"no record") + gzip.compress(parts[0] + parts[1])
    rows = list(warc.salvage(data))
    assert [warc.number(r[3]["warc-record-id"]) for r in rows if r[2] is None] == [5, 0, 1, 3, 5, 0, 1]
    assert [r[4] for r in rows if r[2] is None][1:4] == [warc.parsed(parts[i])[1] for i in (0, 1, 3)]
    assert rows[0][0] == 0 and rows[-1][1] == len(data) and all(a[1] == b[0] or a[:2] == b[:2] for a, b in zip(rows, rows[1:]))
    b, c = len(parts[0] + parts[1]) + 5, len(content) - 90
    whole = [r[2] for r in rows if r[2]]
    assert whole[0].endswith("(bytes 0 to 5 of a member's content)") and f"bytes {b} to {b + len(broken)} " in whole[1] and f"bytes {c} to {len(content)} " in whole[2]
    assert whole[3] == "no version line" and len(whole) == 4


def test_archive_round_trip_of_odd_pages(spark):
    html = [None, "", "short", "é" * 60, "é" * 60, "x" * 200, "x" * 200, "\0\n\r\n\r\n" * 50, "WARC/1.1\r\n" * 30]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\r\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = min(k for k, x in enumerate(html) if (x or "") == (h or "")) if len(raw) >= 100 else i
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(documents(spark, "sf0.1"), labels)
    both = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in both["doc_id"])
    pos, neg = both[both.toxic == 1]["score"].to_numpy(), both[both.toxic == 0]["score"].to_numpy()
    area = auc(pos, neg)
    assert area > 0.95, area
    assert ((both.predicted == 1) == (both.toxic == 1)).mean() > 0.95


def test_toxicity_reads_long_runs_to_their_end():
    run = "".join(chr(0x4E00 + k) for k in range(137))
    for n in (1, 39, 40, 41, 59, 60, 61, 137):
        own = toxicity.words_of(f"a {run[:n]} b")
        assert own[0] == "a" and own[-1] == "b" and max(map(len, own)) <= toxicity.LONGEST
        assert all(any(run[i : i + 20] in w for w in own) for i in range(max(1, n - 19)) if i + 20 <= n)
        assert set("".join(own[1:-1])) == set(run[:n]) and (n > 40 or len(own) == 3)
    score = toxicity.Scorer(toxicity.Net.new({}, 3))
    plain, ending = score(["x" * 60, "x" * 54 + "insult"])
    assert plain != ending


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd(spark, [None, "", "x"]), none).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * 3


def test_network_gradients_against_differences():
    rng = np.random.default_rng(5)
    net = toxicity.Net.new({}, 2)
    net.dense = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.dense.items()}
    x, ids = rng.standard_normal((9, toxicity.DIM)), rng.integers(9, size=(4, toxicity.WINDOW))
    real = np.arange(toxicity.WINDOW) < np.array([32, 5, 1, 20])[:, None]
    truth = np.array([1.0, 0.0, 1.0, 0.0])

    def loss(table):
        logit = net.forward(table, ids, real)
        return np.logaddexp(0, logit).sum() - truth @ logit

    keep = {}
    logit = net.forward(net.projected(x), ids, real, keep)
    grads, dg = net.backward(keep, 1 / (1 + np.exp(-logit)) - truth)
    for name, grad in grads.items():
        for place in [tuple(rng.integers(s) for s in grad.shape) for _ in range(3)]:
            old, ends = net.dense[name][place], []
            for step in (1e-4, -1e-4):
                net.dense[name][place] = old + step
                ends.append(loss(net.projected(x)))
            net.dense[name][place] = old
            assert grad[place] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=2e-3), name
    table = net.projected(x)
    summed = np.zeros_like(table)
    np.add.at(summed, ids.T.ravel(), dg.reshape(-1, 6 * toxicity.HID))
    for place in [(int(ids[0, 3]), 2), (int(ids[3, 7]), 30), (int(ids[1, 0]), 40)]:
        ends = []
        for step in (1e-4, -1e-4):
            moved = table.copy()
            moved[place] += step
            ends.append(loss(moved))
        assert summed[place] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=2e-3)


def slow_logit(net, text):
    """Word by word and number by number: windows, both recurrences, attention, and the worst window."""
    from math import exp, sqrt, tanh

    from plantlens.llm import toxicity as t

    d = {k: v.astype(float) for k, v in net.dense.items()}
    sigmoid = lambda x: 1 / (1 + exp(-x))
    dot = lambda xs, column: sum(a * b for a, b in zip(xs, column))
    words = t.words_of(text) or [""]
    inputs = []
    for w in words:
        found = t.grams(w)
        row = net.words[net.vocab.get(w, 0)]
        inputs.append([float(row[i]) + sum(float(net.grams[g][i]) for g in found) / sqrt(len(found)) for i in range(t.DIM)])

    def states(way, xs):
        h, out = [0.0] * t.HID, []
        w, u, c = (d[f"{n}{way}"] for n in "WUc")
        for x in xs:
            gate = lambda i: dot(x, w[:, i]) + c[i]  # noqa: E731, B023
            back = lambda i: dot(h, u[:, i])  # noqa: E731, B023
            z = [sigmoid(gate(i) + back(i)) for i in range(t.HID)]
            r = [sigmoid(gate(t.HID + i) + back(t.HID + i)) for i in range(t.HID)]
            n = [tanh(gate(2 * t.HID + i) + r[i] * back(2 * t.HID + i)) for i in range(t.HID)]
            h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(t.HID)]
            out.append(h)
        return out

    logits, begin = [], 0
    while True:
        xs = inputs[begin : begin + t.WINDOW]
        both = [f + b for f, b in zip(states("f", xs), states("b", xs[::-1])[::-1])]
        weights = [exp(sum(tanh(dot(h, d["A"][:, k]) + d["a"][k]) * d["v"][k] for k in range(t.ATT))) for h in both]
        pooled = [sum(w * h[i] for w, h in zip(weights, both)) / sum(weights) for i in range(2 * t.HID)]
        logits.append(dot(pooled, d["o"]) + d["k"][0])
        begin += t.STRIDE
        if begin + t.WINDOW - t.STRIDE >= len(words):
            return max(logits)


def test_network_against_a_slow_reading():
    from plantlens.llm import toxicity as t

    rng = np.random.default_rng(14)
    vocab = [f"w{k}" for k in range(30)]
    net = t.Net.new({w: k + 1 for k, w in enumerate(vocab)}, 3)
    net.dense = {k: (v + rng.normal(size=v.shape) * 0.2).astype(np.float32) for k, v in net.dense.items()}
    sizes = [0, 1, 2, t.WINDOW - 1, t.WINDOW, t.WINDOW + 1, t.WINDOW + t.STRIDE, t.WINDOW + t.STRIDE + 1, 3 * t.WINDOW + 5]
    texts = [" ".join(rng.choice([*vocab, "unknownword", "é", "日本"], size=n)) for n in sizes] + ["!?", "x" * 95]
    got = t.Scorer(net)(texts)
    want = [1 / (1 + np.exp(-slow_logit(net, x))) for x in texts]
    assert np.allclose(got, want, atol=2e-4)
    # with other texts, in another order, and read a second time
    scorer = t.Scorer(net)
    scorer(texts[::-1])
    assert np.allclose(scorer(texts), want, atol=2e-4)


def test_toxicity_of_odd_tables(spark):
    docs, labels = odd_table(spark), spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")
    runs = [sorted(map(str, toxicity.toxicity(docs.repartition(n), labels).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 7
    scores = toxicity.toxicity(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in scores) and {r.held_out for r in scores if r.doc_id is None} == {False}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted == 0 for r in scores)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_archives_roll_and_large_members(spark, tmp_path):
    rng = np.random.default_rng(1)
    big = bytes(rng.integers(32, 127, size=22 << 20, dtype=np.uint8)).decode()
    rows = [(k, f"http://h/{k}", f"page {k} " * 30) for k in range(40)] + [(40, None, big), (7, "http://h/7", "page 7 " * 30), (None, None, "page 3 " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as archive", "1 as first").repartition(1)
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=2000)
    assert len(list((tmp_path / "w").glob("archive=*"))) > 3
    read = warc.read_records(spark, str(tmp_path / "w"), str(tmp_path / "gaps")).collect()
    assert spark.read.parquet(str(tmp_path / "gaps")).count() == 0
    sizes = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes) for r in read)
    assert sizes == sorted((i if i is not None else -1, len(h.encode())) for i, _, h in rows)
    assert next(r for r in read if r.page_id == 40).payload == big.encode()
    # damage one archive: the log names the bytes, and what is whole is still there
    path = max((p for p in (tmp_path / "w").rglob("part-*")), key=lambda p: p.stat().st_size)
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 255
    path.write_bytes(bytes(data))
    (path.parent / f".{path.name}.crc").unlink()
    left = warc.read_records(spark, str(tmp_path / "w"), str(tmp_path / "gaps"))
    gaps = spark.read.parquet(str(tmp_path / "gaps")).collect()
    assert left.count() == len(rows) - 1 and gaps and all(g.end > g.begin for g in gaps)


@pytest.mark.parametrize(
    "mark",
    [b"\x1f\x8b\x08", b"\x1f\x8b\x08\x10aaaaaa", b"\x1f\x8b\x08\x04aaaaaa\x10\x00" + b"b" * 16, b"\x1f\x8b\x08\0\0\0\0\0\0\xff", b"\x1f\x8b\x08\0\0\0\0\0\0\xffKLJ", b"WARC/1.", b"WARC/1.0\r\n", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0\r\na: b\r\n\r\n"],
)
def test_marks_without_records_take_time_in_proportion(mark):
    import time

    page = b"<p>a page</p>" * 20
    whole = warc.member(warc.record(7, "http://h/7", page, hashlib.sha256(page).hexdigest(), None, False))
    took = []
    for size in (1 << 19, 1 << 22):
        data = whole + mark * (size // len(mark)) + whole
        began = time.process_time()
        rows = list(warc.salvage(data))
        took.append(time.process_time() - began)
        assert [r[3]["warc-payload-length"] for r in rows if r[2] is None] == [str(len(page))] * 2
        assert rows[0][0] == 0 and rows[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert took[1] < 6 and took[1] < 12 * took[0] + 0.5


def test_records_that_claim_each_other_take_time_in_proportion():
    import time

    for n in (2_000, 8_000):
        head = b"WARC/1.0\r\nWARC-Block-Digest: sha256:00\r\nContent-Length: %09d\r\n\r\n"
        size = len(head % 0)
        data = b"".join(head % (size * (n - 1 - k)) for k in range(n)) + b"\r\n\r\n"
        began = time.process_time()
        assert all(r[2] for r in warc.salvage(data))
        assert time.process_time() - began < 5


def test_reading_takes_time_in_proportion():
    import time

    page = b"<p>some words of a page</p>" * 40
    parts = [warc.member(warc.record(i, f"http://h/{i}", page, hashlib.sha256(page).hexdigest(), None, False)) for i in range(500)]
    took = []
    for times in (4, 16):
        data = b"".join(parts * times) + b"\x1f\x8b\x08" * 500
        began = time.perf_counter()
        assert sum(r[2] is None for r in warc.salvage(data)) == 500 * times
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]
