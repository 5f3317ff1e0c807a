"""Personal data and secrets by weak supervision.

Candidates are the base spans (strict patterns of email, ip, card and phone)
and looser ones, among them secrets: long runs of letters and digits, and what
a name like ``token`` or ``passwort`` is set to. Six labelers vote on each: a
strict pattern, a test of form, a gazetteer, cue words in front (in four
languages), the edges, and what stands around a value. Votes are counted over
all documents by kind and pattern of votes; expectation-maximisation on those
counts (Dawid and Skene's model) estimates, for each kind, how reliable each
labeler is and how likely each pattern is personal data.

Those likelihoods are the soft labels on which the final span classifier is
trained: a logistic one over the votes and over what the span and its
surroundings look like (shape, signs, letters on both sides, words in front,
all hashed). A looser candidate becomes a span if the classifier is for it and
no base span of its kind overlaps it. Base spans always stay.

Bounds: votes are counted over all candidates; the classifier is fitted on at
most ``sample`` of them, drawn by a hash of the document and place.

Edge cases: a null or empty text has no spans; places count code points;
repeated rows are handled one by one; texts of any length are read in one pass
of patterns that take linear time; with no candidate at all, or in an empty
table, nothing is added; other columns are ignored (and kept by the masking).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text, rewritten, saved

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that have base spans.
BASE_KINDS = KINDS[:4]
COUNTS = tuple(f"n_{k}" for k in BASE_KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Whatever has digits and signs of numbers; no ip, card or phone reaches beyond one such stretch, but for the bracket that opens a looser phone.
STRETCH = re.compile(r"[+0-9][0-9\x20.()-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
AT_SIGN = re.compile(r"\x20?[(\[]at[)\]]\x20?")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(
    r"(?i)(?:token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|kennwort|schl(?:ü|ue)ssel|contrase(?:ñ|n)a|clave|mot\x20de\x20passe|jeton|cl(?:é|e)\x20secr(?:è|e)te)"
    r"\w{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>,;]{8,})"
)
DIGITS = re.compile(r"[0-9]")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# Generic top-level domains; any two letters count as a country's.
GENERIC = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "cloud", "online", "site", "shop", "blog", "mobi", "tech", "xyz"}
# First digits of card issuers, calling codes of countries, networks that are no person's address, and how issuers' keys begin.
ISSUERS = re.compile(r"4|5[0-8]|6[0-9]|2[2-7]|3[0-9]")
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|50|59|6[789]|8[0578]|9[679])[0-9]")
NO_PERSON = re.compile(r"0\.|127\.|255\.|22[4-9]\.|23[0-9]\.")
ISSUED = re.compile(r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk_|rk_|eyJ|SG\.|ya29\.|npm_|hf_")
#: Words in front of a span that speak for it (English, German, Spanish, French), and such that speak against any.
CUES = {
    "email": ("mail", "contact", "kontakt", "write", "schreib", "correo", "contacto", "escrib", "courriel", "écri", "adress", "dirección"),
    "ip": ("ip", "host", "server", "servidor", "serveur", "address", "adresse", "dirección", "login", "anmeldung", "client", "connect"),
    "card": ("card", "visa", "credit", "payment", "pay ", "karte", "kredit", "zahlung", "tarjeta", "pago", "crédito", "carte", "paiement", "crédit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "fon", "anruf", "handy", "llam", "móvil", "appel", "portable"),
    "secret": ("token", "secret", "passw", "pwd", "key", "credential", "bearer", "auth", "kennwort", "geheim", "schlüssel", "clave", "contraseña", "secreto", "mot de passe", "jeton", "clé"),
}
DOUBTS = ("version", "isbn", "issn", "order", "invoice", "serial", "section", "chapter", "commit", "sha", "checksum", "bestell", "rechnung", "kapitel", "pedido", "factura", "capítulo", "commande", "facture", "chapitre", "id:", "no.", "nr.", "núm", "n°")
LABELERS = 6
#: Characters in front of a span in which cues are sought; places of the hashed features.
NEAR, PLACES = 40, 1 << 12
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ in turn."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str, stretches: list[tuple[int, str]]) -> list[Span]:
    """(start, end, kind) of the base rules, in order."""
    out = [(a, b, 0) for a, b in emails(text)]
    for at, s in stretches:
        if s.count(".") >= 3:
            out += [(at + m.start(), at + m.end(), 1) for m in IP.finditer(s) if octets(m[0])]
        out += [(at + m.start(), at + m.end(), 2) for m in CARD.finditer(s) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if s[0] == "+":
            out += [(at + m.start(), at + m.end(), 3) for m in PHONE.finditer(s) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def stretches_of(text: str) -> list[tuple[int, str]]:
    """Stretches long enough for the shortest base span (four parts of an ip)."""
    return [(m.start(), m[0]) for m in STRETCH.finditer(text) if m.end() - m.start() >= 7]


def loose_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with a spelled-out sign, found from each of those in turn."""
    out, floor = [], 0
    for m in AT_SIGN.finditer(text):
        head = text[floor : m.start()]
        start = floor + len(head.rstrip(LOCAL))
        floor = m.end()
        if start < m.start() and (d := LOOSE_DOMAIN.match(text, m.end())):
            out.append((start, d.end()))
    return out


def entropy(run: str) -> float:
    """Bits per character."""
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values())


def secrets(text: str) -> list[tuple[int, int]]:
    """Values that a telling name is set to, and runs of letters and digits mixed, of 16 characters or more."""
    out = [m.span(1) for m in ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    for m in RUN.finditer(text):
        run = m[0].strip("-/")
        a = m.start() + m[0].index(run) if run else 0
        digits = len(DIGITS.findall(run))
        if len(run) >= 16 and 2 <= digits < len(run) - 1:
            out.append((a, a + len(run)))
    return out


def loose_spans(text: str, stretches: list[tuple[int, str]]) -> list[Span]:
    out = [(a, b, 0) for a, b in loose_emails(text)] if "at)" in text or "at]" in text else []
    for at, s in stretches:
        if len(s) >= 10:
            out += [(at + m.start(), at + m.end(), 2) for m in LOOSE_CARD.finditer(s)]
            if at and text[at - 1] == "(" and s[0] != "+":
                at, s = at - 1, "(" + s
            out += [(at + m.start(), at + m.end(), 3) for m in LOOSE_PHONE.finditer(s)]
    return out + [(a, b, 4) for a, b in secrets(text)]


def votes(text: str, start: int, end: int, kind: int, base: bool) -> str:
    """One letter of each labeler: y, n or - (no vote)."""
    span = text[start:end]
    digits = digits_of(span) if kind in (2, 3) else ""
    strict = base
    if kind == 0:
        last = re.split(r"[.)\]]", span)[-1].strip().lower()
        form, known = len(span) <= 254 and not span.startswith("."), "ny"[last in GENERIC or (len(last) == 2 and last.isalpha())]
    elif kind == 1:
        form, known = all(len(p) <= 3 for p in span.split(".")), "yn"[bool(NO_PERSON.match(span))]
    elif kind == 2:
        form, known = luhn(digits), "ny"[bool(ISSUERS.match(digits))]
    elif kind == 3:
        form = 10 <= len(digits) <= 15
        known = "ny"[bool(CALLING.match(digits))] if span[0] == "+" else "y" if span[0] == "(" else "-"
    else:
        bits = entropy(span)
        strict = (len(span) in (32, 40, 48, 64, 96, 128) and HEX.fullmatch(span) is not None) or bool(ISSUED.match(span))
        form, known = bits >= min(3.0, 0.7 * math.log2(len(span))) and span.count("/") < 3, "y" if ISSUED.match(span) else "n" if UUID.fullmatch(span) else "-"
    before = text[max(0, start - NEAR) : start].lower()
    cue = "y" if any(c in before for c in CUES[KINDS[kind]]) else "n" if any(c in before for c in DOUBTS) else "-"
    left, right = text[start - 1 : start], text[end : end + 1]
    joined = left.isalnum() or left in {"@", "_", "/"} or (left == "=" and kind != 4) or right.isalnum() or right in {"@", "_"}
    ahead = before.rstrip("\"' ")
    around = "y" if ahead.endswith((":", "=")) or (left and left == right and left in "\"'`") else "-"
    return ("y" if strict else "-") + "ny"[form] + known + cue + "yn"[joined] + around


def look(text: str, start: int, end: int, kind: int, ballots: str) -> list[int]:
    """Places of the features of a span: its votes, its shape and signs, the signs and letters beside it, and the words in front, each by kind."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span[:64]))
    kinds_of = lambda c: "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else c
    ahead = re.findall(r"\w+", text[max(0, start - NEAR) : start].lower())[-3:]
    names = ["", f"n{min(12, len(span) // 4)}", f"s{shape[:24]}", f"l{kinds_of(text[start - 1 : start])}", f"r{kinds_of(text[end : end + 1])}"]
    names += [f"v{j}{v}" for j, v in enumerate(ballots)] + [f"w{w}" for w in ahead] + [f"c{c}" for c in set(span) if not c.isalnum()]
    return sorted({zlib.crc32(f"{kind}{n}".encode()) % PLACES for n in names})


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, end, kind, base, pattern) of all candidates; looser ones keep clear of base spans of their kind and each other."""
    stretches = stretches_of(text)
    out, ends = [], {k: -1 for k in range(len(KINDS))}
    base = base_spans(text, stretches)
    taken: dict[int, list[tuple[int, int]]] = {}
    for a, b, k in base:
        # a secret keeps clear of all base spans
        for own in (k, len(KINDS) - 1):
            spans = taken.setdefault(own, [])
            spans.append((a, max(b, spans[-1][1]) if spans else b))
    extra = []
    for a, b, k in sorted(loose_spans(text, stretches), key=lambda s: (s[0], -s[1], s[2])):
        own = taken.get(k, [])
        if a >= ends[k] and not overlapped(own, a, b):
            extra.append((a, b, k))
            ends[k] = b
    for (a, b, k), is_base in sorted([(s, True) for s in base] + [(s, False) for s in extra]):
        out.append((a, b, k, is_base, f"{k}{votes(text, a, b, k, is_base)}"))
    return out


def overlapped(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b overlaps one of the spans, given by their beginnings and the farthest end up to each."""
    at = bisect_left(spans, (b,))
    return at > 0 and spans[at - 1][1] > a


def reliabilities(counts: dict[str, int], rounds: int = 60) -> tuple[np.ndarray, dict[str, float]]:
    """By expectation-maximisation: how each labeler votes (kind x class x labeler x y/n/-), and how likely each pattern is personal data."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=np.float64)
    ballots = np.array([["yn-".index(c) for c in p[1:]] for p in patterns], dtype=np.int64).reshape(-1, LABELERS)
    kinds = np.array([int(p[0]) for p in patterns], dtype=np.int64)
    # a few imagined votes: labelers tend to be right
    imagined = np.broadcast_to(np.array([[1.0, 2.0, 2.0], [2.0, 1.0, 2.0]])[None, :, None, :], (len(KINDS), 2, LABELERS, 3))
    table = imagined / imagined.sum(axis=-1, keepdims=True)
    sure = (0.5 + (ballots == 0).sum(axis=1)) / (1 + (ballots < 2).sum(axis=1)) if len(n) else np.zeros(0)
    for _ in range(rounds if len(n) else 0):
        hits, prior = imagined.copy(), np.ones((len(KINDS), 2))
        for c, w in enumerate((n * (1 - sure), n * sure)):
            np.add.at(prior, (kinds, c), w)
            for j in range(LABELERS):
                np.add.at(hits, (kinds, c, j, ballots[:, j]), w)
        table, prior = hits / hits.sum(axis=-1, keepdims=True), prior / prior.sum(axis=1, keepdims=True)
        own = [np.log(prior[kinds, c]) + sum(np.log(table[kinds, c, j, ballots[:, j]]) for j in range(LABELERS)) for c in range(2)]
        sure = 1 / (1 + np.exp(np.clip(own[0] - own[1], -500, 500)))
    return table, dict(zip(patterns, sure.tolist(), strict=True))


class SpanModel:
    """The final span classifier: logistic over hashed features, fitted to soft labels."""

    def __init__(self, looks: list[list[int]], sure: list[float], ridge: float = 0.3, steps: int = 300):
        self.w = np.zeros(PLACES)
        if not looks:
            return
        sizes = np.array(list(map(len, looks)))
        at, row, y = np.concatenate([np.asarray(x, dtype=np.int64) for x in looks]), np.repeat(np.arange(len(looks)), sizes), np.asarray(sure)
        rate = 4.0 / (len(looks) * sizes.mean() / 8 + 4 * ridge)
        moved = np.zeros(PLACES)
        # gradient steps with momentum
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.bincount(row, weights=self.w[at], minlength=len(looks))))
            grad = np.bincount(at, weights=(p - y)[row], minlength=PLACES) + ridge * self.w
            moved = 0.9 * moved - 0.1 * rate * grad
            self.w += moved

    def accepts(self, places: list[int]) -> bool:
        return bool(self.w[places].sum() >= 0)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


CANDIDATES = "doc_id long, places array<long>, base array<boolean>, pattern array<string>, look array<array<int>>"


def found_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its candidates: places, base flags, patterns and features in parallel arrays."""

    def work(rows, texts):
        own = [candidates(t) for t in texts]
        looks = [[look(t, a, b, k, p[1:]) for a, b, k, _, p in cs] for t, cs in zip(texts, own, strict=True)]
        return {"doc_id": rows.column(0), "places": [[v for c in cs for v in c[:3]] for cs in own], "base": [[c[3] for c in cs] for cs in own], "pattern": [[c[4] for c in cs] for cs in own], "look": looks}

    return by_slice(id_text(docs, id_col, text_col), "text", CANDIDATES, work)


def fitted(found: DataFrame, sample: int) -> SpanModel:
    """The classifier; what reaches the driver is one count per pattern (3,645 at most) and the features of a bounded sample."""
    counts = dict(found.select(F.explode("pattern").alias("p")).groupBy("p").count().collect())
    _, sure = reliabilities(counts)
    each = found.where(F.size("pattern") > 0).select("doc_id", F.posexplode(F.arrays_zip("pattern", "look")).alias("nth", "c")).select("c.pattern", "c.look", F.xxhash64("doc_id", "nth", "c.look").alias("order"))
    drawn = each.orderBy("order", "pattern").limit(sample).select("pattern", "look").collect()
    drawn.sort(key=lambda r: (r[0], r[1]))
    return SpanModel([r[1] for r in drawn], [sure[r[0]] for r in drawn])


def pii(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans by kind (n_email, n_ip, n_card, n_phone), base_sha256, all spans, how many of them the method added, and how many are secrets."""
    found = saved(found_candidates(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fitted(found, sample))
    extra = ("n_added", "n_secret")

    def decide(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (*COUNTS, "base_sha256", "spans", *extra)}
            for places, base, looks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                spans = list(zip(places[0::3], places[1::3], places[2::3], strict=True))
                kept = [s for s, b, x in zip(spans, base, looks, strict=True) if b or model.value.accepts(x)]
                own = [s for s, b in zip(spans, base, strict=True) if b]
                for k, n in enumerate(COUNTS):
                    out[n].append(sum(s[2] == k for s in own))
                out["base_sha256"].append(hashlib.sha256(spelled(own).encode()).hexdigest())
                out["spans"].append(spelled(kept))
                out["n_added"].append(len(kept) - len(own))
                out["n_secret"].append(sum(KINDS[s[2]] == "secret" for s in kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, type=pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, v in out.items())], names=["doc_id", *out])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long")


def redacted(text: str, accepts: Callable[[list[int]], bool], mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> str:
    """The text with each span, or stretch of overlapping spans, replaced by the mark of its first kind."""
    out, last = [], 0
    spans = [(a, b, k) for a, b, k, base, p in candidates(text) if base or accepts(look(text, a, b, k, p[1:]))]
    k = 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[last:a], mark(KINDS[kind])]
        last = b
    return "".join([*out, text[last:]]) if out else text


def redacted_documents(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with their personal data and secrets masked; ``chars_col``, where there is one, follows the text."""
    found = found_candidates(docs, id_col, text_col).where(F.size("pattern") > 0)
    model = docs.sparkSession.sparkContext.broadcast(fitted(saved(found), sample))
    at, size_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def work(rows, texts):
        columns = list(rows.columns)
        new = [redacted(t, model.value.accepts) for t in texts]
        sizes = None if size_at is None else columns[size_at].to_pylist()
        if sizes is not None:
            columns[size_at] = pa.array([n if a == b or n is None else len(b) for n, a, b in zip(sizes, texts, new, strict=True)], type=pa.int64())
        columns[at] = pa.array([None if old is None else t for old, t in zip(columns[at].to_pylist(), new, strict=True)], type=pa.string())
        return pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return rewritten(docs, text_col, work)
