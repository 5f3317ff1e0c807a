"""Statistics of a document's text, used by the rules and the classifier of quality."""

from __future__ import annotations

import numpy as np

SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and how quality may change as each grows: 1 up only, -1 down only, 0 either way.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "loud_share": -1, "digit_share": 0, "mark_share": 0, "line_words": 0, "top_share": 0}


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more; ids number the distinct words from 0."""
    if len(ids) < 4:
        return 0
    m = int(ids.max()) + 1
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * m + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(triples), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The BASE counts and the FEATURES of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(ids)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b".,;:?()\"'-"))
    loud = raw.count(b"!")
    top = int(np.bincount(ids).max())
    base = [n, word_chars, symbols, dup, repeats]
    return base, [float(np.log1p(n)), word_chars / n, symbols / word_chars, dup / len(lines), repeats / n, len(numbers) / n, upper / word_chars, loud / word_chars, digits / word_chars, marks / word_chars, n / len(lines), top / n]


def statistics_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = [statistics(t) for t in texts]
    return np.array([b for b, _ in got], dtype=np.int64).reshape(-1, len(BASE)), np.array([f for _, f in got], dtype=np.float64).reshape(-1, len(FEATURES))
