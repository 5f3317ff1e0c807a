"""Pre-tokens of the word-level BPE vocabulary and their merging in numpy.

The vocabulary file says how a text is cut: composed (NFC) text, white space to
one blank, lower case character by character, then letters, single digits,
runs of other signs and a few English endings. Strings of special tokens are
cut out of the raw text first. All of it is read from the file or checked
against it when the vocabulary is loaded. Letters and digits that came after
Unicode 16 are signs here, as they are for the library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from plantlens.llm.word_hash import unlike, word_hashes, words_of_each

#: Lower case that the library gives and str.lower does not: it looks at no neighbours, and knows newer letters (two of them by range and distance).
LOWER = {"\u03a3": "\u03c3", "\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7da": "\ua7db", "\ua7dc": "\u019b"}
LOWER |= {chr(c): chr(c + far) for begin, end, far in ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)) for c in range(begin, end + 1)}
HAS_LOWER, TO_LOWER = re.compile(f"[{''.join(LOWER)}]"), str.maketrans(LOWER)
# Letters and digits of Unicode 17 and 18, which the library counts as signs.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
HAS_NEWER = regex.compile(f"[{NEWER}]")
NONE = np.int32((1 << 31) - 1)
#: Words of more symbols are merged one by one, over linked places.
LONG_WORD = 512
#: Distinct words remembered by a Python worker; beyond it only those of the present texts stay.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairTable:
    """Pair key to row number by two hash tables, the second for keys that meet others in the first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.sizes = (20, 18)
        self.factors: list[np.uint64] = []
        self.tables: list[np.ndarray] = []
        left = np.arange(len(keys))
        rng = np.random.default_rng(1)
        for bits in self.sizes:
            for _ in range(200):
                factor = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
                slot = (self.keys[left] * factor) >> np.uint64(64 - bits)
                _, first, count = np.unique(slot, return_index=True, return_counts=True)
                if bits == self.sizes[0] or count.max(initial=1) == 1:
                    break
            else:
                raise ValueError("no multiplier separates the pairs")
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot[first]] = left[first]
            self.factors.append(factor)
            self.tables.append(table)
            left = np.delete(left, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers of the keys, NONE for those that are no pair."""
        keys = keys.view(np.uint64)
        at = self.tables[0][(keys * self.factors[0]) >> np.uint64(64 - self.sizes[0])]
        out = np.where((at >= 0) & (self.keys[at] == keys), at, NONE)
        # a key is in the second table only if its place in the first is another's
        rest = np.flatnonzero((at >= 0) & (out == NONE))
        if len(rest):
            at = self.tables[1][(keys[rest] * self.factors[1]) >> np.uint64(64 - self.sizes[1])]
            out[rest] = np.where((at >= 0) & (self.keys[at] == keys[rest]), at, NONE)
        return out


class WordVocab:
    """Ranks and symbols of a ``tokenizers`` JSON file with end-of-word symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        older = "(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER}]]")
        # with and without blanks, for most texts and for those with newer letters
        self.patterns = {(blanks, newer): regex.compile((older if newer else pattern) + "| " * blanks) for blanks in (False, True) for newer in (False, True)}
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int64)
        self.width = np.int64(len(ids))
        keys = np.array([ids[a] * len(ids) + ids[b] for a, b in model["merges"]], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        # pairs stand in the order of their ranks
        self.made, self.pairs = made, PairTable(keys)
        rank = np.full(len(ids), -1)
        rank[made] = np.arange(len(made))
        # no pair of a symbol ranks before the merge that makes the symbol: then a new pair never comes before those left of the lowest one
        self.ordered = bool(len(np.unique(made)) == len(made) and (np.maximum(rank[keys // self.width], rank[keys % self.width]) < np.arange(len(made))).all())

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; special strings in it stay whole (no pre-token is like one)."""
        if "<|" in text and (parts := self.cut_special.split(text))[1:]:
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str, blanks: bool = False) -> list[str]:
        if text.isascii():
            return self.patterns[blanks, False].findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if HAS_LOWER.search(text):
            text = text.translate(TO_LOWER)
        text = text.lower()
        return self.patterns[blanks, bool(HAS_NEWER.search(text))].findall(text)

    def first_apart(self, hit: np.ndarray) -> np.ndarray:
        """Which places of one pair, in order, are merged at once: in a run of touching ones, every other from the first on."""
        if not self.ordered:
            return np.arange(len(hit)) == 0
        begins = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        return (np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))) % 2 == 0

    def merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols left of one long word: its lowest-ranked pair is applied wherever it stands, over linked places, and only new pairs are looked up."""
        n = len(symbols)
        behind, before, gone = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, dtype=bool)
        rank = np.full(n, NONE, dtype=np.int32)
        queue: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            rank[at] = self.pairs.find(symbols[at] * self.width + symbols[behind[at]])
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(queue, r)
                waiting.setdefault(r, []).append(part)

        enter(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[~gone[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            # number the places that are left by their order among the hits: touching ones follow each other
            steps = np.where(behind[hit[:-1]] == hit[1:], 1, 2)
            first = self.first_apart(np.concatenate([[0], np.cumsum(steps)]))
            if not self.ordered and len(hit) > 1:
                waiting[r] = [hit[1:]]
                heapq.heappush(queue, r)
            hit = hit[first]
            eaten = behind[hit]
            symbols[hit], gone[eaten], behind[hit] = self.made[r], True, behind[eaten]
            inner = behind[hit] < n
            before[behind[hit[inner]]] = hit[inner]
            rank[hit], rank[eaten] = NONE, NONE
            ahead = before[hit]
            enter(np.unique(np.concatenate([hit[inner], ahead[ahead >= 0]])))
        return symbols[~gone]

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols left of words (their bytes in a row, and how many each has), and how many symbols each word has.

        The words lie one after the other in one ragged array. In each round every
        word applies its own lowest-ranked pair wherever it stands, all at once;
        only the pairs beside a new symbol are looked up again, and a word with no
        pair left is set aside.
        """
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            return self.merged_with_long(flat, sizes, long)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        rank[:-1] = self.pairs.find(symbols[:-1] * self.width + symbols[1:])
        rank[ends - 1] = NONE
        word, left = np.arange(len(sizes)), sizes.copy()
        done_symbols, done_words, done_sizes = [], [], []
        while len(word):
            begins = np.cumsum(left) - left
            best = np.minimum.reduceat(rank, begins)
            live = best < NONE
            if not live.all():
                each = np.repeat(live, left)
                done_symbols.append(symbols[~each])
                done_words.append(word[~live])
                done_sizes.append(left[~live])
                symbols, rank, word, left, best = symbols[each], rank[each], word[live], left[live], best[live]
                begins = np.cumsum(left) - left
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, left))
            own = np.arange(len(word))
            if len(hit) > len(word):
                # the last symbol of a word begins no pair, so touching places are of one word
                hit = hit[self.first_apart(hit)] if self.ordered else hit[np.searchsorted(hit, begins)]
                own = np.searchsorted(begins, hit, side="right") - 1
            symbols[hit] = self.made[best[own]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            left = left - np.bincount(own, minlength=len(word))
            at, begins = hit - np.arange(len(hit)), np.cumsum(left) - left
            inner = at < (begins + left)[own] - 1
            rank[at[~inner]] = NONE
            for place in (at[inner], at[at > begins[own]] - 1):
                rank[place] = self.pairs.find(symbols[place] * self.width + symbols[place + 1])
        if not done_words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        symbols, word, left = np.concatenate(done_symbols), np.concatenate(done_words), np.concatenate(done_sizes)
        counts = np.zeros(len(sizes), dtype=np.int64)
        counts[word] = left
        order = np.argsort(np.repeat(word, left), kind="stable")
        return symbols[order], counts


    def merged_with_long(self, flat: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merged``: the words at ``long`` one by one, the others together."""
        ends = np.cumsum(sizes)
        short = np.ones(len(sizes), dtype=bool)
        short[long] = False
        symbols, counts = self.merged(flat[np.repeat(short, sizes)], sizes[short])
        parts = np.split(symbols, np.cumsum(counts)[:-1]) if short.any() else []
        for i in long:
            own = flat[ends[i] - sizes[i] : ends[i]]
            parts.insert(i, self.merged_long(np.append(self.inner[own[:-1]], self.last[own[-1]])))
        return np.concatenate(parts), np.array(list(map(len, parts)), dtype=np.int64)


@lru_cache(maxsize=4)
def vocab(path: str) -> WordVocab:
    return WordVocab(path)


class Remembered:
    """Ids of the words (between ASCII white space) met so far, by their hashes in order; ``flat`` has them in a row, ``text`` the words' bytes."""

    def __init__(self, v: WordVocab):
        self.v, self.text = v, b""
        self.keys, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.places, self.lengths, self.begins, self.sizes = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def work_out(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in a row, and how many each has. They are cut and merged together."""
        v, joined = self.v, b" ".join(words) + b" "
        if b"<|" in joined:
            pieces = [p for w in words for p in (*v.cut(w.decode()), " ")]
        else:
            pieces = v.plain(joined.decode(), blanks=True)
        data = np.frombuffer("\n".join(pieces).encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        begins = np.append(0, ends[:-1] + 1)
        blank = (ends - begins == 1) & (data[begins] == 32)
        symbols, sizes = v.merged(data[(data != 10) & (data != 32)], (ends - begins)[~blank])
        if b"<|" in joined:
            own = [p for p in pieces if p != " "]
            ids = [[v.special[p]] if p in v.special else part for p, part in zip(own, np.split(symbols, np.cumsum(sizes)[:-1]), strict=True)]
            symbols, sizes = np.concatenate(ids), np.array(list(map(len, ids)))
        per_word = np.append(0, np.cumsum(sizes))[np.cumsum(~blank)[blank]]
        return symbols, np.diff(per_word, prepend=0)

    def look_up(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word of a text begins, and where its ids begin in ``flat`` and how many they are.

        A word is taken for one met before only if all its bytes agree.
        """
        hashes, starts, stops = word_hashes(raw)
        lengths = stops - starts
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        if (len(self.keys) + (~known).sum()) > REMEMBERED:
            self.forget(at[known])
            at = np.searchsorted(self.keys, distinct)
        if not known.all():
            self.learn(raw, distinct[~known], starts[first[~known]], stops[first[~known]])
            at = np.searchsorted(self.keys, distinct)
        begins, sizes, place = self.begins[at][back], self.sizes[at][back], at[back]
        odd = self.lengths[place] != lengths
        same = np.flatnonzero(~odd)
        odd[same] = unlike(raw, starts[same], self.text, self.places[place[same]], lengths[same])
        if odd.any():
            # unlike words of one hash: worked out for this text alone
            own = [raw[a:b] for a, b in zip(starts[odd].tolist(), stops[odd].tolist(), strict=True)]
            names = {w: k for k, w in enumerate(dict.fromkeys(own))}
            ids, counts = self.work_out(list(names))
            which = np.array([names[w] for w in own])
            begins[odd], sizes[odd] = (len(self.flat) + np.cumsum(counts) - counts)[which], counts[which]
            self.flat = np.concatenate([self.flat, ids])
        return starts, begins, sizes

    def forget(self, stay: np.ndarray) -> None:
        """Keep these words only."""
        text = np.frombuffer(self.text, dtype=np.uint8)
        for places, sizes, data in (("places", self.lengths[stay], text), ("begins", self.sizes[stay], self.flat)):
            kept = data[spread(getattr(self, places)[stay], sizes)]
            setattr(self, places, np.cumsum(sizes) - sizes)
            if data is text:
                self.text = kept.tobytes()
            else:
                self.flat = kept
        self.keys, self.lengths, self.sizes = self.keys[stay], self.lengths[stay], self.sizes[stay]

    def learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Work out new words and put them where their hashes belong."""
        words = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        ids, sizes = self.work_out(words)
        lengths = stops - starts
        place = np.searchsorted(self.keys, keys)
        new = {"keys": keys, "places": len(self.text) + np.cumsum(lengths) - lengths, "lengths": lengths, "begins": len(self.flat) + np.cumsum(sizes) - sizes, "sizes": sizes}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self.flat, self.text = np.concatenate([self.flat, ids]), self.text + b"".join(words)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of ragged parts, one part after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=4)
def remembered(path: str) -> Remembered:
    return Remembered(vocab(path))


def looked_up(texts: list[str], path: str) -> tuple[Remembered, np.ndarray, np.ndarray, np.ndarray]:
    """The memory, the words of each text, and the places and sizes of the words' ids in it."""
    memory, raw = remembered(path), [t.encode() for t in texts]
    starts, begins, sizes = memory.look_up(b"\n".join(raw))
    return memory, words_of_each(starts, list(map(len, raw))), begins, sizes


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, as the library for the file counts them without added special tokens."""
    _, words, _, sizes = looked_up(texts, path)
    return np.diff(np.append(0, np.cumsum(sizes))[np.cumsum(words)], prepend=0)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, as the library gives them without added special tokens."""
    memory, words, begins, sizes = looked_up(texts, path)
    ids = memory.flat[spread(begins, sizes)]
    return np.split(ids, np.append(0, np.cumsum(sizes))[np.cumsum(words)][:-1]) if texts else []
