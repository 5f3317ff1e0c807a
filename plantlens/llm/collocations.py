"""Collocations: frequent phrases of two to ``max_n`` words that occur together more often than their parts suggest.

Suffix-sigma. Of every place in a piece of text the suffix from there, cut to
``max_n`` words, is sent out once. Suffixes are dealt in ranges of their order by
language and first word, and by the words behind it where a first word is so
frequent that it spreads over several ranges. Each range is sorted in reverse, so
that all suffixes with a common beginning stand together, longer ones first, and
one stack with an entry for each length counts all prefixes as it goes by. A
phrase on the border of two ranges has a count from either, and these are added.

A phrase of which ``least`` occurrences are asked for has no rarer word. So words
are counted first, and a suffix ends where a rarer word stands. Frequent words are
written as numbers, by which a suffix is two whole numbers; equal suffixes of a
task are sent once with their count. The list of numbered words has at most LISTED
entries and is all that is broadcast; phrases with frequent words beyond it are
counted as texts.

The parts of a phrase are no rarer than the phrase, so all of them have been
counted too, and are joined afterwards. Scores are integers of up to 38 digits.

Edge cases: null and empty texts, and texts without words, give nothing; a null
language counts as ``und``, together with one so called. Every row counts,
repeated ones and those without id too. Ties of a score and of counts are decided
by the phrase. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import saved, slices

# Blanks part words, and these signs part pieces; A-Z is lower-cased.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
SIGNS = bytes.maketrans(UPPER + b"\t" + SEPARATORS, UPPER.lower() + b" " + b"\n" * len(SEPARATORS))
MAX_N = 5
#: Bits of a word's number; three words lie in one whole number.
BITS = 21
LISTED = 500_000
#: Bytes of text worked on at a time, words counted and suffixes combined before they are sent, and rows that the stack takes at a time.
PORTION, COUNTED, COMBINED, STACKED = 4 << 20, 400_000, 1 << 20, 1 << 18
#: Groups in which a language's candidates are ranked first.
SALTS = 64
FOUND = "lang string, phrase string, a long"


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language together, with lines between pieces, in portions that are cut between pieces only."""
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        for i, j in slices([t or "" for t in texts]):
            of_lang = defaultdict(list)
            for lang, text in zip(langs[i:j], texts[i:j], strict=True):
                of_lang[lang].append(text or "")
            for lang, some in of_lang.items():
                raw = "\n".join(some).encode().translate(SIGNS)
                begin = 0
                while begin < len(raw):
                    end = raw.find(b"\n", begin + PORTION) + 1 or len(raw)
                    yield lang, raw[begin:end]
                    begin = end


def tokens_of(raw: bytes) -> list[bytes]:
    """Words, b'' for further blanks, and a line feed between pieces."""
    return raw.replace(b"\n", b" \n ").split(b" ")


def texts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), df[text_col].cast("string").alias("text"))


def counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, text, n) for lang, of in counts.items() for text, n in of.items()]
    langs, phrases, ns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], names=["lang", "phrase", "a"])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word) and how often it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, raw in portions(batches):
            counts[lang].update(tokens_of(raw))
            if sum(map(len, counts.values())) > COUNTED:
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    words = docs.mapInArrow(work, FOUND).where(~F.col("phrase").isin("", "\n"))
    return words.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def listing(frequent: DataFrame, most: int) -> tuple[list[tuple[str, str]], bool]:
    """The most frequent words, by falling count, at most so many; and whether these are all of them."""
    level = F.floor(F.log2("a") * 8)
    sizes = frequent.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some 500 rows at most
    total, lowest = 0, None
    for size in sizes:
        if total + size["count"] > most:
            break
        total, lowest = total + size["count"], size["level"]
    if lowest is None:
        return [], not sizes
    listed = frequent.where(level >= lowest).collect()
    return [(r.lang, r.phrase) for r in sorted(listed, key=lambda r: (-r.a, r.lang, r.phrase))], total == sum(s["count"] for s in sizes)


def numbers_of(listed: list[tuple[str, str]]) -> dict[str, dict[bytes, int]]:
    """By language: each listed word's number from 1 on; -1 for the end of a piece and -2 for no word."""
    numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: {b"\n": -1, b"": -2})
    for number, (lang, word) in enumerate(listed, 1):
        numbers[lang][word.encode()] = number
    return dict(numbers)


def numbered(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a portion, 0 for words not listed and -1 between pieces."""
    get = numbers.get
    found = np.fromiter((get(t, 0) for t in tokens_of(raw)), dtype=np.int64)
    return found[found != -2]


def suffixes_of(ids: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix of each place, of at least two listed words, as two whole numbers."""
    padded = np.concatenate([np.maximum(ids, 0), np.zeros(max_n, dtype=np.int64)])
    keys = [np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)]
    alive = np.ones(len(ids), dtype=bool)
    for k in range(max_n):
        word = padded[k : k + len(ids)]
        alive &= word > 0
        keys[k // 3] |= np.where(alive, word, 0) << (BITS * (2 - k % 3))
    kept = (keys[0] >> BITS) & ((1 << BITS) - 1) > 0
    return keys[0][kept], keys[1][kept]


def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Equal suffixes as one with a count."""
    a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a))))], names=["k1", "k2", "n"])


def suffixes(docs: DataFrame, numbers: Broadcast, max_n: int) -> DataFrame:
    """k1, k2 and n: suffixes and how often a task has found them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for lang, raw in portions(batches):
            if lang not in numbers.value:
                continue
            parts.append(suffixes_of(numbered(raw, numbers.value[lang]), max_n))
            size += len(parts[-1][0])
            if size > COMBINED:
                yield combined(parts)
                parts, size = [], 0
        if parts:
            yield combined(parts)

    return docs.mapInArrow(work, "k1 long, k2 long, n long")


def masks(length: int) -> tuple[int, int]:
    """The bits of the first ``length`` words in both numbers of a suffix."""
    bits = lambda words: ((1 << BITS * 3) - 1) ^ ((1 << BITS * (3 - words)) - 1)
    return bits(min(length, 3)), bits(max(0, length - 3))


class Stack:
    """Counts prefixes of 2 to ``max_n`` words of suffixes that come by in falling order.

    For each length the stack holds the prefix that is open, its count so far, and
    whether it was there when the range began, so that the range before may hold more of it.
    """

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.open: dict[int, tuple[int, int, int, bool]] = {}

    def push(self, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(k1, k2, count) of the prefixes that end, if they are frequent or stood on the range's border."""
        out = []
        for length in range(2, self.max_n + 1):
            m1, m2 = masks(length)
            a, b = k1 & m1, k2 & m2
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            a, b, sums = a[starts], b[starts], np.add.reduceat(n, starts)
            border = np.zeros(len(sums), dtype=bool)
            before = self.open.get(length)
            if before is None:
                border[0] = True
            elif before[:2] == (a[0], b[0]):
                sums[0] += before[2]
                border[0] = before[3]
            else:
                out += self.ended(before, length)
            ready = np.flatnonzero(border[:-1] | (sums[:-1] >= self.least))
            for row in zip(a[ready].tolist(), b[ready].tolist(), sums[ready].tolist(), border[ready].tolist(), strict=True):
                out += self.ended(row, length)
            self.open[length] = (int(a[-1]), int(b[-1]), int(sums[-1]), bool(border[-1]))
        return out

    def ended(self, row: tuple[int, int, int, bool], length: int, last: bool = False) -> list[tuple[int, int, int]]:
        last_word = (row[(length - 1) // 3] >> BITS * (2 - (length - 1) % 3)) & ((1 << BITS) - 1)
        return [row[:3]] if last_word and (last or row[3] or row[2] >= self.least) else []

    def end(self) -> list[tuple[int, int, int]]:
        return [r for length, row in self.open.items() for r in self.ended(row, length, last=True)]


def prefix_counts(found: DataFrame, listed: Broadcast, max_n: int, least: int) -> DataFrame:
    """lang, phrase and a of frequent phrases, and what a range holds of those on its borders."""

    def named(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        langs, phrases = [], []
        for k1, k2, _ in rows:
            ids = [(k >> BITS * s) & ((1 << BITS) - 1) for k in (k1, k2) for s in (2, 1, 0)]
            words = [listed.value[i - 1] for i in ids if i]
            langs.append(words[0][0])
            phrases.append(" ".join(w for _, w in words))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "phrase", "a"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held, size = Stack(max_n, least), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= STACKED:
                yield named(stack.push(*(c.to_numpy() for c in pa.Table.from_batches(held).columns)))
                held, size = [], 0
        if size:
            yield named(stack.push(*(c.to_numpy() for c in pa.Table.from_batches(held).columns)))
        yield named(stack.end())

    falling = [F.desc("k1"), F.desc("k2")]
    return found.repartitionByRange(*falling).sortWithinPartitions(*falling).mapInArrow(work, FOUND)


def other_counts(docs: DataFrame, numbers: Broadcast, max_n: int) -> DataFrame:
    """lang, phrase and a of phrases with a word that is not listed, frequent or not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, raw in portions(batches):
            words = [t for t in tokens_of(raw) if t]
            ids = numbered(raw, numbers.value.get(lang, {b"\n": -1, b"": -2}))
            ends, strange = (np.concatenate([[0], np.cumsum(x)]) for x in (ids < 0, ids == 0))
            for length in range(2, max_n + 1):
                at = np.flatnonzero((ends[length:] == ends[:-length]) & (strange[length:] > strange[:-length]))
                counts[lang].update(b" ".join(words[i : i + length]) for i in at)
            if sum(map(len, counts.values())) > COUNTED:
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    return docs.mapInArrow(work, FOUND)


def phrase_counts(docs: DataFrame, frequent: DataFrame, max_n: int, least: int, most_listed: int) -> DataFrame:
    """lang, phrase and a of all phrases of 2 to ``max_n`` words that occur ``least`` times."""
    context = docs.sparkSession.sparkContext
    listed, whole = listing(frequent, min(most_listed, (1 << BITS) - 1))
    numbers = context.broadcast(numbers_of(listed))
    found = prefix_counts(suffixes(docs, numbers, max_n), context.broadcast(listed), max_n, least)
    if not whole:
        found = found.union(other_counts(docs, numbers, max_n))
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def part(words: str, begin, length):
    return F.array_join(F.slice(words, begin, length), " ")


def scored(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds n, and l, r and score of the cut with the lowest score."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cuts = phrases.withColumns({"words": F.split("phrase", " "), "salt": salt}).join(totals, ["lang", "salt"])
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", part("words", F.lit(1), F.col("k")).alias("first"), part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"_over": (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)"), "_under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    lowest = F.min(F.struct(F.expr("_over div _under").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def not_inside(found: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Without the phrases of which a longer one, that has their words in a row, takes ``share`` percent or more of the occurrences."""
    longer = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    spans = longer.withColumn("length", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    spans = spans.withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    covered = spans.groupBy("lang", part("words", F.col("begin"), F.col("length")).alias("phrase")).agg(F.max("a").alias("most"))
    return found.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = 100, share: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases."""
    if not 2 <= max_n <= 6:
        raise ValueError("phrases have two to six words")
    docs = texts(docs, lang_col, text_col)
    words = saved(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.where(F.col("a") >= least)
    phrases = saved(phrase_counts(docs, frequent, max_n, least, most_listed))
    found = not_inside(scored(phrases, phrases.union(frequent.select("lang", "phrase", "a")), totals), phrases, share)
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # first within salted groups, so that no task ranks all of a language
    found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB: every phrase of every place, grouped.
COLLOCATION_SQL = r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT lang, m, w[i:i + m - 1] AS x FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), f AS (SELECT lang, m, x, array_to_string(x, ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 100),
u AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT u.lang, u.phrase, u.m, u.a, l.a AS l, r.a AS r, n, ((1000::HUGEINT * u.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score,
         row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY (1000::HUGEINT * u.a * n) // (l.a::HUGEINT * r.a), k) AS place
  FROM u JOIN t ON t.lang = u.lang JOIN f l ON l.lang = u.lang AND l.x = u.x[1:k] JOIN f r ON r.lang = u.lang AND r.x = u.x[k + 1:u.m]
), b AS (
  SELECT lang, array_to_string(x[i:i + j - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, x, a, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL
), z AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN b ON b.lang = s.lang AND b.phrase = s.phrase WHERE place = 1 AND (most IS NULL OR 100 * most < 100 * a)
) SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""
