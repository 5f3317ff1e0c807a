"""Jaccard join on word shingles by a grouped prefix join.

A document is the set of its distinct 5-word shingles (64-bit hashes). All sets
are sorted in one global order, frequent shingles last; two sets of similarity
t or more then share a shingle among the first ``n - ceil(t n) + 1`` of each,
their prefixes. Documents with the same size and prefix form one group, and
only groups are joined on prefix shingles.

Links are verified on whole sets (all 64 bits of each shingle's hash), in rounds.
First every group of a shingle is tried against one of them; the links found
there put most copies of a text into one component, whatever their number. Then
the same is done twice around other holders of each shingle, drawn by hash, and
at last all pairs of the same shingle that still lie in different components
are tried, so that no link between components is lost. Links within a component
would not change the result. In all rounds it is groups that hold shingles and
are paired: a pair of groups is filtered by size, position and components (and
by sketches, where each has one member), and only pairs that are left are
expanded to their members, whose components and sketches are filtered again. No filter
loses a link. Members of one group meet under a token of their own. In the last
round the holders of a shingle meet only others of about their size, and a
shingle with many is split into blocks that meet block by block, as are the
members of large groups.

A set travels to each text it is compared with; the text in the middle of a
star is sent there once, or once for every STAR others if they are many.

How frequent a shingle is, is estimated from a sixteenth of its occurrences in
all documents (drawn by hash), and the most frequent are kept in a list of
bounded length. Both only move shingles within the order: any order gives the
same links.

Edge cases: a null or wordless text has an empty set and is linked with
nothing; a text of fewer than five words has one shingle; equal texts are one
component; rows of one doc_id should be equal (else they count as copies, and
the text with the least digest stands for all); rows without id are returned without component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import NO_BROADCAST, by_slice, counted, id_text, saved, settings
from plantlens.llm.components import components, with_links
from plantlens.llm.word_hash import MULTIPLIER, mixed, word_hashes

#: One in so many occurrences is counted; shingles counted SEEN times or more are frequent, LISTED of them at most.
DRAW, SEEN, LISTED = 16, 4, 1_000_000
#: Seeds of the rounds in which a drawn holder of each token is tried against the others.
DRAWS = (1, 2)
#: Words of 64 bits in the sketch of a set.
SKETCH = 8
#: Holders of a shingle in a block of the last join; partners of a text that are compared with it in one group.
BLOCK, STAR = 2048, 4096
#: Least and most words of the filter that spares texts which no candidate needs (beyond FILTER_MOST it spares fewer), and bits of the one in front of the list of frequent shingles.
FILTER_WORDS, FILTER_MOST, LIST_BITS = 1 << 18, 1 << 23, 24


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes (uint64) of the texts in order, with repeats, and how many each text has."""
    raw = [t.encode().lower() for t in texts]
    flat, starts, _ = word_hashes(b"\n".join(raw))
    begins = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])]) if raw else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(starts, begins)
    words = np.diff(np.append(first, len(starts)))
    n = len(flat)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * MULTIPLIER + flat[j : n - k + 1 + j]
    counts = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    ends = np.cumsum(counts)
    long = np.repeat(words >= k, counts)
    inner = np.arange(len(out)) - np.repeat(ends - counts, counts) + np.repeat(first, counts)
    out[long] = rolled[inner[long]]
    for d in np.flatnonzero((words > 0) & (words < k)):
        whole = np.array([words[d]], dtype=np.uint64)
        for j in range(words[d]):
            whole = whole * MULTIPLIER + flat[first[d] + j : first[d] + j + 1]
        out[ends[d] - 1 : ends[d]] = whole
    return mixed(out), counts


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    flat, counts = shingles(texts, k)
    return [np.unique(s) for s in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


def lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64), type=pa.int64()))


def frequent(own: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles (60 bits, sorted), the level of each (binary digits of its estimated count over 64), and which leading bits occur."""

    def work(rows, texts):
        flat, counts = shingles(texts, k)
        seeds = np.array([xxhash.xxh3_64_intdigest(str(d)) for d in rows.column(0).to_pylist()], dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), counts)
        drawn = np.flatnonzero(mixed(flat ^ seeds[owner]) % np.uint64(DRAW) == 0)
        # once for each document
        drawn = drawn[np.unique(np.stack([owner[drawn].astype(np.uint64), flat[drawn]], axis=1), axis=0, return_index=True)[1]]
        return {"s": pa.array((flat[drawn] >> np.uint64(4)).astype(np.int64))}

    counted = by_slice(own, "text", "s long", work).groupBy("s").count().where(F.col("count") >= SEEN)
    top = counted.orderBy(F.desc("count"), "s").limit(LISTED).toPandas().sort_values("s")
    level = np.clip(np.log2(top["count"].to_numpy(dtype=np.float64) * DRAW / 64).astype(np.int64) + 1, 1, 15)
    names = top["s"].to_numpy(dtype=np.uint64)
    maybe = np.zeros(1 << LIST_BITS, dtype=bool)
    maybe[names >> np.uint64(60 - LIST_BITS)] = True
    return names, level.astype(np.uint8), np.packbits(maybe, bitorder="little")


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def parities(s: np.ndarray) -> np.ndarray:
    """SKETCH words of bits: whether the hashes that fall on each bit are odd in number. Sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((s & np.uint64(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(own: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest and sketch of the set, and its prefix: 60 bits of hash over 4 bits of level."""
    listed = own.sparkSession.sparkContext.broadcast(frequent(own, k))

    def work(rows, texts):
        names, levels, maybe = listed.value
        sets = shingle_sets(texts, k)
        out = []
        for s in sets:
            short = s >> np.uint64(4)
            level = np.zeros(len(s), dtype=np.uint64)
            bit = short >> np.uint64(60 - LIST_BITS)
            asked = np.flatnonzero((maybe[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            if len(asked):
                at = np.minimum(np.searchsorted(names, short[asked]), len(names) - 1)
                level[asked] = np.where(names[at] == short[asked], levels[at].astype(np.uint64), np.uint64(0))
            token = (short << np.uint64(4)) | level
            # rare ones first; the hashes of one level are in order already
            if level.any():
                token = token[np.argsort(level, kind="stable")]
            out.append(token[: prefix_size(len(s), percent)] if len(s) else token)
        return {"doc_id": rows.column(0), "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "prefix_key": [xxhash.xxh3_128_hexdigest(t.tobytes()) for t in out], "prefix": lists(out), "sketch": lists([parities(s) for s in sets])}

    found = saved(by_slice(own, "text", "doc_id long, n long, digest string, prefix_key string, prefix array<long>, sketch array<long>", work))
    listed.destroy()
    return found


def filter_size(count: int) -> int:
    """Words of 63 bits for a filter of so many ids: 16 bits for each, within bounds."""
    return min(FILTER_MOST, max(FILTER_WORDS, 1 << (count * 16 // 63).bit_length()))


def needed_sets(own: DataFrame, needed: DataFrame, count: int, k: int) -> tuple[DataFrame, Broadcast]:
    """The filter, and (node, digest, shingles as bytes) of texts whose id may be among the ``count`` nodes needed; a bit filter, sized by their number, spares most others the work."""
    size = filter_size(count)
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(size)), F.pmod(F.xxhash64(c, F.lit(1)), F.lit(63)))
    word, bit = place("node")
    bits = needed.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).select("word", F.call_function("shiftleft", F.col("one"), F.col("bit").cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(size, dtype=np.int64)
    table[bits["word"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)
    shared = own.sparkSession.sparkContext.broadcast(table)
    word, bit = place("doc_id")
    asked = own.where("doc_id is not null").select("doc_id", "text", word.alias("word"), bit.alias("bit"))

    def work(rows, texts):
        hit = (shared.value[rows.column(2).to_numpy()] >> rows.column(3).to_numpy()) & 1
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        raw = [s.tobytes() for s in shingle_sets([texts[i] for i in at], k)]
        return {"node": rows.column(0).take(pa.array(at)), "digest": [xxhash.xxh3_128_hexdigest(b) for b in raw], "shingles": pa.array(raw, type=pa.binary())}

    return by_slice(asked, "text", "node long, digest string, shingles binary", work), shared


def verified(pairs: DataFrame, own: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) of a saved table whose sets are similar enough, saved, and their number."""
    needed, count = counted(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets, shared = needed_sets(own, needed, count, k)
    sets = sets.join(needed, "node", "left_semi").groupBy("node").agg(F.min_by("shingles", "digest").alias("shingles"))
    # b travels to its place at a, and a once to each part of a
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    centres = parts.select(F.col("a").alias("node"), F.col("a").alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("other"))
    others = pairs.join(parts, "a").select(F.col("b").alias("node"), F.col("a").alias("home"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("other"))
    sent = centres.union(others).join(sets, "node").repartition("home", "part").sortWithinPartitions("home", "part", "other").select("home", "part", "other", "node", "shingles")

    def check(batches):
        now, centre = None, None
        for batch in batches:
            a, b = [], []
            for home, part, other, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                s = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if not other:
                    now, centre = (home, part), s.copy()
                    continue
                assert now == (home, part)
                if 100 * min(len(s), len(centre)) >= percent * max(len(s), len(centre)):
                    at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                    common = int((centre[at] == s).sum())
                    if 100 * common >= percent * (len(s) + len(centre) - common):
                        a.append(home)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    found, links = counted(sent.mapInArrow(check, "a long, b long"))
    shared.destroy()
    return found, links


def open_rows(shared: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(token, pos, unit, n, whole, low, high, sketch) for the tokens that more than one component holds.

    A unit is a group (``whole``: one of several members, without sketch), or a member under the token of its group.
    low and high are the least and the largest component of its members.
    """
    between = shared.select("token", "pos", F.col("gid").alias("unit"), "n", "whole")
    inside = members.where("members > 1").select(F.xxhash64("gid", F.lit("group")).alias("token"), F.lit(0).alias("pos"), F.col("node").alias("unit"), "n", F.lit(False).alias("whole"))
    rows = still_open(with_components(between.unionByName(inside), members, known))
    return saved(rows.join(members.select(F.col("node").alias("unit"), "sketch"), "unit").withColumn("sketch", F.when(~F.col("whole"), F.col("sketch"))))


def reopened(rows: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """What is left of open rows when more is known: components only grow together, so a token once closed stays so."""
    return saved(still_open(with_components(rows.drop("low", "high"), members, known)))


def with_components(rows: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the least and the largest component of each unit's members."""
    component = F.coalesce("component", "unit")
    single = rows.where("not whole").join(known.withColumnRenamed("node", "unit"), "unit", "left").select(*rows.columns, component.alias("low"), component.alias("high"))
    of_member = placed(members.where("members > 1"), known)
    of_group = of_member.groupBy(F.col("gid").alias("unit")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return single.unionByName(rows.where("whole").join(of_group, "unit").select(*single.columns))


def placed(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members with their components."""
    return members.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))


def still_open(rows: DataFrame) -> DataFrame:
    several = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("units")).where("least <> most and units > 1").select("token")
    return rows.join(several, "token", "left_semi")


def sketches_allow(percent: int) -> str:
    """Whether the sketches of x and y allow for a link; those of groups of several members are null and do."""
    differ = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(SKETCH))
    return f"coalesce((100 + {percent}) * ({differ}) <= (100 - {percent}) * (x.n + y.n), true)"


def may_link(percent: int) -> str:
    """What units x and y that share a token have to meet: members of unlike components, and sizes, places and sketches that allow for a link."""
    return (
        f"x.unit <> y.unit AND least(x.low, y.low) <> greatest(x.high, y.high) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" AND (100 + {percent}) * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n) AND {sketches_allow(percent)}"
    )


SIDES = ("named_struct('unit', x.unit, 'whole', x.whole)", "named_struct('unit', y.unit, 'whole', y.whole)")
#: A pair of units, each with whether it is a group of several members.
PAIR = (f"least({', '.join(SIDES)}) AS a", f"greatest({', '.join(SIDES)}) AS b")


def expanded(pairs: DataFrame, members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (a < b) that may link, from pairs of units: those with a group of several members are expanded, part by part of large groups."""
    pairs = saved(pairs)
    whole = F.col("a.whole") | F.col("b.whole")
    plain = pairs.where(~whole).select("a.unit", F.col("b.unit").alias("other"))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    sizes = members.where("node = gid").select("gid", parts.alias("parts"))
    own = placed(members, known).select("gid", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "n", "component", "sketch")
    dealt = pairs.where(whole).select(F.col("a.unit").alias("ga"), F.col("b.unit").alias("gb"))
    for gid, part in (("ga", "pa"), ("gb", "pb")):
        dealt = dealt.join(sizes.withColumnRenamed("gid", gid), gid).withColumn(part, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    first = dealt.join(own.withColumnsRenamed({"gid": "ga", "part": "pa"}), ["ga", "pa"])
    met = first.alias("x").join(own.alias("y"), F.expr(f"x.gb = y.gid AND x.pb = y.part AND x.component <> y.component AND {sketches_allow(percent)}"))
    found = plain.union(met.selectExpr("x.node", "y.node"))
    return found.select(F.least("unit", "other").alias("a"), F.greatest("unit", "other").alias("b")).distinct()


def pairs_with_drawn(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of units that may link, of the rows of each token with one that is drawn among them."""
    drawn = F.min_by(F.struct("pos", "unit", "n", "whole", "low", "high", "sketch"), F.xxhash64("token", "unit", F.lit(seed)))
    others = rows.groupBy("token").agg(drawn.alias("y")).select("token", "y.*")
    return rows.alias("x").join(others.alias("y"), F.expr(f"x.token = y.token AND {may_link(percent)}")).selectExpr(*PAIR).distinct()


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of units that may link, of all rows of each token.

    Rows are dealt by size, in steps so long that a link reaches the next step at
    most; a token's rows of one step are cut into blocks, and each pair of blocks
    of a step, or of a step and the next one, meets on its own.
    """
    step = max(math.log(100 / percent), 0.05) * 1.000001
    placed = rows.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    counts = placed.groupBy("token", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = counts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("blocks"))
    dealt = placed.join(blocks, "token").withColumn("mine", F.pmod(F.xxhash64("unit"), F.col("blocks")[F.col("step")]).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda low, high, i, j: F.struct(low.alias("here"), high.alias("there"), i.alias("i"), j.alias("j"))
    here, mine = F.col("step"), F.col("mine")
    count = lambda at: F.coalesce(F.try_element_at("blocks", at), F.lit(0))
    every = lambda n, make: F.transform(F.when(n > 0, upto(n)).otherwise(F.array().cast("array<int>")), make)
    # as the first of a pair: against all blocks of its own step and of the next; as the second likewise
    first = F.concat(every(count(here), lambda j: cell(here, here, mine, j)), every(count(here + 1), lambda j: cell(here, here + 1, mine, j)))
    second = F.concat(every(count(here), lambda i: cell(here, here, i, mine)), every(count(here - 1), lambda i: cell(here - 1, here, i, mine)))
    own = ("token", "pos", "unit", "n", "whole", "low", "high", "sketch")
    x, y = (dealt.select(*own, F.explode(cells).alias("cell")).select(*own, "cell.*") for cells in (first, second))
    same = " AND ".join(f"x.{c} = y.{c}" for c in ("token", "here", "there", "i", "j"))
    return x.alias("x").join(y.alias("y"), F.expr(f"{same} AND (x.here < x.there OR x.unit < y.unit) AND {may_link(percent)}")).selectExpr(*PAIR).distinct()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    with settings(docs.sparkSession, NO_BROADCAST):
        return linked(id_text(docs, id_col, text_col), k, percent)


def linked(own: DataFrame, k: int, percent: int) -> DataFrame:
    """The same for doc_id and text."""
    ready = prefixes(own, k, percent)
    full = ready.where("doc_id is not null and n > 0")
    classes = saved(full.groupBy("digest", "prefix_key", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    groups = classes.groupBy("prefix_key", "n").agg(F.min("node").alias("gid"), F.count("*").alias("members"))
    members = saved(classes.join(groups, ["prefix_key", "n"]).select("node", "gid", "n", "members", "sketch"))
    reps = full.groupBy("prefix_key", "n").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"), (F.min("digest") != F.max("digest")).alias("whole"))
    entries = reps.select("gid", "n", "whole", F.posexplode("prefix").alias("pos", "token"))
    level = F.col("token").bitwiseAND(F.lit(15))
    salt = F.pmod(F.xxhash64("gid"), F.call_function("shiftleft", F.lit(1), level.cast("int")).cast("long"))
    block = Window.partitionBy("token", "salt")
    shared = entries.withColumn("salt", F.when(level > 0, salt).otherwise(0)).withColumns({"c": F.min(F.struct("gid", "n", "pos")).over(block), "many": F.count("*").over(block)})
    shared = saved(shared.where((F.col("many") > 1) | (level > 0)).select("token", "gid", "n", "pos", "whole", "c"))

    # first round: each group against the first of its block, each member against the first of its group
    able = f"100 * least(n, c.n) >= {percent} * greatest(n, c.n) AND (100 + {percent}) * least(n - pos, c.n - c.pos) >= {percent} * (n + c.n)"
    tries = shared.where("gid <> c.gid").where(able).select(F.col("c.gid").alias("centre"), "gid").distinct().join(members.select("gid", "node"), "gid").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    tries = saved(tries.union(members.where("node <> gid").select("gid", "node")).distinct())
    known = components(verified(tries, own, k, percent)[0])

    # further rounds: what shares a token but no component, around a drawn holder of each token and then in all pairs
    tested = tries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = open_rows(shared, members, known)
    for seed in (*DRAWS, None):
        found = expanded(all_pairs(rows, percent) if seed is None else pairs_with_drawn(rows, percent, seed), members, known, percent)
        more, many = counted(found.join(tested, ["a", "b"], "left_anti"))
        if not many:
            continue
        tested = tested.union(more)
        links, many = verified(more, own, k, percent)
        # without links nothing is known that was not before, and after the last round nothing is open
        if many:
            known = with_links(known, links)
            rows = rows if seed is None else reopened(rows, members, known)
    of_digest = classes.join(known, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return ready.join(of_digest, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component with a non-empty set: that of the least id (null ids last), then the least by a hash of id and text, then by one of the whole row. Rows with an empty set all stay.

    Rows are told apart by a 64-bit hash of id and text, so rows without id are
    compared like all others, and unlike texts of one id are documents of their own.
    """
    own = id_text(docs, id_col, text_col)
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")).alias("key"))
    found = saved(ngram_join(own.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), **how))
    copies = saved(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.count("*").alias("many")))
    ids = whole.groupBy("key").agg(F.min("id").alias("id"))
    top = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "many")).alias("top")
    tops = saved(copies.join(ids, "key").groupBy("component").agg(top).select("top.key", "top.many"))
    repeated = saved(tops.where("many > 1").select("key"))
    apart = saved(copies.select("key").join(tops, "key", "left_anti").union(repeated))
    # all rows of a key have the same id and text; partial minima spare a hot key the shuffle
    least = F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")
    chosen = whole.join(repeated, "key", "left_semi").groupBy("key").agg(least)
    return whole.join(apart, "key", "left_anti").select("row.*").union(chosen.select("row.*"))
