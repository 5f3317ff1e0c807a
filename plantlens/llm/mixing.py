"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's weight changes linearly over training time t in [0, 1]: it is
``1 + slope * (2 t - 1)`` times its mean weight. The integral of that schedule
gives the tokens demanded of the source up to t; turned round, it gives the
training position at which a document, standing at a place of its source's
line of words, is due. Documents stand in the order of a hash of doc_id.

A source whose target is more than its size is passed through again; the last
pass stops at the word that meets the target.

The mix is worked out on ids and sizes alone. ``mixed_documents`` joins the
documents to it once, by a 128-bit hash of the row, and lays them out in
stretches of training time of ``part_words`` words each: the words demanded of
all sources up to a time are a polynomial in it, so no sample is needed.

Edge cases: a null text has size 0, is never taken and has no position; a null
source is a source of its own, after all others; null ids count as ''; repeated
rows are documents of their own; an empty table gives no rows; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import n_words, saved

#: Leading hex digits of the order hash that part a source's line into stretches (4096), each summed on its own.
STRETCH = 3
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """skey, source_size, weight number and target for rows (skey, size); a row per source, so one small window."""
    sums = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("nth", F.row_number().over(Window.orderBy("skey")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    # fill from the source that first reaches its cap; the level is that of the first one left below its own
    line = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = ranked.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"),
        F.row_number().over(line).alias("rank"),
    )
    open_rank = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("rank"))).over(whole)
    level = level.withColumn("open", open_rank)
    common = F.max(F.when(F.col("rank") == F.col("open"), F.col("level"))).over(whole)
    return level.withColumn("target", F.when(F.col("rank") < F.col("open"), F.col("cap").cast("double")).otherwise(common * F.col("weight"))).select("skey", "source_size", "nth", "target")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), slopes: Sequence[float] = SLOPES, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """row (the document, or its columns in ``keep``), size, source_size, target, before (words of its source in front of it), taken, slope and number of its source."""
    lined = docs.select(
        F.struct(*(docs[c] for c in keep or docs.columns)).alias("row"),
        n_words(f"`{text_col}`").alias("size"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("t")).alias("skey"),
        F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")).alias("order"),
    ).withColumn("stretch", F.substring("order", 1, STRETCH))
    sums = lined.groupBy("skey", "stretch").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, most)
    ahead = Window.partitionBy("skey").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size").join(targets, "skey")
    line = Window.partitionBy("skey", "stretch").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = lined.join(base, ["skey", "stretch"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    goal = F.round("target").cast("long")
    passes = F.coalesce(F.try_divide(goal - goal % F.when(F.col("source_size") > 0, F.col("source_size")), "source_size").cast("long"), F.lit(0))
    rest = goal - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("nth") % len(slopes) + 1).cast("int"))
    return placed.select("row", "order", "size", "source_size", "target", "before", taken.cast("long").alias("taken"), slope.alias("slope"), "nth")


def position(copy) -> "Column":
    """Training time at which a document's n-th copy (from 0) is half consumed: the schedule's integral turned round."""
    share = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("before") + F.col("size") / F.lit(2.0)) / F.col("target"))
    a = F.lit(1.0) - F.col("slope")
    return F.when(F.col("taken") > 0, F.lit(2.0) * share / (a + F.sqrt(a * a + F.lit(4.0) * F.col("slope") * share)))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document, in training order: doc_id, size, source_size, target, taken and the first copy's position."""
    id_col = how.get("id_col", "doc_id")
    return mix_plan(docs, keep=[id_col], **how).select(F.col(f"row.`{id_col}`").alias("doc_id"), "size", "source_size", "target", "taken", position(F.lit(0)).alias("position")).orderBy("position", "doc_id", "size")


def row_key(docs: DataFrame) -> tuple:
    """Two hashes of a whole row, which also tell apart where its nulls are."""
    nulls = F.concat(*(F.when(docs[c].isNull(), "n").otherwise("v") for c in docs.columns))
    return tuple(F.xxhash64(F.lit(seed), nulls, *(docs[c] for c in docs.columns)) for seed in (1, 2))


def mixed_documents(docs: DataFrame, part_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself, in training order, with the columns of ``docs``: a row for each pass that takes a document.

    The pass that stops inside a document (one of each source at most) takes its first words, joined by blanks.
    """
    k1, k2 = row_key(docs)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"), k1.alias("k1"), k2.alias("k2"))
    plan = mix_plan(slim, keep=["k1", "k2"], **how).where("taken > 0")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil((F.col("taken") - F.col("size")) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    chosen = saved(copies.select("row.k1", "row.k2", "order", "copy", "size", words.alias("words"), position(F.col("copy")).alias("due"), "nth", "target", "slope"))
    sources = chosen.select("nth", "target", "slope").distinct().agg(F.sum(F.col("target") * (1 - F.col("slope"))).alias("a"), F.sum(F.col("target") * F.col("slope")).alias("b"))
    total, a, b = (v or 0 for v in (*chosen.agg(F.sum("words")).first(), *sources.first()))
    parts = int(total // part_words) + 1
    share = (F.lit(float(a)) * F.col("due") + F.lit(float(b)) * F.col("due") * F.col("due")) / F.lit(float(a + b) or 1.0)
    dated = chosen.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("int"))
    # repeated rows are one row here: each of their places in the plan takes it
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), k1.alias("k1"), k2.alias("k2")).dropDuplicates(["k1", "k2"])
    text = F.col(f"row.`{text_col}`")
    short = F.array_join(F.slice(F.expr(f"regexp_extract_all(row.`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"), F.lit(1), F.col("words").cast("int")), " ")
    cut = dated.join(whole, ["k1", "k2"]).withColumn("cut", F.when(F.col("words") < F.col("size"), short).otherwise(text))
    fields = []
    for f in docs.schema.fields:
        col = F.col(f"row.`{f.name}`")
        if f.name == text_col:
            col = F.col("cut")
        elif f.name == chars_col:
            col = F.when(F.col("words") < F.col("size"), F.length("cut").cast(f.dataType)).otherwise(col)
        fields.append(col.alias(f.name))
    laid = cut.select("part", "due", "order", "copy", F.struct(*fields).alias("row"))
    return laid.repartitionById(parts, "part").sortWithinPartitions("due", "order", "copy").select("row.*")


#: DuckDB twin of ``mix(documents)`` with the defaults.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce('s' || source, 't') AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY skey) - 1)::BIGINT AS nth FROM d GROUP BY skey
), w AS (
  SELECT *, nth % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, skey) AS rank
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, min(CASE WHEN level <= cap::DOUBLE / weight THEN rank END) OVER () AS open FROM l
), t AS (
  SELECT *, CASE WHEN rank < open THEN cap::DOUBLE ELSE max(CASE WHEN rank = open THEN level END) OVER () * weight END AS target FROM o
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, nth,
         coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         round(t.target)::BIGINT AS goal
  FROM d JOIN t USING (skey)
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p
), k AS (
  SELECT *, (passes * size + greatest(0, least(size, goal - passes * source_size - before)))::BIGINT AS taken,
         least(1.0::DOUBLE, (before + size / 2.0::DOUBLE) / target) AS share,
         CASE nth % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM q
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN 2.0::DOUBLE * share / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * share)) END AS position
FROM k
"""
