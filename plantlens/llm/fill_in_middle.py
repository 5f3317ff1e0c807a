"""Fill-in-the-middle texts from an index of distinct texts.

Texts are grouped by their content: the engine compares the texts themselves, and
a digest only names the group. For each distinct text the list of its code points'
boundaries is made once, as an Elias-Fano list (see :mod:`elias_fano`), and written
to the shared folder. Documents meet the list of their text by the digest, by a
second hash and by the length; each then selects its own two cuts, which are drawn
by a hash of its id, and its pieces are cut at bytes, without another pass over
the text's code points.

A text that very many documents share is a hot key of that join. The index says
how many documents each text has; lists of texts with more than a share of all
rows are written out several times, and their documents are dealt over the copies.
There are at most HOT_TEXTS such texts, so their digests are broadcast.

Edge cases: a null text counts as empty; an empty text, or one that holds one of
the signs, is left plain. A null id draws its cuts from an empty number. Repeated
rows have a row each. Lengths are in code points, cuts never part one. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text, saved
from plantlens.llm.elias_fano import Boundaries

# The signs in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents out of a hundred that are left plain at least, and of the others the share with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Documents that share a text before it counts as hot, and the most texts that are hot.
HOT, HOT_TEXTS = 64, 20_000
LISTS = "digest binary, other long, n_bytes long, n_docs long, n long, low_bits int, low binary, high binary, ones binary"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what the text is found by: digest, another hash, and the number of bytes."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("other"), F.octet_length("text").cast("long").alias("n_bytes"))


def text_index(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: its names, its number of documents, and the list of its boundaries."""
    groups = named(docs).groupBy("digest", "other", "n_bytes", "text").agg(F.count("*").alias("n_docs"))

    def work(rows: pa.RecordBatch, texts: list[str]) -> dict:
        lists = [Boundaries.of(t.encode()) for t in texts]
        parts = {name: [getattr(x, name) for x in lists] for name in ("n", "low_bits", "low", "high", "ones")}
        return {name: rows.column(name) for name in ("digest", "other", "n_bytes", "n_docs")} | parts

    return saved(by_slice(groups, "text", LISTS, work))


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def rearranged(text: bytes, bounds: Boundaries, h: list[int]) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the text in that form."""
    if not text or h[2] % 100 >= 100 - PLAIN or any(sign.encode() in text for sign in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    first, second = sorted(x % (bounds.n + 1) for x in h[:2])
    i, j = bounds.select(first), bounds.select(second)
    prefix, suffix = PREFIX.encode() + text[:i], SUFFIX.encode() + text[j:]
    turned = h[3] % 100 < SUFFIX_FIRST
    parts = [suffix, prefix] if turned else [prefix, suffix]
    return "spm" if turned else "psm", first, second - first, b"".join([*parts, MIDDLE.encode(), text[i:j]])


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output: each document in its form."""
    docs = id_text(docs, id_col, text_col)
    index = text_index(docs)
    n_docs = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    most = max(HOT, -(-n_docs // HOT_TEXTS))
    copies = F.ceil(F.col("n_docs") / most).cast("long")
    keys = ["digest", "other", "n_bytes"]
    # more than `most` documents each: fewer than HOT_TEXTS rows
    hot = index.where(F.col("n_docs") > most).select(*keys, copies.alias("copies"))
    lists = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n_docs")
    # the place of a row in its part of the table, so that repeated ids are dealt as well
    rows = named(docs).withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("copy", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod("place", "copies")).cast("long"))
    found = rows.select(*keys, "copy", "doc_id", "text").join(lists, [*keys, "copy"]).select("doc_id", "text", "n", "low_bits", "low", "high", "ones")

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        ids = batch.column("doc_id").to_pylist()
        bounds = zip(*(batch.column(name).to_pylist() for name in ("n", "low_bits", "low", "high", "ones")), strict=True)
        made = [rearranged(t.encode(), Boundaries(*b), drawn(i, seed)) for i, t, b in zip(ids, texts, bounds, strict=True)]
        forms, prefixes, middles, outputs = zip(*made, strict=True)
        return {"doc_id": batch.column("doc_id"), "n": batch.column("n"), "form": forms, "prefix_chars": prefixes, "middle_chars": middles, "output": pa.array(outputs, pa.binary()).cast(pa.string())}

    return by_slice(found, "text", "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", work)


def restored(form: Column, output: Column) -> Column:
    """The document's text from its form and output alone: no sign begins inside a text that is not plain."""
    one = F.lit(len(PREFIX))
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    front, back = F.substr(output, one + 1, second - one - 1), F.substr(output, second + one, third - second - one)
    middle = F.substr(output, third + one)
    return F.when(form == "plain", output).when(form == "psm", F.concat(front, middle, back)).otherwise(F.concat(back, middle, front))


def digests(docs: DataFrame) -> DataFrame:
    """Each document's form and cuts, with hashes of its output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


#: DuckDB: cuts by code points, from the same hashes.
FIM_SQL = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), x AS (SELECT *, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT for k in range(4)] AS r FROM d),
c AS (
  SELECT doc_id, t, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS i, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS j,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, i) || '<S>' || substring(t, j + 1) || '<M>' || substring(t, i + 1, j - i)
    ELSE '<S>' || substring(t, j + 1) || '<P>' || substring(t, 1, i) || '<M>' || substring(t, i + 1, j - i) END AS output FROM c
) SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
