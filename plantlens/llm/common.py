"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plantlens.sources.scratch import NO_BROADCAST, counted, saved, settings, shared_dir  # noqa: F401

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to numpy in slices of about this many characters, whatever the size of the Arrow batch.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters; a longer text has a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def by_slice(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch, list[str]], dict | None]) -> DataFrame:
    """``mapInArrow`` with ``work(rows, texts)`` called on slices of bounded size; a null text is handed over as ''."""
    kinds = StructType.fromDDL(schema)
    out = to_arrow_schema(kinds)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # column by column, as clashing names are allowed
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for i, j in slices(texts):
                got = work(batch.slice(i, j - i), texts[i:j])
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], (pa.Array, pa.ChunkedArray)) else got[f.name] for f in out], schema=out)

    return df.mapInArrow(run, kinds)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs; extra columns, whatever their names, do not reach it."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def n_words(text) -> "Column":
    """Number of words of a text, 0 for null; stays inside generated JVM code."""
    return F.coalesce(F.size(F.expr(f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")), F.lit(0)).cast("long")


def rewritten(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` that keeps the columns: ``work(rows, texts)`` returns rows of the same schema, for slices of bounded size."""
    kinds, out, at = df.schema, to_arrow_schema(df.schema), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for i, j in slices(texts):
                got = work(batch.slice(i, j - i), texts[i:j])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(got.columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, kinds)
