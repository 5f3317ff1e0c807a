"""Token counts by rank-synchronous array merging.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; other columns are ignored. Nothing is shuffled: each task
counts the texts it reads.
"""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text
from plantlens.llm.words_bpe import count_tokens


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over ``limit``, for every row."""

    def work(rows, texts):
        return {"doc_id": rows.column(0), "n_bytes": pc.fill_null(pc.binary_length(rows.column(1)), 0).cast("int64"), "n_tokens": count_tokens(texts, vocab_path)}

    counted = by_slice(id_text(docs, id_col, text_col), "text", "doc_id long, n_bytes long, n_tokens long", work)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
