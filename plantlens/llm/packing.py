"""Packing along a space-filling curve.

Every document becomes its token ids and a closing id. Its hashed bag of ids is
projected to three dimensions, and the place of that point on a Hilbert curve,
with a hash of doc_id and ids behind it for ties, orders the corpus. The ordered
tokens form one line that is cut every ``length`` tokens, so that neighbours on
the curve share sequences and only the last sequence is padded.

The line is cut into cells of about ``cell_tokens`` tokens, one for each task.
Where they begin is found by a range partition of places alone (a document's
place counts once for every WEIGHT of its tokens). There are at most MOST_CELLS
cells, so that what the driver and each task know of them, two numbers a cell, is
less than 2 MB at any size; beyond that the cells grow, and are sorted on disk. Where cells
begin does not change the pieces.

Edge cases: a null or empty text is its closing id alone; repeated rows are
packed one by one; equal documents follow each other in the order of hash and
id; rows without id are told apart by their ids (equal ones lie in one cell);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text, saved
from plantlens.llm.words_bpe import encode, vocab

DIMS, BITS, BUCKETS = 3, 10, 1024
#: A document weighs one for every so many tokens it begins when cells are cut.
WEIGHT = 512
#: Cells at most.
MOST_CELLS = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n x dims), by Skilling's transposition (2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def curve_places(ids: list[np.ndarray]) -> np.ndarray:
    """Place on the curve of each document's hashed bag of ids."""
    r = projection()
    bags = np.stack([np.bincount((i * 40503 >> 4) % BUCKETS, minlength=BUCKETS) for i in ids]).astype(np.float64)
    points = bags @ r / np.maximum(np.sqrt((bags * bags).sum(axis=1)), 1)[:, None]
    grid = np.linspace(-3, 3, 1 << BITS)
    even = np.array([NormalDist().cdf(g) for g in grid])
    share = np.interp(points, grid, even)
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, vocab_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (two bytes each), n and place on the curve, with a hash of the id in the low bits."""

    def work(rows, texts):
        ids = [np.append(i, end_id) for i in encode(texts, vocab_path)]
        raw = [i.astype("<u2").tobytes() for i in ids]
        place = np.concatenate([curve_places(ids[k : k + 512]) for k in range(0, len(ids), 512)])
        return {"doc_id": rows.column(0), "ids": pa.array(raw, type=pa.binary()), "n": [len(i) for i in ids], "place": place}

    found = by_slice(id_text(docs, id_col, text_col), "text", "doc_id long, ids binary, n long, place long", work)
    return found.select("doc_id", "ids", "n", (F.shiftleft("place", 32) + F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 32))).alias("at"))


def cell_bounds(ready: DataFrame, cells: int) -> np.ndarray:
    """The least place of each cell but the first, of cells of about as many tokens; equal places lie in one cell."""
    weighed = ready.select(F.explode(F.array_repeat("at", F.ceil(F.col("n") / WEIGHT).cast("int"))).alias("at"))
    ranges = weighed.repartitionByRange(cells, "at").select("at", F.spark_partition_id().alias("cell"))
    return np.sort(ranges.groupBy("cell").agg(F.min("at").alias("at")).toPandas()["at"].to_numpy(dtype=np.int64))[1:]


def pack(docs: DataFrame, vocab_path: str, length: int = 2048, end_id: int = 1, cell_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, v = docs.sparkSession, vocab(vocab_path)
    if max(int(v.width) + len(v.special), end_id + 1) > 1 << 16:
        raise ValueError("ids of this vocabulary need more than two bytes")
    ready = saved(tokenized(docs, vocab_path, end_id, id_col, text_col))
    total = ready.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = min(int(total // cell_tokens + 1), MOST_CELLS)
    bounds = cell_bounds(ready, wanted) if wanted > 1 else np.zeros(0, dtype=np.int64)
    cells = len(bounds) + 1
    shared_bounds = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def cell_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared_bounds.value, at.to_numpy(), side="right").astype(np.int32))

    dealt = ready.withColumn("cell", cell_of("at"))
    sums = dealt.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(cells, dtype=np.int64)
    held[sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(np.cumsum(held) - held)

    def lay(batches):
        now, place = None, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, raw, cell in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if cell != now:
                    now, place = cell, int(shared.value[cell])
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    size = min(length - place % length, len(ids) - start)
                    out.append((doc, start, size, zlib.crc32(ids[start : start + size]), len(ids), place // length, place % length))
                    start, place = start + size, place + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], names=[f.split()[0] for f in PIECES.split(", ")])

    ordered = dealt.repartitionById(cells, "cell").sortWithinPartitions("cell", "at", "doc_id", "n", "ids").select("doc_id", "ids", "cell")
    return ordered.mapInArrow(lay, PIECES)
