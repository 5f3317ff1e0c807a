"""Exact top-k search by inner product over tiles of queries and shards.

Vectors are turned into whole numbers, floor(256 x), so that scores are exact.
Rows are dealt into shards by a hash, the queries among them into blocks as
well. A shard goes to every block and a block to every shard, and each such tile
is one matrix product in one task, of bounded rows and bytes: with n rows, q
queries and tiles of T rows a side, about 2 n q / T rows are moved, and nothing
but the counts of rows reaches the driver. A tile selects each query's best by
partial sorting; the tiles' lists are merged FAN at a time in a tree.

Products of which single or double precision holds every step exactly (which the
largest components say beforehand) are left to it. Others are estimated with a
bound of the error, and those that may be among the best are worked out in
integers of any size.

Edge cases: vectors that are null, hold null or non-finite components, or such
that 256 times them is no double, take no part; an empty vector has the score 0
with other empty ones; vectors of different lengths do not meet. Scores beyond 64
bits count as the largest (or smallest) long. Every row is a vector of its own:
of repeated rows each is a candidate of the others, and each that is a query has
its own list. A row without id is a candidate, behind all others of its score,
but never a query. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import saved

#: Most rows and bytes on either side of a tile; rows of it that are multiplied at a time.
TILE, TILE_BYTES, STRIP = 16384, 64 << 20, 256
#: Tiles at least, as far as there are rows, so that a small table too is dealt to many tasks.
LEAST_TILES = 48
#: Lists merged into one at each level of the tree.
FAN = 16
LARGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the components, as whole numbers in bytes of doubles, of the vectors that take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0), []
            for v in batch.column(1).to_pylist():
                with np.errstate(over="ignore"):
                    a = None if v is None or None in v else np.floor(np.array(v, dtype=np.float64) * 256.0)
                raw.append(a.tobytes() if a is not None and np.isfinite(a).all() else None)
            kept = pa.array([r is not None for r in raw])
            yield pa.RecordBatch.from_arrays([ids.filter(kept), pa.array(raw, type=pa.binary()).filter(kept)], names=["vec_id", "raw"])

    return vectors.mapInArrow(work, "vec_id long, raw binary").withColumn("row", F.monotonically_increasing_id())


def chosen(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k greatest of each row; of equal ones the first."""
    n = scores.shape[1]
    if n <= k:
        return np.ones(scores.shape, dtype=bool)
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, level = scores > least, scores == least
    lacking = k - above.sum(axis=1)
    crowded = np.flatnonzero(level.sum(axis=1) > lacking)
    level[crowded] &= level[crowded].cumsum(axis=1) <= lacking[crowded, None]
    return above | level


def exact(q: np.ndarray, c: np.ndarray) -> int:
    score = sum(int(a) * int(b) for a, b in zip(q, c, strict=True))
    return max(-LARGEST, min(LARGEST, score))


def wide_scores(q: np.ndarray, c: np.ndarray, barred: np.ndarray, k: int) -> np.ndarray:
    """Scores of one query (as objects) with the candidates that may be among its k best; of all others a number below them."""
    with np.errstate(all="ignore"):
        near, slack = c @ q, (np.abs(c) @ np.abs(q)) * (len(q) + 2) * 2.0**-51
        low, high = np.nan_to_num(near - slack, nan=-np.inf), np.nan_to_num(near + slack, nan=np.inf)
    low, high = np.clip(low, -LARGEST, LARGEST), np.clip(high, -LARGEST, LARGEST)
    low[barred] = high[barred] = -np.inf
    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    out = np.full(len(c), -math.inf, dtype=object)
    for j in np.flatnonzero((high >= least) & ~barred):
        # 2.0**63 stands for the largest long
        out[j] = LARGEST if low[j] >= 2.0**63 else -LARGEST if high[j] <= -(2.0**63) else exact(q, c[j])
    return out


def tile_lists(tile: pa.Table, k: int) -> pa.Table:
    """(query_row, query_id, vec_id, score) of each query's best in a tile."""
    is_query = tile["query"].to_numpy()
    raw, ids, rows = tile["raw"].to_pylist(), tile["vec_id"], tile["row"].to_numpy()
    sizes = np.array([len(r) // 8 for r in raw])
    order = np.lexsort((rows, ids.fill_null(LARGEST).to_numpy(), ids.is_null().to_numpy()))
    found: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
    for dim in np.unique(sizes[is_query]):
        of_dim = order[sizes[order] == dim]
        queries, others = of_dim[is_query[of_dim]], of_dim[~is_query[of_dim]]
        if not len(others):
            continue
        q, c = (np.stack([np.frombuffer(raw[i], dtype=np.float64) for i in side]) for side in (queries, others))
        # a pair is narrow if no partial sum of it can pass 2**53
        limit = math.sqrt(2.0**53 / max(1, dim))
        wide_q, wide_c = (np.abs(x).max(axis=1, initial=0) > limit for x in (q, c))
        tops = [np.abs(x[~w]).max(initial=0) for x, w in ((q, wide_q), (c, wide_c))]
        kind = np.float32 if tops[0] * tops[1] * dim <= 2**24 else np.float64
        columns = np.where(wide_c[:, None], 0, c).astype(kind).T
        for i in range(0, len(queries), STRIP):
            some = slice(i, i + STRIP)
            own = rows[queries[some]][:, None] == rows[others][None, :]
            scores = np.where(wide_q[some, None], 0, q[some]).astype(kind) @ columns
            if wide_q[some].any() or wide_c.any():
                scores = scores.astype(object)
                for j in range(len(scores)):
                    if wide_q[i + j]:
                        scores[j] = wide_scores(q[i + j], c, own[j], k)
                    else:
                        scores[j, wide_c] = wide_scores(q[i + j], c[wide_c], own[j, wide_c], k)
            scores[own] = -math.inf
            r, j = np.nonzero(chosen(scores, k) & (scores != -math.inf))
            found.append((queries[some][r], others[j], [int(s) for s in scores[r, j]]))
    left = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
    right = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
    ids = ids.combine_chunks()
    return pa.table({"query_row": rows[left], "query_id": ids.take(pa.array(left)), "vec_id": ids.take(pa.array(right)), "score": pa.array([s for f in found for s in f[2]], type=pa.int64())})


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One list ``best`` per query from lists of parts 0 to parts - 1: FAN of them become one at each level."""
    while True:
        parts = -(-parts // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        lists = lists.groupBy("query_row", "query_id", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if parts == 1:
            return lists


def top_search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id is divisible by ``every``."""
    ready = saved(whole_vectors(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))))
    asks = F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False))
    n, size, n_asks = ready.agg(F.count("*"), F.coalesce(F.sum(F.length("raw")), F.lit(0)), F.count_if(asks)).first()
    tile = max(1, min(TILE, TILE_BYTES * max(1, n) // max(1, size)))
    blocks = max(1, -(-n_asks // tile))
    shards = max(-(-n // tile), min(n // 64 + 1, -(-LEAST_TILES // blocks)))
    dealt = lambda seed, parts: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    every_one = lambda parts: F.sequence(F.lit(0), F.lit(parts - 1))
    place = lambda block, shard, query: F.struct(block.alias("block"), shard.alias("part"), F.lit(query).alias("query"))
    as_candidate = F.transform(every_one(blocks), lambda b: place(b, F.col("shard"), False))
    as_query = F.transform(every_one(shards), lambda s: place(F.col("own"), s, True))
    rows = ready.withColumns({"shard": dealt(1, shards), "own": dealt(2, blocks)})
    rows = rows.select("row", "vec_id", "raw", F.explode(F.when(asks, F.concat(as_candidate, as_query)).otherwise(as_candidate)).alias("at"))
    rows = rows.select("at.block", "at.part", "at.query", "row", "vec_id", "raw")

    def work(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        lists = tile_lists(tile, k)
        return lists.append_column("part", pa.array(np.full(lists.num_rows, key[1].as_py(), dtype=np.int32)))

    found = rows.groupBy("block", "part").applyInArrow(work, "query_row long, query_id long, vec_id long, score long, part int")
    one = F.struct((-F.col("score")).alias("minus"), F.col("vec_id").isNull().alias("nameless"), "vec_id")
    lists = found.groupBy("query_row", "query_id", "part").agg(F.collect_list(one).alias("best"))
    best = merged(lists, shards, k).select("query_id", F.posexplode("best").alias("rank", "hit"))
    return best.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


#: DuckDB: all pairs of queries and rows.
TOP_SQL = """WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e)::BIGINT END AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
