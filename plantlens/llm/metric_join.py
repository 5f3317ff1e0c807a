"""Near-duplicate vectors by an exact metric range join.

Cosine >= t between two vectors means that their unit vectors lie within
r = sqrt(2 - 2 t) of each other. Pivots cut space into cells, each vector at
home in that of its nearest pivot. By the triangle inequality a vector within r
of a cell lies at most r beyond the plane between both pivots; only such
vectors are copied into the cell, and only into cells before their own, so
that every pair within r meets in exactly one cell. Cells are joined on their
own, in blocks of bounded size.

In many dimensions a single plane parts little, so what is copied is not the vectors
but their distances to several pivots taken together: the coordinates in the span of SPAN pivots and the
length of what is left beside it. By the triangle inequality the distance of two such short
vectors never exceeds that of the whole ones. A block first finds the rows that have
a partner within r by these, NARROW coordinates first and all of them for the few pairs that are left.
Whole vectors are then sent to a block for these rows alone, and multiplied for such pairs, in double precision;
where very many are left, single precision sorts out what is clear.

Equal vectors are one class with a count. A block returns a number of links per
vector and the edges of a spanning forest of its links, so what it returns grows
with its vectors and not with its pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; all others are scaled before their norm is taken,
so none is too long or too short; vectors of different lengths do not meet.
Every row is a vector of its own and has a row in the result, repeated rows and
unlike vectors of one vec_id too. Rows without id link like others; their
component is the least id there is in it, or null, and they are not kept. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import saved
from plantlens.llm.components import components

#: Rows on either side of a block, and the most bytes they may have; rows of it that are multiplied at a time.
BLOCK, BLOCK_BYTES, STRIP = 8192, 64 << 20, 512
MOST_PIVOTS = 4096
#: Pivots whose span the short vectors lie in, and coordinates that are looked at first.
SPAN, NARROW = 32, 16
#: What rounding to single precision may change of a product of short vectors.
MARGIN = 1e-5
#: Share of a strip's pairs from which on a product of all of them costs less than one by one.
DENSE = 0.05


def classes_of(rows: DataFrame) -> DataFrame:
    """vec_id, digest of the components, dim and the components as bytes (null where the vector cannot link)."""

    def work(batches):
        for batch in batches:
            digests, dims, raw = [], [], []
            for v in batch.column(1).to_pylist():
                a = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
                ok = len(a) and np.isfinite(a).all() and a.any()
                raw.append((a + 0.0).tobytes() if ok else None)
                dims.append(len(a))
                digests.append(hashlib.sha256(raw[-1]).hexdigest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, type=pa.string()), pa.array(dims, type=pa.int64()), pa.array(raw, type=pa.binary())], names=["vec_id", "digest", "dim", "raw"])

    return rows.mapInArrow(work, "vec_id long, digest string, dim long, raw binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype=np.float64) for b in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shortened(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors as unit vectors of the span: their coordinates, and the length beside it. No product of two is less than that of the whole vectors."""
    along = x @ basis
    beside = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", along, along)))
    return np.column_stack([along, beside]).astype(np.float32)


def dealt(classes: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]], reach: float) -> DataFrame:
    """code, short, dim, cell and home: a row for the home cell and one for each cell before it that is within reach."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def work(batches):
        for batch in batches:
            at, cells, home, short = [], [], [], []
            dims = batch.column(2).to_numpy()
            raw = batch.column(1).to_pylist()
            for dim in np.unique(dims):
                (p, basis), rows = shared.value[int(dim)], np.flatnonzero(dims == dim)
                for some in np.array_split(rows, max(1, len(rows) // 2048)):
                    x = unit([raw[i] for i in some])
                    near = x @ p.T
                    own = near.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[own]
                    beyond = (near[np.arange(len(x)), own][:, None] - near) <= (reach + 1e-9) * apart + 1e-9
                    beyond &= np.arange(len(p)) < own[:, None]
                    r, c = np.nonzero(beyond)
                    at += [some, some[r]]
                    cells += [own, c]
                    home += [np.ones(len(some), dtype=bool), np.zeros(len(r), dtype=bool)]
                    told = [v.tobytes() for v in shortened(x, basis)]
                    short += [*told, *(told[i] for i in r)]
            if at:
                picked = batch.take(pa.array(np.concatenate(at)))
                columns = [picked.column(0), pa.array(short, type=pa.binary()), picked.column(2), pa.array(np.concatenate(cells), type=pa.int64()), pa.array(np.concatenate(home))]
                yield pa.RecordBatch.from_arrays(columns, names=["code", "short", "dim", "cell", "home"])

    return classes.select("code", "raw", "dim").mapInArrow(work, "code long, short binary, dim long, cell long, home boolean")


def sides_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows on the left and on the right of a block, and whether it is a chunk against itself."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0), bool((side == 2).any())


def close_strips(block: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, others, found) of a block, a strip of rows at a time: which of the others' short vectors lie within reach of those of the rows."""
    left, right, same = sides_of(block["side"].to_numpy())
    short = np.stack([np.frombuffer(b, dtype=np.float32) for b in block["short"].to_pylist()])
    narrow = np.column_stack([short[:, :NARROW], np.sqrt(np.square(short[:, NARROW:].astype(np.float64)).sum(axis=1))]).astype(np.float32)
    columns, wide = np.ascontiguousarray(narrow[right].T), np.ascontiguousarray(short[right].T)
    for k in range(0, len(left), STRIP):
        rows = left[k : k + STRIP]
        found = narrow[rows] @ columns >= least - MARGIN
        if same:
            found[np.arange(len(rows)), k + np.arange(len(rows))] = False
        if found.mean() > DENSE:
            found &= short[rows] @ wide >= least - MARGIN
        else:
            i, j = np.nonzero(found)
            found[i, j] = np.einsum("ij,ij->i", short[rows[i]], short[right[j]]) >= least - MARGIN
        yield rows, right, found


def close_rows(key: tuple[pa.Scalar, ...], block: pa.Table, least: float) -> pa.Table:
    """The rows of a block whose short vectors lie within reach of another one's."""
    near = np.zeros(block.num_rows, dtype=bool)
    for rows, others, found in close_strips(block, least):
        near[rows[found.any(axis=1)]] = True
        near[others[found.any(axis=0)]] = True
    out = block.filter(pa.array(near)).select(["code", "side", "short"])
    for name, value in zip(("dim", "cell", "kind", "i", "j"), key, strict=True):
        out = out.append_column(name, pa.array([value.as_py()] * out.num_rows, value.type))
    return out


def hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (i, j): a component's label is its least place."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def linked_in(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, others: np.ndarray, found: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among those found whose whole vectors reach ``least``, as places in rows and others."""
    if found.mean() > DENSE:
        margin = 1e-6 * math.sqrt(x.shape[1]) + 1e-6
        near = x32[rows] @ x32[others].T
        sure = found & (near >= least + margin)
        i, j = np.nonzero(found & ~sure & (near >= least - margin))
    else:
        sure = np.zeros_like(found)
        i, j = np.nonzero(found)
    sure[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[others[j]]) >= least
    return np.nonzero(sure)


def joined_block(block: pa.Table, least: float) -> pa.Table:
    """Of a block: (a, null, n) for the links of each vector, and (a, b, 0) for the edges of a spanning forest."""
    code, mult = block["code"].combine_chunks(), block["mult"].to_numpy().astype(np.float64)
    same = sides_of(block["side"].to_numpy())[2]
    x = unit(block["raw"].to_pylist())
    x32 = x.astype(np.float32)
    links, label = np.zeros(len(code)), np.arange(len(code))
    for rows, others, found in close_strips(block, least):
        i, j = linked_in(x, x32, rows, others, found, least)
        i, j = rows[i], others[j]
        links += np.bincount(i, weights=mult[j], minlength=len(code))
        if not same:
            links += np.bincount(j, weights=mult[i], minlength=len(code))
        label = hooked(label, i, j)
    has, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(code)))
    a = code.take(pa.array(np.concatenate([has, tied])))
    b = pa.concat_arrays([pa.nulls(len(has), pa.int64()), code.take(pa.array(label[tied]))])
    return pa.table({"a": a, "b": b, "n": pa.array(np.concatenate([links[has], np.zeros(len(tied))]).astype(np.int64))})


def metric_join(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    spark = vectors.sparkSession
    ready = saved(classes_of(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].alias("v"))))
    valid = ready.where("digest is not null")
    classes = valid.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("raw").alias("raw"), F.first("dim").alias("dim"))
    classes = saved(classes.withColumn("code", F.monotonically_increasing_id()))
    pivots = {}
    for dim, n in classes.groupBy("dim").count().collect():
        cells = max(1, min(MOST_PIVOTS, n // BLOCK))
        some = classes.where(F.col("dim") == dim).orderBy("digest").limit(max(cells, SPAN)).select("raw").collect()
        points = unit([bytes(r[0]) for r in some])
        pivots[dim] = points[:cells], np.linalg.qr(points[: min(SPAN, dim)].T)[0]
    placed = saved(dealt(classes, pivots, math.sqrt(max(0.0, 2 - 2 * least))))
    # at most MOST_PIVOTS rows of a length reach the driver
    sizes = placed.groupBy("dim", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 8))))
    sizes = sizes.withColumns({"h": F.ceil(F.col("homes") / rows).cast("int"), "g": F.ceil(F.col("guests") / rows).cast("int")})
    chunked = placed.join(F.broadcast(sizes.select("dim", "cell", "h", "g")), ["dim", "cell"])
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("code", F.lit(5)), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int"))
    # a home chunk meets itself (side 2), the home chunks before (1) and behind (0) it, and every guest chunk; a guest chunk every home chunk
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = F.array(block("h", F.col("chunk"), F.col("chunk"), 2))
    span = lambda low, high, make: F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), make)
    before = span(F.lit(0), F.col("chunk") - 1, lambda i: block("h", i, F.col("chunk"), 1))
    behind = span(F.col("chunk") + 1, F.col("h") - 1, lambda j: block("h", F.col("chunk"), j, 0))
    guests = span(F.lit(0), F.col("g") - 1, lambda j: block("g", F.col("chunk"), j, 0))
    homes = span(F.lit(0), F.col("h") - 1, lambda i: block("g", i, F.col("chunk"), 1))
    blocks = chunked.withColumn("to", F.explode(F.when(F.col("home"), F.concat(own, before, behind, guests)).otherwise(homes)))
    at = ["dim", "cell", "kind", "i", "j"]
    blocks = blocks.select("dim", "cell", "to.kind", "to.i", "to.j", "to.side", "code", "short")
    close = blocks.groupBy(*at).applyInArrow(lambda key, block: close_rows(key, block, least), "code long, side int, short binary, dim long, cell long, kind string, i int, j int")
    whole = saved(close).join(classes.select("code", "mult", "raw"), "code")
    found = saved(whole.groupBy(*at).applyInArrow(lambda block: joined_block(block, least), "a long, b long, n long"))
    known = components(found.where("b is not null").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("code")).agg(F.sum("n").alias("n"))
    of_code = classes.select("code", "digest", "least", "mult").join(counts, "code", "left").join(known.withColumnRenamed("node", "code"), "code", "left")
    of_digest = saved(of_code.select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "code").alias("component")))
    names = of_digest.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = ready.drop("raw").join(of_digest.join(names, "component").drop("least"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
