"""Quality rules: a hard base rule, then gradient-boosted trees over document statistics.

The trees are grown in numpy on histograms with monotonic constraints (more
symbols, repeats, duplicate lines or capitals never raise the verdict) and are
flattened into node arrays, over which a whole batch of documents walks at once.

Bound: the trees are fitted on at most ``sample`` labelled rows, taken in the
order of a hash of doc_id; statistics and verdicts cover all rows.

Edge cases: a null, empty or wordless text has zero counts and fails the base
rule; repeated rows are judged one by one; without labels of both kinds the
base rule alone decides. A labelled row whose id has several labels is good if
one of them says so; of several texts of one id the first in order of code
points is fitted. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text
from plantlens.llm.doc_stats import BASE, FEATURES, statistics_of


@dataclass
class Trees:
    """All nodes of all trees; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values of each row over all trees."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0/1 with logistic loss; ``signs`` constrain the features."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    raw = np.full(len(y), base)

    def node(v: float) -> int:
        k = len(value)
        for where, what in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            where.append(what)
        return k

    def split(k: int, at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        gain_best, best = 1e-6, None
        gs, hs = g[at].sum(), h[at].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[at, f], weights=g[at], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[at, f], weights=h[at], minlength=len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[at, f], minlength=len(c) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2)
            ok = (nl >= least) & (len(at) - nl >= least) & (signs[f] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            j = int(gain.argmax())
            if gain[j] > gain_best + base_gain(gs, hs, low, high):
                gain_best, best = gain[j] - base_gain(gs, hs, low, high), (f, j, vl[j], vr[j])
        if best is None or level == depth:
            raw[at] += rate * value[k]
            value[k] *= rate
            return
        f, j, vl, vr = best
        goes = binned[at, f] <= j
        feature[k], threshold[k], left[k], right[k] = f, cuts[f][j], node(vl), node(vr)
        middle = (vl + vr) / 2
        lower, upper = (low, middle), (middle, high)
        bounds = {0: ((low, high), (low, high)), 1: (lower, upper), -1: (upper, lower)}[signs[f]]
        split(left[k], at[goes], g, h, level + 1, *bounds[0])
        split(right[k], at[~goes], g, h, level + 1, *bounds[1])

    def base_gain(gs: float, hs: float, low: float, high: float) -> float:
        v = float(np.clip(-gs / (hs + ridge), low, high))
        return -(gs * v + 0.5 * (hs + ridge) * v**2)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = node(float(-g.sum() / (h.sum() + ridge)))
        roots.append(root)
        split(root, np.arange(len(y)), g, h, 0, -np.inf, np.inf)
    roots.append(node(base))
    return Trees(np.array(roots), np.array(feature), np.array(threshold, dtype=np.float64), np.array(left), np.array(right), np.array(value), depth)


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled rows."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("truth")).where(F.col("doc_id").isNotNull() & F.col("truth").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("truth").alias("truth")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").groupBy("doc_id", "truth").agg(F.min("text").alias("text")).select("doc_id", "text", "truth")
    found = by_slice(rows, "text", "doc_id long, truth int, x array<double>", lambda r, texts: {"doc_id": r.column(0), "truth": r.column(2), "x": statistics_of(texts)[1].tolist()})
    got = sorted(found.collect(), key=lambda r: r[0])
    return np.array([r[2] for r in got], dtype=np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], dtype=np.float64)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the base counts, base_failed, the trees' score and kept, for every row."""
    x, y = labelled_features(docs, labels, sample, id_col, text_col, label_col)
    trees = grow(x, y, list(FEATURES.values())) if len(set(y)) == 2 else None
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(rows, texts):
        base, features = statistics_of(texts)
        raw = shared.value.score(features) if shared.value is not None else np.full(len(texts), np.inf)
        return {"doc_id": rows.column(0), "score": 1 / (1 + np.exp(-raw))} | {n: base[:, k] for k, n in enumerate(BASE)}

    found = by_slice(id_text(docs, id_col, text_col), "text", "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", score double", work)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
