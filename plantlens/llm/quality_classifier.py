"""Quality by hierarchical empirical Bayes.

A logistic classifier over document statistics gives each document's evidence.
Summed by path and by host, the evidence gives their rates of good documents;
each is shrunk toward the level above (path to host, host to all) with a
strength that the spread of the rates themselves suggests (method of moments).
A document's posterior adds its own evidence to the prior of its path, from
which its own part is taken out first.

Documents carry no URL: by default ``source`` stands for the host and ``lang``
for the path; ``host_col`` and ``path_col`` name others.

Bound: the classifier is fitted on at most ``sample`` labelled rows; evidence,
sums and posteriors cover all rows. Evidence is summed in whole millionths, so
that the order of rows does not matter.

Edge cases: a null host or path is a site of its own; a null or empty text has
the evidence of an empty one; sites with one document fall back on the level
above; repeated rows are documents of their own; without labels of both kinds
all evidence is the prior 0.5; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, saved
from plantlens.llm.doc_stats import statistics_of
from plantlens.llm.quality_rules import labelled_features

ONE = 1_000_000
#: Sites are broadcast up to so many; beyond, rows and sites are dealt over SALTS parts of each site, so that no site is one task's.
MOST_BROADCAST, SALTS = 200_000, 32


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self.expand(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ self.w))
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(self.w))
            self.w -= np.linalg.solve(hess, z.T @ (p - y) + ridge * self.w)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.w, -12, 12)))


def strength(groups: DataFrame) -> float:
    """Pseudo-documents of the prior: what the spread of rates between groups (n, good) leaves over chance."""
    n, mean, between, inverse = groups.agg(F.count("*"), F.sum("good") / F.sum("n") / ONE, F.var_samp(F.col("good") / F.col("n") / ONE), F.avg(1 / F.col("n"))).first()
    if not n or n < 2 or between is None:
        return 10.0
    chance = mean * (1 - mean)
    spread = max(between - chance * inverse, 1e-6)
    return float(np.clip(chance / spread - 1, 1.0, 10_000.0))


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and kept, for every row."""
    x, y = labelled_features(docs, labels, sample, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(Logistic(x, y) if len(set(y)) == 2 else None)

    def work(rows, texts):
        model = shared.value
        p = model(statistics_of(texts)[1]) if model else np.full(len(texts), 0.5)
        return {"doc_id": rows.column(0), "host": rows.column(2), "path": rows.column(3), "good": np.rint(p * ONE).astype(np.int64)}

    site = lambda c: F.coalesce(F.concat(F.lit("s"), docs[c].cast("string")), F.lit("n"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), site(host_col).alias("host"), site(path_col).alias("path"))
    evidence = saved(by_slice(rows, "text", "doc_id long, host string, path string, good long", work))
    paths = saved(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (good + ONE) / (n + 2) / ONE if n else 0.5
    m_host, m_path = strength(hosts), strength(paths)
    shrunk = hosts.select("host", ((F.col("good") / ONE + m_host * overall) / (F.col("n") + m_host)).alias("host_posterior"))
    sites = paths.join(shrunk, "host").withColumnsRenamed({"good": "path_good", "n": "path_n"})
    own = F.col("good") / ONE
    rest = (F.col("path_good") / ONE - own + m_path * F.col("host_posterior")) / (F.col("path_n") - 1 + m_path)
    prior = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), rest))
    sure = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), own))
    odds = lambda p: F.log(p / (1 - p))
    logit = odds(sure) - odds(F.lit(overall)) + odds(prior)
    if paths.count() <= MOST_BROADCAST:
        met = evidence.join(F.broadcast(sites), ["host", "path"])
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = evidence.withColumn("salt", F.pmod(F.xxhash64("doc_id", "good"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    joined = met.select("doc_id", own.alias("evidence"), "host_posterior", prior.alias("path_posterior"), (1 / (1 + F.exp(-logit))).alias("score"))
    return joined.withColumn("kept", F.col("score") >= threshold)
