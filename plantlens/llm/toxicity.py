"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of its own vector (for words known from training) and
the mean of the vectors of its character n-grams (hashed, so that unseen words
have one too); a run of over 40 letters is several words, which overlap. Two gated recurrent units read a window of words from both
ends, attention pools their states, and a logistic unit scores the window. A
document's score is that of its worst window; windows overlap by half and
cover the whole text.

Training: labels are of documents, not of windows, so it starts on short
documents and then repeats: score every window of the sample, keep the worst
ones of each document, fit on those (multiple-instance learning).

Bounds: ``n_pos`` toxic and ``n_neg`` other labelled rows are drawn by a hash
of the id; those of more than ``train_chars`` characters are then left out, so
somewhat fewer may be fitted. The vocabulary holds ``vocab_size`` words. The
sample is fitted in one task, which saves the network (a few megabytes).
Scoring has no bound.

Edge cases: a null, empty or wordless text is scored as one empty window; a
document without id is scored, and is not held out; repeated rows are scored
one by one; without labels of both kinds every score is 0. A training row whose
id has several labels counts as toxic if one of them says so; of several texts
of one id the first in order of code points is fitted. An empty table gives no
rows; other columns do not reach the network.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import by_slice, id_text, rewritten, saved

LETTERS = re.compile(r"[^\W\d_]+")
#: A longer run of letters is read as several words of so many letters, each starting STEP behind the one before.
LONGEST, STEP = 40, 20
#: Words of a window, and how far the next one starts behind it.
WINDOW, STRIDE = 32, 16
DIM, HID, ATT, GRAMS = 16, 8, 8, 1 << 14
#: Distinct words remembered by a Python worker while scoring, and how many new ones are worked out at a time.
REMEMBERED, PORTION = 150_000, 4096


def words_of(text: str) -> list[str]:
    """The runs of letters in lower case; runs over LONGEST letters in overlapping pieces, so that no letter goes unread."""
    found = LETTERS.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, max(len(w) - LONGEST + STEP, 1), STEP)]


def grams(word: str) -> list[int]:
    """Hashed character trigrams, and the beginnings and endings of up to six letters."""
    w = f"<{word}>"
    pieces = [w[i : i + 3] for i in range(len(w) - 2)] + [w[:k] for k in (4, 5, 6) if k < len(w)] + [w[-k:] for k in (4, 5) if k < len(w)]
    return [zlib.crc32(p.encode()) & (GRAMS - 1) for p in pieces or [w]]


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the place of the first word in the joined words of documents, how many words it has, and the document."""
    sizes = np.asarray(counts, dtype=np.int64)
    per = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), per)
    skipped = STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    return (np.cumsum(sizes) - sizes)[doc] + skipped, np.minimum(WINDOW, sizes[doc] - skipped).astype(np.int8), doc


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (n x WINDOW) of some windows and which of them are real."""
    inner = np.arange(WINDOW)
    real = inner < sizes[:, None]
    return flat[np.where(real, starts[:, None] + inner, 0)], real


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """All weights; ``vocab`` maps known words to rows of ``words`` (row 0: unknown, stays 0)."""

    vocab: dict[str, int]
    words: np.ndarray
    grams: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, vocab: dict[str, int], seed: int) -> Net:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        dense = {}
        for way in ("f", "b"):
            dense |= {f"W{way}": normal(DIM, 3 * HID, scale=0.3), f"U{way}": normal(HID, 3 * HID, scale=0.3), f"c{way}": np.zeros(3 * HID, dtype=np.float32)}
        dense |= {"A": normal(2 * HID, ATT, scale=0.3), "a": np.zeros(ATT, dtype=np.float32), "v": normal(ATT, scale=0.5), "o": normal(2 * HID, scale=0.5), "k": np.full(1, -1.0, dtype=np.float32)}
        words = normal(len(vocab) + 1, DIM, scale=0.05)
        words[0] = 0
        return cls(vocab, words, normal(GRAMS, DIM, scale=0.1), dense)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of distinct words; their vocabulary rows; all n-grams; and the word of each n-gram."""
        rows = np.fromiter((self.vocab.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        lists = [grams(w) for w in words]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(words))
        flat = np.fromiter((g for gs in lists for g in gs), dtype=np.int64, count=int(sizes.sum()))
        return self.mixed(rows, flat, sizes), rows, flat, sizes

    def mixed(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, DIM), dtype=np.float32)
        return self.words[rows] + np.add.reduceat(self.grams[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the words add to the gates of both directions (n x 6 HID)."""
        d = self.dense
        return np.hstack([x @ d["Wf"] + d["cf"], x @ d["Wb"] + d["cb"]])

    def gru(self, way: str, gx: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T x n x HID) over gate inputs (T x n x 3 HID); where a step is no word the state stays."""
        u = self.dense[f"U{way}"]
        steps = range(len(gx)) if way == "f" else range(len(gx) - 1, -1, -1)
        h = np.zeros((gx.shape[1], HID), dtype=np.float32)
        out = np.empty((len(gx), gx.shape[1], HID), dtype=np.float32)
        for t in steps:
            g, hu, m = gx[t], h @ u, real[t]
            zr = sigmoid(g[:, : 2 * HID] + hu[:, : 2 * HID])
            z, r = zr[:, :HID], zr[:, HID:]
            n = np.tanh(g[:, 2 * HID :] + r * hu[:, 2 * HID :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, hu[:, 2 * HID :], z, r, n))
            h = new if m.all() else np.where(m[:, None], new, h)
            out[t] = h
        return out

    def forward(self, table: np.ndarray, ids: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: ``table`` has the projected words, ``ids`` (n x T) their rows."""
        d, ids, mask = self.dense, ids.T, real.T
        kf, kb = ([], []) if keep is not None else (None, None)
        gates = table[ids]
        h = np.concatenate([self.gru("f", gates[..., : 3 * HID], mask, kf), self.gru("b", gates[..., 3 * HID :], mask, kb)], axis=2)
        e = np.tanh(h @ d["A"] + d["a"])
        s = np.where(mask, e @ d["v"], np.float32(-30))
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[..., None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "h": h, "e": e, "w": w, "pooled": pooled, "mask": mask}
        return pooled @ d["o"] + d["k"][0]

    def backward(self, keep: dict, delta: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the gate inputs (T x n x 6 HID), for the logits' gradient."""
        d, h, e, w, mask = self.dense, keep["h"], keep["e"], keep["w"], keep["mask"]
        grads = {"o": keep["pooled"].T @ delta, "k": np.array([delta.sum()], dtype=np.float32)}
        dpool = delta[:, None] * d["o"]
        dw = (h * dpool).sum(axis=2)
        ds = np.where(mask, w * (dw - (w * dw).sum(axis=0)), 0)
        de = ds[..., None] * d["v"] * (1 - e * e)
        grads |= {"v": np.einsum("tn,tna->a", ds, e), "A": np.einsum("tnh,tna->ha", h, de), "a": de.sum(axis=(0, 1))}
        dh = w[..., None] * dpool + de @ d["A"].T
        dgates = []
        for k, way in enumerate(("f", "b")):
            u, own = d[f"U{way}"], dh[..., k * HID : (k + 1) * HID]
            du, carry, dg = np.zeros_like(u), np.zeros_like(own[0]), np.zeros((*own.shape[:2], 3 * HID), dtype=np.float32)
            for t, before, hn, z, r, n in reversed(keep[way]):
                m = mask[t][:, None]
                total = own[t] + carry
                new = np.where(m, total, 0)
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dhu
                carry = np.where(m, new * z + dhu @ u.T, total)
            grads[f"U{way}"] = du
            dgates.append(dg)
        return grads, np.concatenate(dgates, axis=2)


class Trainer:
    """Adam on the dense weights, Adagrad on the rows of the two tables that a batch touches."""

    def __init__(self, net: Net, rate: float = 0.01, row_rate: float = 0.1):
        self.net, self.rate, self.row_rate, self.n = net, rate, row_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.seen = {"words": np.full(len(net.words), 1e-4, dtype=np.float32), "grams": np.full(GRAMS, 1e-4, dtype=np.float32)}

    def rows(self, name: str, at: np.ndarray, grads: np.ndarray) -> None:
        rows, back = np.unique(at, return_inverse=True)
        total = np.zeros((len(rows), DIM), dtype=np.float32)
        np.add.at(total, back, grads)
        self.seen[name][rows] += (total * total).mean(axis=1)
        getattr(self.net, name)[rows] -= self.row_rate * total / np.sqrt(self.seen[name][rows])[:, None]

    def step(self, bag: "Bag", ids: np.ndarray, real: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        net, d = self.net, self.net.dense
        used, back = np.unique(ids, return_inverse=True)
        x = net.mixed(*(parts := bag.take(used)))
        keep: dict = {}
        logit = net.forward(net.projected(x), back.reshape(ids.shape), real, keep)
        delta = ((sigmoid(logit) - truth) * weight / len(truth)).astype(np.float32)
        grads, dg = net.backward(keep, delta)
        flat, at = dg.reshape(-1, 6 * HID), back.reshape(ids.shape).T.ravel()
        per_word = np.zeros((len(used), 6 * HID), dtype=np.float32)
        np.add.at(per_word, at, flat)
        f, b = per_word[:, : 3 * HID], per_word[:, 3 * HID :]
        grads |= {"Wf": x.T @ f, "Wb": x.T @ b, "cf": f.sum(axis=0), "cb": b.sum(axis=0)}
        dx = f @ d["Wf"].T + b @ d["Wb"].T
        rows, grams_, sizes = parts
        known = rows > 0
        self.rows("words", rows[known], dx[known])
        self.rows("grams", grams_, np.repeat(dx / np.sqrt(sizes)[:, None], sizes, axis=0).astype(np.float32))
        self.n += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            d[k] -= (self.rate * self.m[k] / (1 - 0.9**self.n) / (np.sqrt(self.s[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)


class Bag:
    """Distinct words of the sample with their vocabulary rows and n-grams."""

    def __init__(self, net: Net, words: list[str]):
        _, self.rows, self.flat, self.sizes = net.vectors(words)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.rows[at], self.flat[np.repeat(self.begins[at], sizes) + inner], sizes


def train(texts: list[str], truth: list[int], rounds: int = 4, batch: int = 128, vocab_size: int = 20_000, seed: int = 7, effort: int = 10_000) -> Net | None:
    """The network for labelled texts; None unless there are texts of both labels."""
    if len(set(truth)) < 2:
        return None
    rng = np.random.default_rng(seed)
    distinct: dict[str, int] = {}
    # document by document, so that no more than one document's words are held as text
    own = [np.fromiter((distinct.setdefault(w, len(distinct)) for w in words_of(t) or [""]), dtype=np.int32) for t in texts]
    seen = np.bincount(np.concatenate([np.unique(a) for a in own]), minlength=len(distinct)).tolist()
    names = list(distinct)
    known = sorted((w for w, n in zip(names, seen, strict=True) if n >= 3), key=lambda w: (-seen[distinct[w]], w))[:vocab_size]
    net = Net.new({w: i + 1 for i, w in enumerate(known)}, seed)
    bag = Bag(net, names)
    flat = np.concatenate(own)
    starts, sizes, doc = windows([len(a) for a in own])
    y = np.asarray(truth, dtype=np.float32)
    # windows are gathered batch by batch
    own_words = lambda at: gathered(flat, starts[at], sizes[at])
    del own, distinct, names
    per_doc = np.bincount(doc)
    trainer = Trainer(net)

    def dull() -> None:
        """A batch of windows of one harmless word each: repetition as such is not toxic."""
        ids, _ = own_words(rng.choice(np.flatnonzero(y[doc] == 0), size=batch))
        word = ids[np.arange(batch), rng.integers(WINDOW, size=batch)]
        trainer.step(bag, np.repeat(word[:, None], WINDOW, axis=1), np.ones((batch, WINDOW), dtype=bool), np.zeros(batch, dtype=np.float32), np.full(batch, 0.5))

    def fit(chosen: np.ndarray) -> None:
        chosen = rng.permutation(chosen)
        dull()
        share = y[doc[chosen]].mean()
        for k in range(0, len(chosen), batch):
            at = chosen[k : k + batch]
            t = y[doc[at]]
            trainer.step(bag, *own_words(at), t, np.where(t > 0, 0.5 / max(share, 0.05), 0.5 / max(1 - share, 0.05)))

    short = np.flatnonzero(per_doc[doc] <= 4)
    for _ in range(max(3, min(20, 12_000 // max(len(short), 1)))):
        fit(short if len(set(y[doc[short]])) == 2 else np.arange(len(doc)))
    for k in range(rounds):
        table = net.projected(net.mixed(bag.rows, bag.flat, bag.sizes))
        score = np.concatenate([net.forward(table, *own_words(slice(i, i + 1024))) for i in range(0, len(doc), 1024)])
        order = np.lexsort((-score, doc))
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        worst = order[(nth == 0) | ((nth < 3) & (y[doc[order]] == 0))]
        others = rng.choice(np.flatnonzero(y[doc] == 0), size=min(len(worst) // 4, int((y[doc] == 0).sum())), replace=False)
        trainer.rate = 0.01 * (1 - k / (rounds + 1))
        for _ in range(max(1, min(30, effort // len(worst)))):
            fit(np.concatenate([worst, others]))
            for _ in range(len(worst) // batch // 8):
                dull()
    return net


class Scorer:
    """Scores texts; words met before are remembered with their share of the gates."""

    def __init__(self, net: Net):
        self.net, self.seen, self.table = net, {}, np.zeros((0, 6 * HID), dtype=np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        pool: dict[str, str] = {}
        split = [[pool.setdefault(w, w) for w in words_of(t)] for t in texts]
        wanted = {*pool, ""}
        new = [w for w in wanted if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen, new, self.table = {}, sorted(wanted), self.table[:0]
        if new:
            self.seen |= {w: len(self.table) + i for i, w in enumerate(new)}
            self.table = np.concatenate([self.table, *(self.net.projected(self.net.vectors(new[i : i + PORTION])[0]) for i in range(0, len(new), PORTION))])
        get = self.seen.__getitem__
        flat = np.fromiter((i for words in split for i in map(get, words or ("",))), dtype=np.int64)
        starts, sizes, doc = windows([len(w) or 1 for w in split])
        logit = np.concatenate([self.net.forward(self.table, *gathered(flat, starts[i : i + 2048], sizes[i : i + 2048])) for i in range(0, len(doc), 2048)])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, logit)
        return 1 / (1 + np.exp(-worst))


def held_out(doc_id: str) -> "Column":
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, n_pos: int = 2500, n_neg: int = 5000, train_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net | None:
    """The network fitted on a bounded sample of the labelled rows that are not held out; None unless it has both labels."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("truth")).where(F.col("doc_id").isNotNull() & F.col("truth").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("truth").alias("truth")).withColumn("order", F.xxhash64("doc_id"))
    sample = known.where("truth = 1").orderBy("order").limit(n_pos).unionByName(known.where("truth = 0").orderBy("order").limit(n_neg))
    rows = id_text(docs, id_col, text_col).where(F.length("text") <= train_chars).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "order", "truth").agg(F.min("text").alias("text")).select("order", "truth", "text")

    def fit(batches):
        held = list(batches)
        drawn = pa.Table.from_batches(held) if held else None
        if drawn is not None and len(drawn):
            drawn = drawn.take(np.argsort(drawn["order"].to_numpy(), kind="stable"))
            net = train(drawn["text"].to_pylist(), drawn["truth"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], type=pa.binary())], names=["net"])

    got = saved(rows.repartition(1).mapInArrow(fit, "net binary")).first()
    return pickle.loads(got[0]) if got else None


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for every row."""
    own = id_text(docs, id_col, text_col)
    score = scoring(docs.sparkSession, trained(docs, labels, id_col=id_col, text_col=text_col, **sample))
    scored = by_slice(own, "text", "doc_id long, score double", lambda rows, texts: {"doc_id": rows.column(0), "score": score(texts)})
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scoring(spark, net: Net | None):
    """A function from texts to scores for use in tasks; the network travels as a broadcast of bounded size."""
    shared = spark.sparkContext.broadcast(net)
    own: list[Scorer] = []

    def score(texts: list[str]) -> np.ndarray:
        if shared.value is None:
            return np.zeros(len(texts))
        if not own:
            own.append(Scorer(shared.value))
        return own[0](texts)

    return score


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    score = scoring(docs.sparkSession, trained(docs, labels, id_col=id_col, text_col=text_col, **sample))
    return rewritten(docs, text_col, lambda rows, texts: rows.filter(pa.array(score(texts) < threshold)))
