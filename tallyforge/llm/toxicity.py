"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of its hash and the mean of the embeddings of its character
n-grams. Two gated recurrent layers read a window of words from either end; attention pools
their states; a logistic unit scores the pool. The network is trained in numpy on a bounded
sample of labelled rows. A text is scored on all its overlapping windows; the highest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .words import _LOWER, Words, mix, sub_batches, texts_of

F32 = np.float32
SPAN, STEP = 48, 36
BUCKETS, DIM, HIDDEN = 1 << 13, 16, 16
GRAMS = (3, 4, 5)
#: The epochs at whose start each text's highest window is found anew.
FIND = (1, 2, 4, 7)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Texts:
    """Texts as windows of word numbers, and the distinct words' hashed features."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        kinds, first, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.kind_word = (kinds % np.uint64(BUCKETS)).astype(np.int64)
        self._grams(w, first)
        n = w.count
        self.n_windows = np.where(n > SPAN, -(-(n - SPAN) // STEP) + 1, 1)
        self.doc = np.repeat(np.arange(len(n)), self.n_windows)
        turn = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.n_windows) - self.n_windows, self.n_windows)
        self.start = w.first[:-1][self.doc] + turn * STEP
        self.size = np.clip(n[self.doc] - turn * STEP, 0, SPAN)

    def _grams(self, w: Words, first: np.ndarray) -> None:
        """Buckets of the n-grams of each distinct word, its ends marked."""
        size = w.end[first] - w.start[first] + 2 if len(first) else np.zeros(0, np.int64)
        head = np.cumsum(size) - size
        at = np.repeat(w.start[first] - 1 - head, size) + np.arange(size.sum()) if len(first) else np.zeros(0, np.int64)
        ends = np.zeros(len(at), bool)
        ends[head] = True
        ends[head + size - 1] = True
        raw = np.where(ends, 1, _LOWER[w.raw[np.where(ends, 0, at)]]).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
        room = np.repeat(head + size, size) - np.arange(len(at))
        owner = np.repeat(np.arange(len(size)), size)
        which, gram = [], []
        for n in GRAMS:
            i = np.flatnonzero(room >= n)
            h = np.full(len(i), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + raw[i + j]
            which.append(owner[i].astype(np.int32))
            gram.append((mix(h) % np.uint64(BUCKETS)).astype(np.uint16))
        which, gram = np.concatenate(which), np.concatenate(gram)
        order = np.argsort(which, kind="stable")
        self.gram_word, self.gram = which[order], gram[order]

    def of(self, i: np.ndarray) -> Texts:
        """Some windows, with their words only."""
        new = object.__new__(Texts)
        rows, live = self.rows(i)
        used, number = np.unique(rows[live], return_inverse=True)
        new.kind_word, new.word = self.kind_word[used], number
        place = np.full(max(1, len(self.kind_word)), -1)
        place[used] = np.arange(len(used))
        owner = place[self.gram_word] if len(self.gram_word) else self.gram_word
        new.gram_word, new.gram = owner[owner >= 0], self.gram[owner >= 0]
        new.size = self.size[i]
        new.start = np.cumsum(new.size) - new.size
        new.doc, new.n_windows = np.arange(len(i)), np.ones(len(i), np.int64)
        return new

    def rows(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) word numbers and mask of some windows."""
        place = np.arange(max(1, int(self.size[i].max(initial=0))))
        live = place < self.size[i][:, None]
        at = np.where(live, self.start[i][:, None] + place, 0)
        return (self.word[at] if len(self.word) else np.zeros(at.shape, np.int64)), live


class Network:
    """Parameters and their gradients. Layers of direction d read windows forwards (0) or backwards (1)."""

    def __init__(self, seed: int = 0):
        g = np.random.default_rng(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return g.normal(0, scale, shape).astype(F32)

        self.p = {"word": init(BUCKETS, DIM, scale=0.05), "char": init(BUCKETS, DIM, scale=0.05)}
        for d in "fb":
            self.p[f"in_{d}"] = init(2 * DIM, 3 * HIDDEN, scale=0.3)
            self.p[f"re_{d}"] = init(HIDDEN, 3 * HIDDEN, scale=0.25)
            self.p[f"bias_{d}"] = np.zeros(3 * HIDDEN, F32)
        self.p["look"] = init(2 * HIDDEN, scale=0.1)
        self.p["out"] = init(2 * HIDDEN, scale=0.3)
        self.p["prior"] = np.zeros(1, F32)

    def inputs(self, t: Texts) -> np.ndarray:
        """Input of each distinct word."""
        n = len(t.kind_word)
        total = np.zeros((n, DIM), F32)
        count = np.bincount(t.gram_word, minlength=n)
        if len(t.gram):
            head = np.flatnonzero(np.append(True, t.gram_word[1:] != t.gram_word[:-1]))
            total[t.gram_word[head]] = np.add.reduceat(self.p["char"][t.gram], head, axis=0)
        return np.concatenate([self.p["word"][t.kind_word], total / np.maximum(count, 1).astype(F32)[:, None]], 1)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}

    def _read(self, gate: np.ndarray, rows: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, width = rows.shape
        u, h = self.p[f"re_{d}"], np.zeros((n, HIDDEN), F32)
        out = np.zeros((n, width, HIDDEN), F32)
        whole = live.all(0)
        half, two = F32(0.5), 2 * HIDDEN
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            a = gate[rows[:, t]]
            b = h @ u
            zr = a[:, :two] + b[:, :two]
            zr *= half
            np.tanh(zr, out=zr)
            zr += 1
            zr *= half
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = r * b[:, two:]
            c += a[:, two:]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if not whole[t]:
                new = np.where(live[:, t : t + 1], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, b[:, two:]))
            h = new
            out[:, t] = h
        return out

    def logits(self, gate: dict[str, np.ndarray], rows: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        if not len(gate["f"]):
            gate = {d: np.zeros((1, 3 * HIDDEN), F32) for d in "fb"}
        tape = {d: ([] if keep is not None else None) for d in "fb"}
        h = np.concatenate([self._read(gate[d], rows, live, d, tape[d]) for d in "fb"], 2)
        e = np.where(live, h @ self.p["look"], F32(-1e4))
        a = np.exp(e - e.max(1, keepdims=True)) * live
        a = a / np.maximum(a.sum(1, keepdims=True), F32(1e-9))
        pool = np.einsum("nt,ntk->nk", a, h)
        if keep is not None:
            keep |= {"tape": tape, "h": h, "a": a, "pool": pool}
        return pool @ self.p["out"] + self.p["prior"][0]

    def window_scores(self, t: Texts, step: int = 1024) -> np.ndarray:
        gate = self.gates(self.inputs(t))
        order = np.argsort(t.size, kind="stable")
        out = np.zeros(len(order), F32)
        for k in range(0, len(order), step):
            i = order[k : k + step]
            out[i] = self.logits(gate, *t.rows(i))
        return out

    def gradient(self, t: Texts, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of some windows with labels y."""
        x = self.inputs(t)
        gate = self.gates(x)
        rows, live = t.rows(windows)
        k: dict = {}
        z = self.logits(gate, rows, live, k)
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        dz = ((_sigmoid(z) - y) / len(y)).astype(F32)
        g["out"], g["prior"] = k["pool"].T @ dz, dz.sum(keepdims=True)
        d_pool = dz[:, None] * self.p["out"]
        d_a = np.einsum("nk,ntk->nt", d_pool, k["h"])
        d_e = k["a"] * (d_a - (k["a"] * d_a).sum(1, keepdims=True))
        d_h = k["a"][:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * self.p["look"]
        g["look"] = np.einsum("nt,ntk->k", d_e, k["h"])
        d_x = np.zeros_like(x)
        for j, d in enumerate("fb"):
            u = self.p[f"re_{d}"]
            dh = np.zeros((len(y), HIDDEN), F32)
            d_gate = np.zeros_like(gate[d])
            for s, h, zt, r, c, bc in reversed(k["tape"][d]):
                dh = dh + d_h[:, s, j * HIDDEN : (j + 1) * HIDDEN]
                m = live[:, s : s + 1]
                dn = dh * m
                dc = dn * (1 - zt) * (1 - c * c)
                d_zt = dn * (h - c) * zt * (1 - zt)
                d_r = dc * bc * r * (1 - r)
                da = np.concatenate([d_zt, d_r, dc], 1)
                db = np.concatenate([d_zt, d_r, dc * r], 1)
                np.add.at(d_gate, rows[:, s], da)
                g[f"re_{d}"] += h.T @ db
                dh = dh * ~m + dn * zt + db @ u.T
            g[f"in_{d}"] = x.T @ d_gate
            g[f"bias_{d}"] = d_gate.sum(0)
            d_x += d_gate @ self.p[f"in_{d}"].T
        np.add.at(g["word"], t.kind_word, d_x[:, :DIM])
        if len(t.gram):
            count = np.bincount(t.gram_word, minlength=len(x)).astype(F32)
            np.add.at(g["char"], t.gram, (d_x[:, DIM:] / np.maximum(count, 1)[:, None])[t.gram_word])
        return g


def _top(t: Texts, score: np.ndarray) -> np.ndarray:
    """The highest window of each text."""
    order = np.lexsort((-score, t.doc))
    return order[np.append(True, t.doc[order][1:] != t.doc[order][:-1])]


def train(texts: list[str], labels: np.ndarray, updates: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 3) -> tuple[Network, float, float]:
    """(network, slope, shift) from texts and 0/1 labels.

    At least `updates` steps and five epochs. A text's label holds for its highest window, which some epochs find again, and of a text
    with label 0 for all its windows, of which one at random is used besides. slope and
    shift map the highest logit to a calibrated one, fitted on whole texts with the classes
    weighed as they come.
    """
    net, g = Network(seed), np.random.default_rng(seed)
    # each part has an empty text of label 0 besides
    cuts = range(0, len(texts), batch)
    parts = [Texts(pa.array([*texts[k : k + batch], ""])) for k in cuts]
    y_parts = [np.append(labels[k : k + batch], 0).astype(F32) for k in cuts]
    m, v, turn = {n: np.zeros_like(p) for n, p in net.p.items()}, {n: np.zeros_like(p) for n, p in net.p.items()}, 0
    epochs = max(5, -(-updates // max(1, len(parts))))
    tops: dict[int, np.ndarray] = {}
    for epoch in range(epochs):
        for i in g.permutation(len(parts)):
            t, y = parts[i], y_parts[i]
            first = np.cumsum(t.n_windows) - t.n_windows
            some = first + (g.random(len(y)) * t.n_windows).astype(np.int64)
            if epoch in FIND:
                tops[i] = _top(t, net.window_scores(t))
            use = np.concatenate([tops.get(i, some), some[y == 0]])
            sub = t.of(use)
            grad = net.gradient(sub, np.arange(len(use)), y[t.doc[use]])
            turn += 1
            for n, p in net.p.items():
                m[n] += 0.1 * (grad[n] - m[n])
                v[n] += 0.001 * (grad[n] ** 2 - v[n])
                p -= F32(rate * (1 - epoch / epochs)) * (m[n] / (1 - 0.9**turn)) / (np.sqrt(v[n] / (1 - 0.999**turn)) + F32(1e-8))
    best = np.concatenate([s[_top(t, s)] for t in parts for s in (net.window_scores(t),)]).astype(np.float64)
    labels = np.concatenate(y_parts).astype(np.float64)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton steps with a little pull towards the unchanged logit
        p = _sigmoid(slope * best + shift)
        w = p * (1 - p) + 1e-6
        d = np.array([((p - labels) * best).sum() + (slope - 1), (p - labels).sum() + 0.01 * shift])
        hess = np.array([[(w * best * best).sum() + 1, (w * best).sum()], [(w * best).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, d)
        slope, shift = slope - np.clip(step[0], -0.5, 0.5), shift - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return net, float(max(slope, 0.05)), float(shift)


def score(docs: DataFrame, labels: DataFrame, may_learn, labelled: int = 2000, seed: int = 3) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text); other columns are ignored.

    labels(doc_id, toxic): 0 or 1; null rows are left out, of several labels of a row the
    highest counts. may_learn: a condition on doc_id for rows to learn from. The sample: the
    first `labelled` rows of each class by hash of doc_id. A null or empty text is
    scored as one empty window. With no labelled row of one class, every score is the share
    of label 1. The same rows give the same scores.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and toxic is not null").where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    some = None
    for kind in (0, 1):
        rows = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
        some = rows if some is None else some.union(rows)
    some = saved(some.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "labelled")
    counts = some.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    if not counts["n"] or counts["ones"] in (0, counts["n"]):
        return docs.select("doc_id", F.lit(float(counts["ones"] / counts["n"]) if counts["n"] else 0.0).alias("score"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
        net, *shape = train([r[1] or "" for r in rows], np.array([r[2] for r in rows], np.float64), seed=seed)
        names = [*net.p, "shape"]
        values = [*net.p.values(), np.array(shape)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([v.astype(np.float64).tobytes() for v in values], pa.binary())], ["name", "value"])

    # one task trains on the sample, of at most twice `labelled` texts; its parameters come back
    sample = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = {r["name"]: np.frombuffer(r["value"]) for r in sample.mapInArrow(learn, "name string, value binary").collect()}
    net = Network(seed)
    net.p = {n: got[n].reshape(v.shape).astype(F32) for n, v in net.p.items()}
    made = spark.sparkContext.broadcast((net, *map(float, got["shape"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, slope, shift = made.value
        for b in batches:
            for part in sub_batches(b, 1_500_000):
                t = Texts(texts_of(part))
                s = net.window_scores(t)
                best = np.full(part.num_rows, -np.inf)
                np.maximum.at(best, t.doc, s)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_sigmoid(slope * best + shift))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")
