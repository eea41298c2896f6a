"""Operator 8: language-model scores by a subword lattice.

The pieces of an existing vocabulary weigh every segmentation of a word; a forward recursion in
log space adds them up to the word's marginal probability. Starting from the vocabulary's own
scores, piece probabilities are re-estimated from expected counts over all training words. A
text's words follow one another, and then an end.

Each distinct word is scored once. Frequent words, a bounded list, are looked up in the tasks
that read the texts; the rest meets the word table in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved
from .words import powers, sub_batches, texts_of

MARK = "▁".encode()
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can stand in a word marked at its start, as bytes, and the log of their first weights.

    The file's scores are negative ranks; a piece of rank r weighs 1 / (r + 2). Single bytes
    are always among the pieces, so that every word has a segmentation.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).encode()
        if MARK not in p[1:] and p not in got:
            got[p] = 1 / (2 - sp.get_score(i))
    for b in range(256):
        got.setdefault(bytes([b]), 1e-7)
    w = np.array(list(got.values()))
    return list(got), np.log(w / w.sum())


class Lattice:
    """Marginal probabilities of words over the pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = logp
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            sizes.setdefault(len(p), []).append(i)
        for n, which in sizes.items():
            raw = np.frombuffer(b"".join(pieces[i] for i in which), np.uint8).reshape(-1, n)
            h = ((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)).sum(1, dtype=np.uint64)
            order = np.argsort(h)
            self.by_size[n] = h[order], np.array(which)[order]

    def _edges(self, words: list[bytes]):
        marked = [MARK + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        raw = np.frombuffer(b"".join(marked), np.uint8)
        n = len(raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        back = powers(_BACK, n)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        rel = np.arange(n) - first[word]
        room = size[word] - rel
        base = first + np.arange(len(size))  # a slot for each byte border
        starts, stops, pieces = [], [], []
        at = np.arange(n)
        for m in sorted(self.by_size):
            at = at[room[at] >= m]
            if not len(at):
                break
            keys, which = self.by_size[m]
            h = (total[at + m] - total[at]) * back[at]
            i = np.searchsorted(keys, h)
            i[i == len(keys)] = 0
            hit = keys[i] == h
            s = at[hit]
            starts.append(base[word[s]] + rel[s])
            stops.append(base[word[s]] + rel[s] + m)
            pieces.append(which[i[hit]])
        border = np.arange(n + len(size)) - np.repeat(base, size + 1)
        return base, size, border, np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)

    @staticmethod
    def _sweep(value: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """Adds up, target by target, in ascending order of step."""
        order = np.lexsort((target, step))
        source, target, weight, step = source[order], target[order], weight[order], step[order]
        cut = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(step)], strict=True):
            t = target[a:b]
            head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            value[t[head]] = np.logaddexp.reduceat(value[source[a:b]] + weight[a:b], head)

    def _chunks(self, words: list[bytes], most: int = 200_000):
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        part, held = [], 0
        for i in order:
            part.append(i)
            held += len(words[i]) + 3
            if held >= most:
                yield part
                part, held = [], 0
        if part:
            yield part

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        for part in self._chunks(words):
            base, size, border, s, e, p = self._edges([words[i] for i in part])
            alpha = np.full(len(border), -np.inf)
            alpha[base] = 0
            self._sweep(alpha, s, e, self.logp[p], border[e])
            out[part] = alpha[base + size]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur so many times."""
        out = np.zeros(len(self.logp))
        for part in self._chunks(words):
            base, size, border, s, e, p = self._edges([words[i] for i in part])
            alpha = np.full(len(border), -np.inf)
            alpha[base] = 0
            self._sweep(alpha, s, e, self.logp[p], border[e])
            beta = np.full(len(border), -np.inf)
            beta[base + size] = 0
            self._sweep(beta, e, s, self.logp[p], -border[s])
            word = np.repeat(np.arange(len(part)), size + 1)[s]
            seen = np.exp(alpha[s] + self.logp[p] + beta[e] - alpha[(base + size)[word]])
            out += np.bincount(p, weights=seen * counts[part][word], minlength=len(out))
        return out


_LATTICES: dict[int, Lattice] = {}


def lattice(pieces: list[bytes], logp: np.ndarray) -> Lattice:
    key = hash((len(pieces), logp.tobytes()))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces, logp)
    return _LATTICES[key]


def split(text: str) -> list[bytes]:
    """Words, A-Z lower-cased; bytes.split parts at just the six white-space bytes meant."""
    return text.encode().translate(_LOWER).split()


def _word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c) over all texts; a task adds up what it can hold first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for part in sub_batches(batch, 1_000_000):
                for t in texts_of(part).to_pylist():
                    held.update(split(t))
                if len(held) > most:
                    yield give()
        yield give()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, n_docs: int, pieces: list[bytes], logp: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(log probability of each piece, of the end) from words(word, c), by expected counts."""
    log_end = float(np.log(0.5))
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((pieces, logp))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = lattice(*sent.value)
            total = np.zeros(len(model.logp))
            for b in batches:
                total += model.expected([w.encode() for w in b.column("word").to_pylist()], b.column("c").to_numpy())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        # one number for each piece of the vocabulary
        got = words.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        count = np.full(len(pieces), 0.1)
        count[got["piece"].to_numpy()] += got["n"].to_numpy()
        whole = count.sum() + n_docs
        logp, log_end = np.log(count / whole), float(np.log(max(n_docs, 0.1) / whole))
    return logp, log_end


def score(docs: DataFrame, learn, pieces_path: str, rounds: int = 2, frequent: int = 200_000) -> DataFrame:
    """Scores of every text under a model of the texts where learn(doc_id) holds.

    docs: doc_id (null and repeated ids are rows of their own), text; other columns are ignored. Returns doc_id, learned,
    n_tokens (words and the end), n_known (tokens met in training), train_tokens, base_score (smoothed
    unigram, log10), score (lattice, log10). A null or empty text is just its end. Without
    training rows every count is 0 and pieces keep their first weights. pieces_path is a
    sentencepiece file on the driver, read once; `frequent` bounds the list of words looked up in tasks.
    """
    docs, ids = keyed(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned")))
    pieces, logp = vocabulary(pieces_path)
    counts = saved(_word_counts(docs.where("learned")), "counts")
    n_docs = docs.where("learned").count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, n_kinds = (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)
    log_end = float(np.log(0.5))
    if n_docs:
        logp, log_end = fit(counts, n_docs, pieces, logp, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logp))
    under = np.log10(n_all + 0.1 * (n_kinds + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(*sent.value)
        for b in batches:
            lp = model.log_probs([w.encode() for w in b.column("word").to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp)], ["word", "c", "lp"])

    table = saved(counts.mapInArrow(weigh, "word string, c long, lp double"), "words")
    top = table.where(F.octet_length("word") <= 64).orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    often = docs.sparkSession.sparkContext.broadcast(
        ([w.encode() for w in top["word"].to_pylist()], np.log10(top["c"].to_numpy() + 0.1) - under, top["lp"].to_numpy())
    )
    end_base = float(np.log10(n_docs + 0.1) - under)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base_of, lp_of = often.value
        find = {w: i for i, w in enumerate(words)}.get
        for batch in batches:
            for part in sub_batches(batch, 1_000_000):
                sums, rare, rare_n, ends = [], [], [], [0]
                for t in texts_of(part).to_pylist():
                    seen = Counter(split(t))
                    keys = list(seen)
                    n = np.fromiter(seen.values(), np.int64, len(keys))
                    at = np.fromiter((find(k, -1) for k in keys), np.int64, len(keys))
                    hot = at >= 0
                    i, c = at[hot], n[hot]
                    sums.append((int(n.sum()) + 1, int(c.sum()) + (n_docs > 0), float(c @ base_of[i]) + end_base, float(c @ lp_of[i]) + log_end / np.log(10)))
                    for k in np.flatnonzero(~hot).tolist():
                        rare.append(keys[k])
                    rare_n.extend(n[~hot].tolist())
                    ends.append(len(rare))
                cols = list(zip(*sums, strict=True))
                rest = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(rare_n, pa.int64())], ["word", "n"])
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("learned"), *(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.float64()) for c in cols[2:]), rest],
                    ["doc_id", "learned", "n_tokens", "n_known", "base", "lattice", "rest"],
                )

    rows = saved(
        docs.mapInArrow(read, "doc_id long, learned boolean, n_tokens long, n_known long, base double, lattice double, rest array<struct<word:string,n:long>>"), "read"
    )
    rest = rows.select("doc_id", F.explode("rest").alias("r")).select("doc_id", "r.word", "r.n").join(table, "word", "left")

    def unmet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(*sent.value)
        for b in batches:
            lp = model.log_probs([w.encode() for w in b.column("word").to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(lp)], ["doc_id", "n", "lp"])

    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    rest = saved(rest, "rest")
    met = rest.where("c is not null").select("doc_id", n.alias("known"), (n * (F.log10(c + F.lit(0.1)) - F.lit(float(under)))).alias("base_more"), (n * F.col("lp")).alias("lattice_more"))
    new = rest.where("c is null").select("doc_id", "word", "n").mapInArrow(unmet, "doc_id long, n long, lp double")
    new = new.select("doc_id", F.lit(0).cast("long").alias("known"), (n * F.lit(float(np.log10(0.1) - under))).alias("base_more"), (n * F.col("lp")).alias("lattice_more"))
    more = met.union(new).groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in ("known", "base_more", "lattice_more")])
    zero = F.lit(0.0)
    out = rows.drop("rest").join(more, "doc_id", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"),
        (F.col("lattice") + F.coalesce("lattice_more", zero)).alias("score"),
    )
    return restored(out, ids)
