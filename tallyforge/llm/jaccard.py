"""Operator 1: n-gram Jaccard join over a token-group matrix.

Documents with one shingle set are one class. Classes whose rare shingles meet are
partitioned into groups round a leader, each of bounded size, and those a leader links to and the others are its
two families of groups. Families that share too few shingles are never compared. For groups of the others, the matrix
has a row of bits for each set, and the rows of a group together are those of its whole token union: a query's overlap
with the other group's union bounds its similarity to every member, and its overlap with a member's row the similarity to that one.
A pair of groups is opened for the sets that both bounds leave, and only these are compared exactly. A row of bits takes a sixteenth to
a thirty-second of its set, so pairs of groups that hold no link move little. Nothing is lost: each bound is necessary for a link.

The order behind the matrix puts frequent shingles last, so passages that many documents share
open no groups. The list of frequent shingles is bounded and only changes the order; shingles that prove common
afterwards make no pairs for sets that have enough others. What stays quadratic is a family of sets that resemble
one leader, and one another, without reaching the threshold: no exact join can pass over their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .rows import keyed, restored
from .scratch import drop, saved
from .words import Words, as_long, grams, mix, sub_batches, texts_of

#: Bytes of the texts that are taken apart at once.
PIECE = 250_000
#: So many sets are broadcast at most, an id and a leader each; more are joined by key.
SENT = 1_000_000
#: Sets that link share at least this many of the shingles that go into the matrix; larger sets, more.
SHARED = 4


def up(n, num: int, den: int):
    """The least whole number at or above n * num / den."""
    return -(-n * num // den)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash, and sizes.

    A text of fewer than k words, but some, has its whole sequence as its one shingle. Words are taken apart in pieces of
    about PIECE bytes, since that takes some thirty times the space of a text.
    """
    none = np.zeros(0, np.int64)
    parts, at = [(none, np.zeros(0, np.uint64), none)], 0
    for piece in sub_batches(pa.RecordBatch.from_arrays([texts], ["text"]), PIECE):
        doc, h, n = _shingles(piece.column("text"), k)
        parts.append((doc + at, h, n))
        at += len(n)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets() of one piece."""
    w = Words(texts, lower=True)
    doc, _, h = grams(w, k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.count[short] > j
            value[has] = mix(value[has] + w.hash[w.first[short[has]] + j] * np.uint64(2 * j + 3))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, value])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[fresh], h[fresh]
    return doc, h, np.bincount(doc, minlength=len(texts))


class Often:
    """Shingles that a task meets again and again, with about how often: what is rare goes when there are too many."""

    def __init__(self, most: int = 250_000, pending: int = 3_000_000):
        self.most, self.pending, self.held = most, pending, 0
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray) -> None:
        self.new.append(h)
        self.held += len(h)
        if self.held > self.pending:
            self.settle()

    def settle(self) -> None:
        h = np.concatenate([*self.new, np.zeros(0, np.uint64)])
        self.new, self.held = [], 0
        h.sort()  # in place: a worker holds the pending hashes once
        starts = np.flatnonzero(np.concatenate([h[:1] == h[:1], h[1:] != h[:-1]]))
        n = np.diff(np.append(starts, len(h)))
        h = h[starts]
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        old = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        self.counts[at[old]] += n[old]
        fresh = ~old & (n > 1)
        keys, counts = np.append(self.keys, h[fresh]), np.append(self.counts, n[fresh])
        if len(keys) > self.most:
            keep = counts > np.partition(counts, len(counts) - self.most)[len(counts) - self.most]
            keys, counts = keys[keep], counts[keep]
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]


def profiles(docs: DataFrame, k: int, seen: int = 4) -> DataFrame:
    """What one reading of the texts gives. A row for each document: doc_id, n, key, cls (set size, 128-bit digest of the set and its
    first 64 bits; null for empty sets), token null; and rows (token, n) of shingles that a task has met `seen` times or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often = ["doc_id", "n", "key", "cls", "token"], Often()
        for batch in batches:
            for part in sub_batches(batch, 4_000_000):
                _, h, n = shingle_sets(texts_of(part), k)
                often.add(h)
                keys = _keys(h, n)
                cls = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(cls, pa.int64()), pa.nulls(len(n), pa.int64())], names
                )
        often.settle()
        keep = often.counts >= seen
        none = [pa.nulls(int(keep.sum()), t) for t in (pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(often.counts[keep]), none[1], none[2], pa.array(as_long(often.keys[keep]))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, cls long, token long")


def frequent(counted: DataFrame, most: int = 50_000) -> np.ndarray:
    """Up to `most` of the shingles of counted(token, n) with the highest counts, sorted. This only orders work."""
    found = counted.groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()["token"].to_numpy()
    return np.sort(top.view(np.uint64))


def shared(n: np.ndarray) -> np.ndarray:
    """How many shingles of the matrix a set of size n contributes beyond the least that must meet."""
    return np.maximum(SHARED, n // 16)


def need(n: F.Column, num: int, den: int) -> F.Column:
    """The least number of matrix shingles that a set of size n has in common with any set it links to."""
    least = F.ceil(n * num / den)
    most = F.greatest(F.lit(SHARED), F.floor(least / 16))
    for _ in range(2):
        least = F.ceil(least * num / den)
    return F.least(least, most)


def _keys(h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    raw, ends = h.tobytes(), (np.cumsum(n) * 8).tolist()
    return [hashlib.blake2b(raw[b - 8 * c : b], digest_size=16).digest() if c else None for b, c in zip(ends, n.tolist(), strict=True)]


def _met(docs: DataFrame, k: int, num: int, den: int, often: np.ndarray, n_parts: int) -> DataFrame:
    """(token, cls): the matrix's shingles that more than one class has.

    A class of size n, with o = ceil(n * num / den) the least overlap of a link, gives its first
    n - o + shared(n) shingles in the common order. Shingles travel packed, dealt by hash; of
    the frequent ones, and of those that a slice of a task has twice, it is known that they meet,
    so these are dealt anyhow, and one of each slice as the others are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        done: set[bytes] = set()
        turn = 0
        for batch in batches:
            for part in sub_batches(batch, 4_000_000):
                doc, h, n = shingle_sets(texts_of(part), k)
                keys = _keys(h, n)
                new = np.zeros(len(n), bool)
                cls = np.zeros(len(n), np.int64)
                if len(done) > 300_000:
                    done.clear()
                for i, x in enumerate(keys):  # copies within a task go once
                    if x is not None and x not in done:
                        done.add(x)
                        new[i], cls[i] = True, int.from_bytes(x[:8], "little", signed=True)
                at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
                late = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                order = np.argsort(doc * 2 + late, kind="stable")
                h, doc, late = h[order], doc[order], late[order]
                size = np.minimum(n, n - up(n, num, den) + shared(n))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                first = (rank < np.repeat(size, n)) & new[doc]
                h, doc, late = h[first], doc[first], late[first]
                # what meets in this slice is known to meet: dealt too, and one row of it goes where others may meet it
                by = np.argsort(h, kind="stable")
                same = h[by[1:]] == h[by[:-1]]
                again, heads = np.zeros(len(h), bool), np.zeros(len(h), bool)
                again[by[1:]], heads[by[:-1]] = same, same
                heads &= ~again & ~late
                # the row that stands for them goes both ways: elsewhere it may meet nobody
                late = np.append(late | again | heads, np.zeros(heads.sum(), bool))
                h, doc = np.append(h, h[heads]), np.append(doc, doc[heads])
                turn += 1
                to = (h % np.uint64(n_parts)).astype(np.int64)
                to[late] = (to[late] + turn * 7919 + cls[doc[late]]) % n_parts
                order = np.argsort(to * 2 + late, kind="stable")
                h, c, to, late = h[order], cls[doc[order]], to[order], late[order]
                cut = np.searchsorted(to * 2 + late, np.arange(2 * n_parts + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some // 2, pa.int32()),
                        pa.array(some % 2 == 1, pa.bool_()),
                        pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    ],
                    ["part", "often", "tokens", "classes"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["token", "cls"])

        def close() -> pa.RecordBatch:
            t, c = np.frombuffer(b"".join(tokens), np.int64), np.frombuffer(b"".join(classes), np.int64)
            order = np.lexsort((c, t))
            t, c = t[order], c[order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c = t[fresh], c[fresh]
            many = np.zeros(len(t), bool)
            many[1:] |= t[1:] == t[:-1]
            many[:-1] |= t[1:] == t[:-1]
            tokens.clear()
            classes.clear()
            return out(t[many], c[many])

        tokens: list[bytes] = []
        classes: list[bytes] = []
        last = None
        for batch in batches:
            for p, o, t, c in zip(*(batch.column(x).to_pylist() for x in ("part", "often", "tokens", "classes")), strict=True):
                if o:
                    yield out(np.frombuffer(t, np.int64), np.frombuffer(c, np.int64))
                    continue
                if p != last and tokens:
                    yield close()
                last = p
                tokens.append(t)
                classes.append(c)
        if tokens:
            yield close()

    packed = docs.select("text").mapInArrow(give, "part int, often boolean, tokens binary, classes binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "token long, cls long")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def bit_rows(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A row of bits for each set of n shingles of h: two to four bits for each, a power of two of them, 64 at least."""
    width = np.maximum(64, 1 << np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(width)
    bits = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    bits[np.repeat(ends - width, n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)] = 1
    raw = np.packbits(bits, bitorder="little").tobytes()
    return [raw[(b - w) // 8 : b // 8] for b, w in zip(ends.tolist(), width.tolist(), strict=True)]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(rep, lead, text) -> (rep, lead, n, tokens, bits): whole sets, sorted, and their rows of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, 4_000_000):
                _, h, n = shingle_sets(texts_of(part), k)
                # the order of signed integers, so that all later steps see sorted lists
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("lead"), pa.array(n.astype(np.int64)), _lists(as_long(h), n), pa.array(bit_rows(h, n), pa.binary())],
                    ["rep", "lead", "n", "tokens", "bits"],
                )

    return docs.mapInArrow(run, "rep long, lead long, n long, tokens array<long>, bits binary")


def _linked(inter, a, b, num: int, den: int):
    return den * inter >= num * (a + b - inter)


def _stars(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, lead) of the sets that link to their leader."""
    lead = sets.where("rep = lead").select(F.col("rep").alias("lead"), F.col("tokens").alias("other"))
    both = sets.where("rep <> lead").select("rep", "lead", "tokens").join(lead, "lead").select("rep", "lead", "tokens", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy() for c in ("tokens", "other"))
                keep.append(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), num, den))
            yield batch.select(["rep", "lead"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "rep long, lead long")


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the pairs, those that join parts not yet joined."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _open(side: np.ndarray, rep: np.ndarray, tokens: list[np.ndarray], one: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links between the groups of sides 0 and 1 (one: within one group)."""
    size = np.array([len(t) for t in tokens])
    row = np.repeat(np.arange(len(tokens)), size)
    word, col = np.unique(np.concatenate(tokens), return_inverse=True)
    live = np.ones(len(tokens), bool)
    if one:
        count = np.bincount(col, minlength=len(word))
        # overlap with the union of all the others
        bound = np.bincount(row, weights=count[col] > 1, minlength=len(tokens))
        live &= bound >= up(size, num, den)
    else:
        for s in (0, 1):
            union = np.zeros(len(word), bool)
            other = (side != s) & live
            union[col[other[row]]] = True
            bound = np.bincount(row, weights=union[col], minlength=len(tokens))
            live &= (side != s) | (bound >= up(size, num, den))
    left = np.flatnonzero(live & (side == 0)) if not one else np.flatnonzero(live)
    right = np.flatnonzero(live & (side == 1)) if not one else left
    if not len(left) or not len(right):
        return []
    inter = np.zeros((len(left), len(right)), np.float32)
    used = live[row]
    shared = np.flatnonzero(np.bincount(col[used], minlength=len(word)) > 1)
    at_l, at_r = np.full(len(tokens), -1), np.full(len(tokens), -1)
    at_l[left], at_r[right] = np.arange(len(left)), np.arange(len(right))
    place = np.full(len(word), -1)
    place[shared] = np.arange(len(shared))
    c = place[col]
    step = max(1, 4_000_000 // (len(left) + len(right)))
    for lo in range(0, len(shared), step):
        here = used & (c >= lo) & (c < lo + step)
        r, k = row[here], c[here] - lo
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x[at_l[r[at_l[r] >= 0]], k[at_l[r] >= 0]] = 1
        y[at_r[r[at_r[r] >= 0]], k[at_r[r] >= 0]] = 1
        inter += x @ y.T
    inter = np.rint(inter).astype(np.int64)
    ok = _linked(inter, size[left][:, None], size[right][None, :], num, den)
    if one:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    return [(int(rep[a]), int(rep[b])) for a, b in _spanning(np.stack([left[i], right[j]], 1), len(tokens))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (a, b), of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        cut = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if x == y:
                continue
            if last is not None and last != (a[x], b[x]):
                yield pa.Table.from_batches(held).combine_chunks()
                held.clear()
            last = (a[x], b[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _live(side: np.ndarray, n: np.ndarray, rows: list[bytes], one: bool, num: int, den: int) -> np.ndarray:
    """Which sets may link to one of the other side (one: to another of the same group), from sizes and rows of bits.

    Shingles of x whose bits y lacks are not in y, so x and y share at most their common bits and what x, or y, has more shingles than bits.
    Rows of different widths are compared at the lesser one, the wider folded.
    """
    width = np.array([len(r) for r in rows])
    out = np.zeros(len(n), bool)
    for w in np.unique(width):
        at, wide = np.flatnonzero(width == w), np.flatnonzero(width >= w)
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(rows[i], np.uint8).reshape(-1, w), axis=0) for i in wide])
        more = n[wide] - np.bitwise_count(bits).sum(1, dtype=np.int64)
        own = np.flatnonzero(width[wide] == w)
        for s in (0, 1):
            # rows of this width as queries of side s, against those of this width or more on the other side
            q, m = (own, np.arange(len(wide))) if one else (own[side[at] == s], np.flatnonzero(side[wide] != s))
            if s and one or not len(q) or not len(m):
                continue
            if not one:
                union = np.bitwise_or.reduce(bits[m], axis=0)
                q = q[np.bitwise_count(bits[q] & union).sum(1, dtype=np.int64) + more[q] >= up(n[wide[q]], num, den)]
                if not len(q):
                    continue
            common, step = np.zeros((len(q), len(m))), max(1, 500_000 // (len(q) + len(m)))
            for lo in range(0, w, step):
                x, y = (np.unpackbits(bits[i, lo : lo + step], axis=1).astype(np.float32) for i in (q, m))
                common += x @ y.T
            most = common.astype(np.int64) + np.minimum(more[q][:, None], more[m][None, :])
            ok = _linked(most, n[wide[q]][:, None], n[wide[m]][None, :], num, den)
            if one:
                ok &= q[:, None] != m[None, :]
            out[wide[q[ok.any(1)]]] = True
            out[wide[m[ok.any(0)]]] = True
    return out


def _sieved(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(a, b, side, rep, n, bits), dealt by (a, b) -> (a, b, side, rep) of the sets that must be compared exactly."""
    dealt = rows.select("a", "b", "side", "rep", "n", "bits").repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            live = _live(t["side"].to_numpy(), t["n"].to_numpy(), t["bits"].to_pylist(), t["a"][0].as_py() == t["b"][0].as_py(), num, den)
            yield from t.select(["a", "b", "side", "rep"]).filter(pa.array(live)).to_batches()

    return dealt.mapInArrow(run, "a long, b long, side int, rep long")


def _opened(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(a, b, side, rep, tokens), dealt by (a, b) -> links (rep, lead) that join what is not yet joined."""
    dealt = rows.select("a", "b", "side", "rep", "tokens").repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            lists = t["tokens"].chunk(0)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = _open(
                t["side"].to_numpy(), t["rep"].to_numpy(), [flat[x:y] for x, y in zip(off[:-1], off[1:], strict=True)], t["a"][0].as_py() == t["b"][0].as_py(), num, den
            )
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["rep", "lead"])

    return dealt.mapInArrow(run, "rep long, lead long")


#: A shingle that more sets than this have makes no pairs for a set that has enough others.
HOT = 256


def _ready(hits: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hits(token, rep, n, df) without the shingles that need make no pairs, (rep, dropped): how many went, and the table behind both.

    Two linked sets share `wanted` shingles of the matrix or more, so each may leave out its wanted - 1 most common
    ones, in one order of all shingles: of those shared, the rarest stays in both.
    """
    hot = hits.where(F.col("df") > HOT)
    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("df"), "token"))
    hot = saved(hot.withColumn("gone", rank < wanted), "hot")
    kept = hits.where(F.col("df") <= HOT).union(hot.where("not gone").select(hits.columns))
    return kept, hot.where("gone").groupBy("rep").agg(F.count("*").alias("dropped")), hot


def _families(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of families that may hold a link, from blocks(token, family, group, least, dropped).

    The groups of a family count as one, so a shingle of a large family of copies is one row here.
    """
    matrix = blocks.groupBy("token", "family").agg(F.min("least").alias("least"), F.max("dropped").alias("dropped"))
    a, b = (matrix.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("family", "least", "dropped")]) for s in "ab")
    met = a.join(b, "token").where("family_a < family_b").groupBy(F.col("family_a").alias("a"), F.col("family_b").alias("b"))
    return _enough(met, num, den)


def _groups(blocks: DataFrame, families: DataFrame, single: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of groups that may hold a link, of families(a, b) that may; single(family, group): families of one group."""
    one = [single.select(F.col("family").alias(s), F.col("group").alias(f"group_{s}")) for s in "ab"]
    known = families.join(one[0], "a", "left").join(one[1], "b", "left")
    plain = known.where("group_a is not null and group_b is not null").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
    open_ = known.where("group_a is null or group_b is null").select("a", "b")
    # by shingle first: a family of many groups meets a partner only in the shingles that both hold, not in all its own
    held = blocks.select("token", "family").distinct().join(single.select("family", F.lit(True).alias("one")), "family", "left")
    many = held.where("one is null").select("token", F.col("family").alias("x"))
    met = many.join(held.select("token", F.col("family").alias("y"), "one"), "token").where("one or x <= y")
    met = met.select("token", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(open_, ["a", "b"])
    a, b = (blocks.select("token", F.col("family").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("group", "least", "dropped")]) for s in "ab")
    met = met.join(a, ["a", "token"]).join(b, ["b", "token"]).where("a <> b or group_a < group_b")
    return plain.union(_enough(met.groupBy(F.col("group_a").alias("a"), F.col("group_b").alias("b")), num, den))


def _enough(met: GroupedData, num: int, den: int) -> DataFrame:
    got = met.agg(F.count("*").alias("got"), F.least(F.min("least_a"), F.min("least_b")).alias("n"), F.greatest(F.max("dropped_a"), F.max("dropped_b")).alias("dropped"))
    return got.where(F.col("got") >= F.greatest(F.lit(1), need(F.col("n"), num, den) - F.col("dropped"))).select("a", "b")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = 128) -> DataFrame:
    """Components of documents linked by shingle similarity of at least num / den.

    docs: doc_id (null and repeated ids are rows of their own), text; other columns are ignored. Words are lower-cased
    (A-Z) runs other than white space; a set is the distinct k-word shingles, or the whole
    sequence where there are fewer words. Returns doc_id, n_shingles, component_id for every
    row. A null text, an empty one and one of white space have the empty set, link with
    nothing and are their own component; rows of equal sets are one component; an empty table gives no rows. A
    text of any length is read whole, in one slice of a task that takes some twenty times its size.
    """
    docs, known = keyed(docs.select("doc_id", "text"))
    read = saved(profiles(docs, k), "profiles")
    often = frequent(read.where("token is not null"))
    ids = read.where("token is null").select("doc_id", "n", "key", "cls")
    total = ids.agg(F.sum("n")).first()[0] or 0
    classes = saved(ids.where("n > 0").groupBy("key", "cls", "n").agg(F.min("doc_id").alias("rep")), "classes")
    met = _met(docs, k, num, den, often, int(max(16, total // 2_500_000)))
    # a class is known by its 64 bits up to here; where two share them, both are compared
    hits = saved(met.distinct().join(classes.select("cls", "rep", "n"), "cls").select("token", "rep", "n"), "hits")
    wanted = need(F.col("n"), num, den)
    for _ in range(2):
        enough = hits.groupBy("rep", "n").agg(F.count("*").alias("got")).where(F.col("got") >= wanted).select("rep")
        last, left = hits, hits.drop("lead", "df").join(enough, "rep", "left_semi")
        low = saved(left.groupBy("token").agg(F.count("*").alias("df"), F.min("rep").alias("lead")).where("df > 1"), "tokens")
        hits = saved(left.join(low, "token"), "hits")
        for x in (last, low):
            drop(x)
    leads = saved(hits.groupBy("rep", "n").agg(F.min("lead").alias("lead"), F.count("*").alias("got")).where(F.col("got") >= wanted).select("rep", "lead"), "members")
    # leaders head their own group, whoever leads them elsewhere
    heads = leads.select("lead").distinct().select(F.col("lead").alias("rep"), F.lit(True).alias("head"))
    member = leads.join(heads, "rep", "left").select("rep", F.when(F.col("head"), F.col("rep")).otherwise(F.col("lead")).alias("lead"))
    # most texts are of no member: these stay where they are, unless the members are very many
    member = member.withColumnRenamed("rep", "doc_id")
    members = docs.join(F.broadcast(member), "doc_id") if leads.count() <= SENT else docs.hint("merge").join(member, "doc_id")
    sets = saved(_sets(members.select(F.col("doc_id").alias("rep"), "lead", "text"), k), "sets")
    star = saved(_stars(sets, num, den), "stars")
    # a leader's families: those linked to it and the others, dealt into groups of bounded size
    placed = sets.select("rep", "lead", "n").join(star.select("rep", F.lit(True).alias("is_star")), "rep", "left").withColumn(
        "star", F.coalesce("is_star", F.col("rep") == F.col("lead"))
    )
    dealt = placed.groupBy("lead", "star").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / 500_000)).alias("parts"), F.count("*").alias("size")
    )
    ready, dropped, hot = _ready(hits, wanted)
    placed = saved(
        placed.join(dealt, ["lead", "star"]).join(dropped, "rep", "left").select(
            "rep", "n", F.coalesce("dropped", F.lit(0).cast("long")).alias("dropped"), "star", "size", "parts", F.xxhash64("lead", "star").alias("family"),
            F.xxhash64("lead", "star", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("group"),
        ),
        "groups",
    )
    # a leader's own links are known: only what must still be compared stays
    blocks = ready.select("rep", "token").join(placed.select("rep", "n", "dropped", "family", "group"), "rep")
    blocks = saved(blocks.groupBy("token", "family", "group").agg(F.min("n").alias("least"), F.max("dropped").alias("dropped")), "matrix")
    for x in (hits, hot, leads):
        drop(x)
    families = _families(blocks, num, den).union(placed.where("not star and parts > 1").select("family", F.col("family").alias("b")).distinct())
    single = placed.where("parts = 1").select("family", "group").distinct()
    families = saved(families, "families")
    pairs = saved(_groups(blocks, families, single, num, den), "pairs")
    for x in (blocks, families):
        drop(x)
    # groups open only for sets that their sizes and rows of bits allow a link
    sizes = placed.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (sizes.select(F.col("group").alias(g), F.col("least").alias(f"least_{g}"), F.col("most").alias(f"most_{g}")) for g in "ab")
    sized = pairs.join(left, "a").join(right, "b").where((F.col("least_a") * num <= F.col("most_b") * den) & (F.col("least_b") * num <= F.col("most_a") * den))
    open_ = saved(sized.select("a", "b").union(placed.where("not star and size > 1").select(F.col("group").alias("a"), F.col("group").alias("b")).distinct()), "open")
    ends = open_.select("a", "b", F.col("a").alias("group"), F.lit(0).alias("side")).union(
        open_.where("a <> b").select("a", "b", F.col("b").alias("group"), F.lit(1).alias("side"))
    )
    rows = placed.select("rep", "group", "n").join(sets.select("rep", "bits"), "rep")
    live = saved(_sieved(ends.join(rows, "group"), num, den), "live")
    opened = live.join(sets.select("rep", "tokens"), "rep")
    links = star.union(_opened(opened, num, den)).toDF("a", "b")
    comp = components(links)
    for x in (sets, star, placed, pairs, open_, live):
        drop(x)
    out = ids.select("doc_id", "n", "key").join(classes.select("key", "rep"), "key", "left")
    out = out.join(comp, out["rep"] == comp["node"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return restored(out, known, "doc_id", "component_id")
