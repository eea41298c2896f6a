"""Operator 10: approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size with few edges
between them; a small network learns which part a vector belongs to. Every row is indexed
under its most probable part. A query goes to the several most probable parts, as many as
give the wanted recall on the sample, and is reranked there by exact cosine. Neighbouring
parts stand on one shelf, and a query's vector goes once to each shelf that holds parts of it.
The sample is fitted in one task; only the router, some numbers for each part, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved

#: So many parts, of neighbouring numbers, are searched in one place at most, and fewer until there are LEAST_SHELVES.
SHELF, LEAST_SHELVES = 32, 24
#: Bytes of a block of similarities or of scores of parts; a partition of one takes some three times as much.
BLOCK_BYTES = 1 << 25


def _stride(width: int) -> int:
    """Rows of a block whose rows hold `width` doubles."""
    return max(1, BLOCK_BYTES // (8 * max(width, 1)))


def _least(sim: np.ndarray, k: int) -> np.ndarray:
    """For each row of sim a bound that k of its numbers or more reach, and few besides: the k-th largest of the maxima of strided columns."""
    step = max(1, min(64, sim.shape[1] // (8 * k)))
    wide = sim.shape[1] // step
    top = sim[:, : wide * step].reshape(len(sim), step, wide).max(1)
    return np.partition(top, wide - k, axis=1)[:, wide - k]


def _tops(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest numbers of each row, the largest first."""
    i, j = np.divmod(np.flatnonzero(sim >= _least(sim, k)[:, None]), sim.shape[1])
    order = np.lexsort((-sim[i, j], i))
    i, j = i[order], j[order]
    return j[np.arange(len(i)) - np.searchsorted(i, i) < k].reshape(len(sim), k)


def graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors."""
    unit = unit.astype(np.float32)
    out, step = np.zeros((len(unit), k), np.int64), _stride(len(unit))
    for at in range(0, len(unit) if k else 0, step):
        sim = unit[at : at + step] @ unit.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        out[at : at + step] = _tops(sim, k)
    return out


def others(asking: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of unit vectors for each asking one."""
    k, step = min(k, len(unit)), _stride(len(unit))
    asking, unit = asking.astype(np.float32), unit.astype(np.float32)
    out = np.zeros((len(asking), k), np.int64)
    for at in range(0, len(asking) if k else 0, step):
        out[at : at + step] = _tops(asking[at : at + step] @ unit.T, k)  # a copy: a slice would keep its whole block
    return out


def balanced_parts(unit: np.ndarray, near: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of each row: the graph halved again and again, halves as equal as can be.

    A half starts as one side of the median along the main direction; pairs of rows then change
    sides while that cuts fewer edges.
    """
    part = np.zeros(len(unit), np.int64)
    a, b = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    edge = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    todo, free = [(np.arange(len(unit)), n_parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1:
            part[rows] = free
            free += 1
            continue
        x = unit[rows] - unit[rows].mean(0)
        v = x.T @ x[:, 0] + 1e-9
        for _ in range(20):
            v = x.T @ (x @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        left = n // 2
        side = np.ones(len(rows), bool)
        side[np.argsort(x @ v, kind="stable")[: len(rows) * left // n]] = False
        at = np.full(len(unit), -1)
        at[rows] = np.arange(len(rows))
        e = at[edge]
        e = e[:, (e >= 0).all(0)]
        for _ in range(30):
            cut = side[e[0]] != side[e[1]]
            gain = np.bincount(e.ravel(), weights=np.tile(np.where(cut, 1, -1), 2), minlength=len(rows))
            zero, one = np.flatnonzero(~side), np.flatnonzero(side)
            zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
            m = min(len(zero), len(one))
            m = int(np.sum(gain[zero[:m]] + gain[one[:m]] > 2)) // 2
            if not m:
                break
            trial = side.copy()
            trial[zero[:m]], trial[one[:m]] = True, False
            if (trial[e[0]] != trial[e[1]]).sum() >= cut.sum():
                break
            side = trial
        todo += [(rows[~side], left), (rows[side], n - left)]
    return part


class Router:
    """A network with one hidden layer: unit vector to the logarithms of its parts' probabilities."""

    def __init__(self, n_in: int, n_out: int, hidden: int = 64, seed: int = 0):
        g = np.random.default_rng(seed)
        self.w = [g.normal(0, n_in**-0.5, (n_in, hidden)), np.zeros(hidden), g.normal(0, hidden**-0.5, (hidden, n_out)), np.zeros(n_out)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """score() before it is made a probability: in the same order."""
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Router:
        g = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = g.permutation(len(x))
            for k in range(0, len(x), batch):
                i = order[k : k + batch]
                pre = x[i] @ self.w[0] + self.w[1]
                h = np.maximum(pre, 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                back = (p @ self.w[2].T) * (pre > 0)
                t += 1
                for j, d in enumerate((x[i].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * d
                    v[j] = 0.999 * v[j] + 0.001 * d * d
                    self.w[j] -= rate * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return self


def probes_for(home: np.ndarray, near: np.ndarray, asking: np.ndarray, net: Router, wanted: float) -> int:
    """The least number of parts to search for the wanted share of neighbours.

    home: the part of each row of the sample; near: rows of the sample next to each asking row; net scores the asking rows' parts, in blocks.
    """
    n_parts = net.w[3].size
    step, at_depth = _stride(n_parts), np.zeros(n_parts, np.int64)
    for at in range(0, len(asking), step):
        order = np.argsort(-net.score(asking[at : at + step]), axis=1)
        place = np.argsort(order, axis=1)  # rank of each part for each row
        at_depth += np.bincount(np.take_along_axis(place, home[near[at : at + step]], axis=1).ravel(), minlength=n_parts)
    if not at_depth.sum():
        return n_parts
    got = np.cumsum(at_depth) / at_depth.sum()
    return int(np.searchsorted(got, wanted) + 1) if got[-1] >= wanted else n_parts


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def best_parts(net: Router, unit: np.ndarray) -> np.ndarray:
    """The most probable part of each row, in blocks."""
    step = _stride(net.w[3].size)
    return np.concatenate([np.zeros(0, np.int64), *[net.raw(unit[at : at + step]).argmax(1) for at in range(0, len(unit), step)]])


def fitted(some: np.ndarray, n_parts: int, recall: float) -> tuple[Router, int]:
    """(router, probes) from a sample: each fifth row is held out of the router, and says how many parts to search."""
    unit = _unit(some)
    out = np.arange(len(unit)) % 5 == 4
    unit, held = unit[~out], unit[out]
    n_parts = max(1, min(n_parts, len(unit) // 8))
    near = graph(unit, min(10, len(unit) - 1)) if len(unit) > 1 else np.zeros((1, 0), int)
    net = Router(unit.shape[1], n_parts).fit(unit, balanced_parts(unit, near, n_parts))
    return net, probes_for(best_parts(net, unit), others(held, unit, 10), held, net, recall)


def best_of(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest rows of x for each row of q, other than the one of its id; ties to the smaller id."""
    near = _unit(q).astype(np.float32) @ _unit(x).astype(np.float32).T
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, qids, sorter=order), len(ids) - 1)]
    own = np.flatnonzero(ids[at] == qids)
    near[own, at[own]] = -2
    # all that could be among the first k: products in single precision differ by less than half of this
    slack = np.float32((q.shape[1] + 8) * 2.5e-7)
    least = _least(near, min(k, near.shape[1])) - slack
    i, j = np.divmod(np.flatnonzero(near >= np.maximum(least, -1.5)[:, None]), near.shape[1])
    q, x, score, step = _scaled(q), _scaled(x), np.zeros(len(i)), _stride(q.shape[1])
    for lo in range(0, len(i), step):  # very common vectors leave many
        a, b = q[i[lo : lo + step]], x[j[lo : lo + step]]
        score[lo : lo + step] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return _first(qids[i], ids[j], score, k)


def _first(qids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query: highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, qids))
    qids, ids, score = qids[order], ids[order], score[order]
    keep = np.arange(len(qids)) - np.searchsorted(qids, qids) < k
    return qids[keep], ids[keep], score[keep]


def _router(rows: DataFrame, size: int, total: int, n_parts: int, recall: float) -> tuple[Router, int]:
    """fitted() on the `size` rows of the least hashes, in one task."""
    h = F.xxhash64("vec_id")
    share = (size + 8 * size**0.5) / total
    few = rows.where(h <= int(2**64 * share) - 2**63) if share < 1 else rows
    if share < 1 and few.count() < size:
        few = rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if t.num_rows:
            order = np.lexsort((t["vec_id"].to_numpy(), t["h"].to_numpy()))[:size]
            net, probes = fitted(_rows(t["v"].combine_chunks())[order], n_parts, recall)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()) for w in net.w] + [pa.array([probes])], ["a", "b", "c", "d", "probes"])

    got = few.select("vec_id", h.alias("h"), "v").repartition(1).mapInArrow(run, "a binary, b binary, c binary, d binary, probes long").first()
    w = [np.frombuffer(got[c], np.float64) for c in "abcd"]
    net = Router(len(w[0]) // len(w[1]), len(w[3]), len(w[1]))
    net.w = [x.reshape(y.shape) for x, y in zip(w, net.w, strict=True)]
    return net, got["probes"]


def nearest(
    vectors: DataFrame, is_query, k: int = 5, rows_a_part: int = 1500, sample_a_part: int = 160, least_sample: int = 5120, most_sample: int = 65_536, recall: float = 0.985, block: int | None = None
) -> DataFrame:
    """The k nearest rows, by cosine, of each query row.

    vectors: vec_id (null takes no part, rows of a repeated id are rows of their own), embedding (array of numbers); other columns are ignored. is_query: a
    condition on vec_id. Returns query_id, rank, vec_id, score for the nearest found, ties to
    the smaller vec_id, never the query row itself; all others where there are no more than k. Vectors that are null, zero, of another length than most or
    have null or non-finite components take no part; without vectors there are no rows.
    There is a part for every rows_a_part rows. A sample by hash, of sample_a_part rows for each part but at least least_sample and
    at most most_sample, shapes parts and router; it bounds the parts to an eighth of it, beyond which parts grow.
    Every row is indexed. score is the cosine of the original vectors in double precision. A task searches at most about
    `block` rows for as many queries; where none is given, as many as hold BLOCK_BYTES.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # single precision is kept as it is; what reads it makes doubles of it
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<float>" if kind == "float" else "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select("vec_id", F.col("embedding").cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows, known = keyed(rows, "vec_id")
    total = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if total is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == total["d"])
    n_parts = total["n"] // rows_a_part + 1
    size = min(most_sample, max(least_sample, n_parts * sample_a_part))
    net, probes = _router(rows, size, total["n"], n_parts, recall)
    n_parts = net.w[3].size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = best_parts(net, _unit(_rows(b.column("v"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    indexed = saved(rows.mapInArrow(place, f"vec_id long, v {kind}, asks boolean, part int"), "indexed")
    # two numbers for each part
    held, n_asks = np.zeros(n_parts, np.int64), 0
    for r in indexed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect():
        held[r["part"]] = r["n"]
        n_asks += r["asks"]
    wide = max(1, min(SHELF, n_parts // LEAST_SHELVES))
    # shelves of any size are searched in blocks: a salt for the rows, another for the queries
    block = block or _stride(total["d"])
    on_shelf = np.add.reduceat(held, np.arange(0, n_parts, wide))
    shelves = F.broadcast(spark.createDataFrame([(i, int(max(1, -(-n // block)))) for i, n in enumerate(on_shelf.tolist())], "shelf int, n_salts long"))
    q_salts = max(1, -(-n_asks // block))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _stride(n_parts)
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            if b.num_rows:
                order = np.argsort(-net.score(_unit(_rows(b.column("v")))), axis=1, kind="stable")
                # `probes` parts, and more as long as those hold too few rows
                ahead = np.cumsum(held[order], axis=1) - held[order]
                i, j = np.nonzero((np.arange(n_parts)[None, :] < probes) | (ahead < 4 * (k + 1)))
                part = order[i, j]
                by = np.lexsort((part, i))
                i, part = i[by], part[by]
                new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (part[1:] // wide != part[:-1] // wide)))
                parts = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)), pa.int32()), pa.array(part, pa.int32()))
                rows = pa.array(i[new])
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("v").take(rows), pa.array(part[new] // wide, pa.int32()), parts], ["query_id", "qv", "shelf", "parts"])

    def each(salts: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))

    asked = indexed.where("asks").select("vec_id", "v").mapInArrow(ask, f"query_id long, qv {kind}, shelf int, parts array<int>").join(shelves, "shelf")
    asked = asked.select("query_id", "qv", "parts", "shelf", each(F.col("n_salts")).alias("salt"), F.pmod(F.xxhash64("query_id"), F.lit(q_salts)).alias("q_salt"))
    index = indexed.withColumn("shelf", F.floor(F.col("part") / wide).cast("int")).join(shelves, "shelf")
    index = index.select("vec_id", "v", "part", "shelf", F.pmod(F.xxhash64("vec_id"), F.col("n_salts")).alias("salt"), each(F.lit(q_salts).cast("long")).alias("q_salt"))

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and x.num_rows:
            a, ids, part = _rows(x["v"]), x["vec_id"].to_numpy(), x["part"].to_numpy()
            asking, qids = _rows(q["qv"]), q["query_id"].to_numpy()
            lists = q["parts"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(qids)), lists.value_lengths().to_numpy())
            for p in np.unique(part):
                here, by = np.flatnonzero(part == p), who[wanted == p]
                step = min(512, _stride(len(here)))
                for at in range(0, len(by), step):
                    some = by[at : at + step]
                    found.append(best_of(asking[some], qids[some], a[here], ids[here], k))
        columns = _first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    key = ("shelf", "salt", "q_salt")
    hits = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return restored(out, known, "query_id", "vec_id")
