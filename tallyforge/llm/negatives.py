"""Operator 13: hard negatives, by a sort of all scores of each anchor.

Rows are packed into blocks of bounded size, anchors into smaller ones, and every block of anchors meets every
block of rows: the stated anchors against all rows, in blocks, one pair of blocks to a task's group. A first pass
keeps the best rows of an anchor's own label, its positives. A second one sorts each anchor's scores by score
and id, finds every positive's upper limit by binary search and reads the next rows of other labels down to the lower
limit. What the blocks find is merged by anchor, and by anchor and positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import saved

#: Components of a block of rows, anchors of a block of anchors, anchors scored at a time, most tasks of a pass. None changes a result.
PARTS, ANCHORS, STEP, TASKS = 1 << 22, 1024, 32, 20_000
ROW = "row long, vec_id long, label long, asks boolean, embedding array<double>"
BLOCK = "block long, rows binary, ids binary, labels binary, asks binary, dim int, kind string, parts binary"
#: Scores are 64-bit numbers; a sum beyond becomes the nearest of them.
MOST = 2**63 - 1


def usable(rows: DataFrame, asks: Column, label: Column) -> DataFrame:
    """Rows that take part: id, label, whether it is an anchor, and each component x as floor(256 * x)."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), asks.alias("asks"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(sound)
    return rows.select(F.lit(-1).cast("long").alias("row"), "vec_id", "label", F.coalesce("asks", F.lit(False)).alias("asks"), "embedding")


def _packed(batches: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    ids, labels, rows = (t.column(c).to_numpy() for c in ("vec_id", "label", "row"))
    lists = t.column("embedding").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    dim = int(size.max(initial=0))
    q = np.zeros((len(ids), dim))
    # shorter vectors are padded with zeros, which add nothing to a product
    q[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    if (rows < 0).all():
        q = np.floor(256 * q)
        rows = (block << 32) + np.arange(len(ids))
    kind = "h" if np.abs(q).max(initial=0) < 2**15 else "d"
    values = [block, rows.tobytes(), ids.tobytes(), labels.tobytes(), t.column("asks").to_numpy().tobytes(), dim, kind, q.astype(kind).tobytes()]
    types = [pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [f.split(" ")[0] for f in BLOCK.split(", ")])


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """One block for each of `parts` partitions that has rows, in the order of their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            yield _packed(held, TaskContext.get().partitionId())

    return rows.repartition(parts).sortWithinPartitions("vec_id", "row").mapInArrow(pack, BLOCK)


class Block:
    """A packed block read again: row numbers, ids, labels and vectors."""

    def __init__(self, t: pa.Table):
        r = t.select(["rows", "ids", "labels", "asks", "dim", "kind", "parts"]).to_pylist()[0]
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
        self.asks = np.frombuffer(r["asks"], bool)
        self.parts = np.frombuffer(r["parts"], r["kind"]).reshape(len(self.ids), r["dim"]).astype(float)
        self.most = float(np.abs(self.parts).max(initial=0))


def products(a: Block, at: int, b: Block) -> np.ndarray:
    """Inner products of STEP rows of a with all of b. Doubles are exact where no sum can pass 2**53; whole numbers of Python beyond."""
    d = min(a.parts.shape[1], b.parts.shape[1])
    x, y = a.parts[at : at + STEP, :d], b.parts[:, :d]
    if max(d, 1) * a.most * b.most < 2**53:
        return (x @ y.T).astype(np.int64)
    left, right = ([[int(c) for c in r] for r in m] for m in (x, y))
    return np.array([[min(max(sum(p * q for p, q in zip(u, v)), -MOST), MOST) for v in right] for u in left], np.int64).reshape(len(x), len(y))


def anchors_of(blocks: DataFrame) -> DataFrame:
    """The rows of the blocks that ask."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(pa.Table.from_batches([batch.slice(i, 1)]))
                at = np.flatnonzero(b.asks)
                vectors = pa.array(list(b.parts[at]), pa.list_(pa.float64()))
                columns = [pa.array(b.rows[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(b.asks[at]), vectors]
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in ROW.split(", ")])

    return blocks.mapInArrow(pick, ROW)


def _table(found: list[np.ndarray], names: list[str]) -> pa.Table:
    all_ = np.concatenate([np.zeros((0, len(names)), np.int64), *found])
    return pa.table({n: pa.array(all_[:, i]) for i, n in enumerate(names)})


def meeting(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int, find, names: list[str]) -> DataFrame:
    """find(row block, anchor block) for every pair of blocks, a pair at a time. names: its columns, all long."""

    def of(numbers: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))).alias(name)

    tasks = min(TASKS, n_blocks * n_anchors)
    left = blocks.select(F.col("block").alias("b"), of(n_anchors, "a"), *blocks.columns[1:]).repartition(tasks, "a", "b")
    right = anchors.select(F.col("block").alias("a"), of(n_blocks, "b"), *anchors.columns[1:]).repartition(tasks, "a", "b")

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        return _table(find(x, y) if x.num_rows and y.num_rows else [], names)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(pair, ", ".join(f"{n} long" for n in names))


def own_label(k: int):
    """The k best other rows of each anchor's label in a block."""

    def find(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        b, a, part = Block(x), Block(y), y.column("a")[0].as_py()
        found = []
        if not np.intersect1d(a.labels, b.labels).size:
            return found
        for at in range(0, len(a.ids), STEP):
            scores = products(a, at, b)
            for i, score in enumerate(scores, at):
                mine = np.flatnonzero((b.labels == a.labels[i]) & (b.rows != a.rows[i]))
                score = score[mine]
                if k < len(mine):
                    best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    mine, score = mine[best], score[best]
                best = np.lexsort((b.rows[mine], b.ids[mine], -score))[:k]
                mine, score = mine[best], score[best]
                found.append(np.stack([np.full(len(mine), v) for v in (part, a.rows[i], a.ids[i])] + [b.rows[mine], b.ids[mine], score], 1))
        return found

    return find


def other_labels(k: int, low: int, high: int):
    """For each anchor and positive, the first k rows of other labels in a block between the limits."""

    def find(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        b, a = Block(x), Block(y)
        wanted = {}
        for p in y.column("positives")[0].as_py() or []:
            wanted.setdefault(p["a_row"], []).append((p["place"], p["positive_id"], p["score"]))
        found = []
        for at in range(0, len(a.ids), STEP):
            scores = products(a, at, b)
            # ids ascend within a block, so a stable sort by score is one by score and id
            order = np.argsort(-scores, axis=1, kind="stable")
            for i, (score, by) in enumerate(zip(scores, order), at):
                by = by[b.labels[by] != a.labels[i]]
                falling = -score[by]
                for place, positive, ps in wanted.get(int(a.rows[i]), []):
                    # the highest and the lowest score that the limits let pass
                    top, least = (min(max(limit, -MOST), MOST) for limit in (high * ps // 100, -(-low * ps // 100)))
                    begin = np.searchsorted(falling, -top, "left")
                    taken = by[begin : begin + k]
                    taken = taken[score[taken] >= least]
                    fixed = (a.rows[i], a.ids[i], place, positive, ps)
                    found.append(np.stack([np.full(len(taken), v, np.int64) for v in fixed] + [b.rows[taken], b.ids[taken], score[taken]], 1))
        return found

    return find


def _ranked(rows: DataFrame, by: list[str], order: list[Column | str], k: int, name: str) -> DataFrame:
    """The first k rows of each by, numbered from 1: what a handful of blocks found, so a bounded number for each."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def hard_negatives(rows: DataFrame, asks: Column, label: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, parts: int = PARTS, anchors: int = ANCHORS) -> DataFrame:
    """vec_id, label, embedding -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor after each component x became floor(256 * x); higher scores come first,
    ties by smaller vec_id. An anchor's positives are its first `positives` other rows of its label (all, if fewer). For each, the first k rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score, rank from 1; none gives no row.

    Rows with a null vec_id, label or vector, or any null or non-finite component take no part. Vectors of fewer components count as
    padded with zeros, an empty one scores 0. Scores beyond 64 bits become the nearest number of 64 bits. Repeated vec_ids and repeated rows
    are rows of their own, in any order among equals. An empty table gives no rows; other columns are ignored.
    """
    rows = usable(rows, asks, F.col("label") if label is None else label)
    n, asking, dim = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("embedding"))).first()
    spark = rows.sparkSession
    if not asking:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size = max(1, parts // max(dim, 1))
    n_blocks, n_anchors = -(-n // size), -(-asking // anchors)
    blocks = saved(packed(rows, n_blocks), "blocks")
    asked = saved(packed(anchors_of(blocks), n_anchors), "anchors")
    names = ["a", "a_row", "anchor_id", "p_row", "positive_id", "score"]
    best = meeting(blocks, asked, n_blocks, n_anchors, own_label(positives), names)
    best = _ranked(best, ["a_row"], [F.col("score").desc(), "positive_id", "p_row"], positives, "place")
    best = best.groupBy("a").agg(F.collect_list(F.struct("a_row", F.col("place").cast("long").alias("place"), "positive_id", "score")).alias("positives"))
    told = asked.join(best.withColumnRenamed("a", "block"), "block").select(*asked.columns, "positives")
    names = ["a_row", "anchor_id", "place", "positive_id", "positive_score", "n_row", "negative_id", "negative_score"]
    found = meeting(blocks, saved(told, "positives"), n_blocks, n_anchors, other_labels(k, low, high), names)
    found = _ranked(found, ["a_row", "place"], [F.col("negative_score").desc(), "negative_id", "n_row"], k, "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
