"""Operator 2: substring dedup by seed and extend.

Seeds are winnowed anchors: of every stretch of consecutive k-word hashes that one window
spans, the smallest is kept, so equal windows keep equal anchors. Documents join on anchors, and a match
grows to the left and to the right of its anchor up to the first word that differs, as far as windows that
hold the anchor reach. Documents with the same words all round an anchor are one: the earliest stands for
them. The others meet the earliest document of their anchor; a match of a window's length or more is a
repeat, and the windows beyond it go on, by the word that differed, to meet those that have the same word
there. Overlapping matches of neighbouring anchors add up to the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved
from .words import Words, as_long, grams, mix, spans, sub_batches, texts_of


def _slide(x: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over each run of `size` values: block-wise running values from both ends."""
    n = len(x) - size + 1
    fill = np.iinfo(x.dtype).max if f is np.minimum else 0
    pad = np.full(-len(x) % size, fill, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, size)
    fore = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], fore[size - 1 : size - 1 + n])


class Anchors:
    """Anchors of the texts of a batch: word position, hash, and the windows round them."""

    def __init__(self, texts: pa.Array, window: int, k: int):
        self.words = w = Words(texts)
        self.window, reach = window, window - k + 1  # anchors compared in a window
        at, h = grams(w, k, salt=2)[1:]
        n = len(w.hash)
        none = np.iinfo(np.uint64).max
        each = np.full(max(n, reach), none, np.uint64)
        each[at] = np.minimum(h, none - np.uint64(1))
        low = _slide(each, reach, np.minimum)  # per window start
        # only windows inside one text count
        ok = np.zeros(len(low), bool)
        m = min(len(low), max(0, n - window + 1))
        ok[:m] = w.doc[:m] == w.doc[window - 1 : window - 1 + m]
        self.low = low = np.where(ok, low, np.uint64(0))
        self.ok = ok
        # a position is kept if it is the least of some window that holds it
        pad = np.concatenate([np.zeros(reach - 1, np.uint64), low, np.zeros(max(0, n - len(low)), np.uint64)])
        top = _slide(pad, reach, np.maximum)[:n] if n else np.zeros(0, np.uint64)
        self.at = np.flatnonzero((each[:n] == top) & (top > 0) & (each[:n] < none))
        self.hash = each[self.at]
        d = w.doc[self.at]
        self.doc = d
        first, last = w.first[d], w.first[d + 1]
        #: the windows that hold an anchor start from a to b - 1
        self.a = np.maximum(first, self.at - reach + 1)
        self.b = np.minimum(self.at, last - window) + 1
        self.pos = self.at - first

    def surroundings(self) -> np.ndarray:
        """Hash of all words of all windows that hold each anchor, and of where it stands in them."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        h = spans(self.words, self.a, self.b + self.window - 1)
        return h * np.uint64(0x9E3779B97F4A7C15) + (self.at - self.a).astype(np.uint64)


def _anchor_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, pos, anchor, around): every anchor, its position and the hash of its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                a = Anchors(texts_of(part), window, k)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("doc_id"), pa.array(a.doc)), pa.array(a.pos.astype(np.int32)), pa.array(as_long(a.hash)), pa.array(as_long(a.surroundings()))],
                    ["doc_id", "pos", "anchor", "around"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, anchor long, around long")


def _seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs(doc_id, text, at) -> (doc_id, pos, anchor, left, right): the words before and after the anchors at positions `at`.

    Hashes of words, the nearest first, no more than a window that holds the anchor can reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                a = Anchors(texts_of(part), window, k)
                asked = part.column("at")
                where = np.asarray(asked.flatten()) + np.repeat(a.words.first[:-1], np.diff(asked.offsets.to_numpy()))
                one = np.isin(a.at, where)
                at, doc = a.at[one], a.doc[one]
                first, last = a.words.first[doc], a.words.first[doc + 1]
                n_left, n_right = np.minimum(window - k, at - first), np.minimum(window - k, last - at - k)
                left = np.repeat(at - 1 + np.cumsum(n_left) - n_left, n_left) - np.arange(n_left.sum())
                right = np.repeat(at + k - np.cumsum(n_right) + n_right, n_right) + np.arange(n_right.sum())
                words = as_long(a.words.hash)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(part.column("doc_id"), pa.array(doc)), pa.array((at - first).astype(np.int32)), pa.array(as_long(a.hash[one])),
                        *(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(words[i])) for n, i in ((n_left, left), (n_right, right))),
                    ],
                    ["doc_id", "pos", "anchor", "left", "right"],
                )

    return docs.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, pos int, anchor long, left array<long>, right array<long>")


def _common(a: str, b: str) -> F.Column:
    """How many elements from the first on two arrays have in common."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return F.when(differ == 0, F.least(F.size(a), F.size(b))).otherwise(differ - 1)


def _square(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of equal width, the length of each) of lists no longer than that."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out, n


def _grown(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], lo: np.ndarray, hi: np.ndarray, k: int) -> list[np.ndarray]:
    """The rounds of extended() for groups that are there whole: [doc_id, from, to]."""
    spare = sides[0][0].shape[1]
    row = np.arange(len(doc))
    out: list[list[np.ndarray]] = [[], [], []]
    while len(row):
        order = np.lexsort((pos[row], doc[row], group))
        group, row, lo, hi = group[order], row[order], lo[order], hi[order]
        new = np.ones(len(row), bool)
        new[1:] = group[1:] != group[:-1]
        start = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        last = np.append(start[1:], len(row)) - 1
        several = (doc[row[start]] < doc[row[last]])[at]
        group, row, lo, hi, owner = group[several], row[several], lo[several], hi[several], row[start][at][several]
        reach = []
        for words, n in sides:
            differ = np.ones((len(row), spare + 1), bool)
            differ[:, :spare] = (words[row] != words[owner]) | (np.arange(spare) >= np.minimum(n[row], n[owner])[:, None])
            reach.append(differ.argmax(1))
        l, r = reach
        hit = (doc[owner] < doc[row]) & (l + r >= spare)
        for o, x in zip(out, (doc[row], pos[row] - l, pos[row] + k + r), strict=True):
            o.append(x[hit])
        left = np.flatnonzero(np.maximum(lo, l + 1) <= hi)
        stop = np.minimum(np.minimum(hi, l), spare - 1 - r)
        right = np.flatnonzero(lo <= stop)
        keys = [
            mix(mix(group[i].view(np.uint64) + np.uint64(2 * s + 1)) + mix(words[row[i], x[i]].view(np.uint64) + x[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            for s, (i, (words, _), x) in enumerate(((left, sides[0], l), (right, sides[1], r)))
        ]
        group = np.concatenate(keys).view(np.int64)
        lo, hi, row = (np.concatenate(x) for x in ((np.maximum(lo, l + 1)[left], lo[right]), (hi[left], stop[right]), (row[left], row[right])))
    return [np.concatenate([np.zeros(0, np.int64), *o]) for o in out]


def _together(open_: DataFrame, window: int, k: int, most: int = 40_000) -> DataFrame:
    """extended() for rows of groups that a task can hold: dealt by group, some `most` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            one = {c: rows[c].chunk(0) for c in rows.column_names}
            sides = [_square(one[c], window - k) for c in ("left", "right")]
            got = _grown(*(one[c].to_numpy().astype(np.int64) for c in ("group", "doc_id", "pos")), sides, *(one[c].to_numpy().astype(np.int64) for c in ("lo", "hi")), k)
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1].astype(np.int32)), pa.array(got[2].astype(np.int32))], ["doc_id", "from", "to"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) > most:
                rows = pa.Table.from_batches(held)
                group = rows["group"].to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield close(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    dealt = open_.select("group", "doc_id", "pos", "left", "right", "lo", "hi").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "doc_id long, from int, to int")


def extended(seeds: DataFrame, window: int, k: int, large: DataFrame | None, most: int) -> DataFrame:
    """seeds(doc_id, pos, anchor, left, right) -> (doc_id, from, to): words that repeat an earlier document's, a window or more.

    Each round compares a seed with the earliest one of its group, at first all seeds of an anchor. Windows are
    known by how many words they begin before the anchor. Those that the match covers are settled; those that begin
    before it go on with the seeds that have the same word before it, those that end behind it with the same
    word behind it. A group's match grows by a word each round, so 2 * (window - k) rounds are the most. Groups of
    up to `most` seeds meet in a task, which does all rounds; large(anchor) has more, and its rounds are joins
    until what is left of a group is small.
    """
    spare = window - k
    open_ = seeds.select(
        F.col("anchor").alias("group"), "doc_id", "pos", "left", "right", F.greatest(F.lit(0), spare - F.size("right")).alias("lo"), F.least(F.lit(spare), F.size("left")).alias("hi")
    ).where("lo <= hi")
    if large is None:
        return _together(open_, window, k)
    large = large.withColumnRenamed("anchor", "group")
    small, open_ = [open_.join(large, "group", "left_anti")], saved(open_.join(large, "group", "left_semi"), "open")
    found = None
    while not open_.isEmpty():
        head = open_.groupBy("group").agg(F.min_by(F.struct("doc_id", "left", "right"), F.struct("doc_id", "pos")).alias("o"))
        # what is joined on a key that very many rows may have is read from tables, so that the key's rows can be split
        head = saved(head.select("group", F.col("o.doc_id").alias("owner"), F.col("o.left").alias("o_left"), F.col("o.right").alias("o_right")), "heads")
        met = open_.join(head, "group").withColumns({"l": _common("left", "o_left"), "r": _common("right", "o_right")}).drop("o_left", "o_right")
        met = saved(met, "met")
        match = met.where((F.col("owner") < F.col("doc_id")) & (F.col("l") + F.col("r") >= spare)).select("doc_id", (F.col("pos") - F.col("l")).alias("from"), (F.col("pos") + k + F.col("r")).alias("to"))
        found = match if found is None else found.union(match)
        sides = {
            "L": ("left", "l", F.greatest("lo", F.col("l") + 1), F.col("hi")),
            "R": ("right", "r", F.col("lo"), F.least("hi", "l", spare - 1 - F.col("r"))),
        }
        rest = None
        for side, (words, at, lo, hi) in sides.items():
            one = met.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
            one = one.select(F.xxhash64("group", F.lit(side), at, F.get(words, F.col(at))).alias("group"), "doc_id", "pos", "left", "right", "lo", "hi")
            rest = one if rest is None else rest.union(one)
        rest = saved(rest, "rest")
        sizes = saved(rest.groupBy("group").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("group", "n"), "sizes")
        small.append(rest.join(sizes.where(F.col("n") <= most).select("group"), "group", "left_semi"))
        open_ = saved(rest.join(sizes.where(F.col("n") > most).select("group"), "group", "left_semi"), "open")
    small = _together(reduce(DataFrame.union, small), window, k)
    return small if found is None else small.union(found)


def _cut(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, gone: array of (from, to)) -> doc_id, n_words, n_removed, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                texts = texts_of(part)
                w = Words(texts, hashes=False)
                step = np.zeros(len(w.start) + 1, np.int64)
                gone = part.column("gone")
                if gone.null_count < len(gone):
                    flat = gone.flatten()
                    size = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
                    base = np.repeat(w.first[:-1], size)
                    np.add.at(step, flat.field("from").to_numpy() + base, 1)
                    # surroundings end with the text
                    np.add.at(step, np.minimum(flat.field("to").to_numpy(), np.repeat(w.count, size)) + base, -1)
                keep = np.cumsum(step)[:-1] == 0
                n_kept = np.bincount(w.doc[keep], minlength=len(texts)) if len(keep) else np.zeros(len(texts), np.int64)
                whole = np.flatnonzero(keep)
                raw = w.raw.tobytes()
                pieces = [raw[a:b] for a, b in zip(w.start[whole].tolist(), w.end[whole].tolist(), strict=True)]
                ends = np.cumsum(n_kept)
                kept = [b" ".join(pieces[b - n : b]) for b, n in zip(ends.tolist(), n_kept.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array((w.count - n_kept).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return docs.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def repeats(docs: DataFrame, window: int = 50, k: int = 16, most: int = 20_000) -> DataFrame:
    """(doc_id, from, to): stretches of words, of `window` or more, that also stand in a document with a smaller doc_id.

    Stretches reach as far as the windows of one anchor; together they cover the maximal repeats. doc_id is distinct and not null.
    """
    rows = saved(_anchor_rows(docs, window, k), "anchors")
    reach = window - k + 1
    met = rows.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    rows = saved(rows.join(saved(met, "met"), "anchor"), "shared")
    # the same words all round: the earliest document stands for the others, whose match reaches as far as windows do
    kinds = saved(rows.groupBy("anchor", "around").agg(F.min(F.struct("doc_id", "pos")).alias("o")).select("anchor", "around", F.col("o.doc_id").alias("owner"), F.col("o.pos").alias("owner_pos")), "kinds")
    several = saved(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    inner = rows.join(kinds, ["anchor", "around"]).where("owner < doc_id").select(
        "doc_id", F.greatest(F.col("pos") - reach + 1, F.lit(0)).alias("from"), (F.col("pos") + window).alias("to")
    )
    # different words somewhere: the earliest of each kind extend their matches with one another
    asked = kinds.join(several.select("anchor"), "anchor", "left_semi").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("owner_pos").alias("at"))
    seeds = saved(_seeds(docs.hint("merge").join(asked, "doc_id"), window, k), "seeds")
    large = several.where(F.col("kinds") > most).select("anchor")
    return inner.union(extended(seeds, window, k, None if large.isEmpty() else large, most))


def substring_dedup(docs: DataFrame, window: int = 50, k: int = 16, most: int = 20_000) -> DataFrame:
    """Removes words covered by a `window`-word sequence that also starts in an earlier document.

    docs: doc_id (null and repeated ids are rows of their own, null after all others), text; other columns are ignored. Earlier means a smaller
    doc_id. Windows are judged on the input, not on what is left; repeats within one row
    stay. Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) for every row. A
    null or empty text has no word and an empty kept_text; texts shorter than a window keep all;
    an empty table gives no rows. Keys are 64-bit hashes of words and of runs of words. A text of any length is read
    whole, in one slice of a task that takes some twenty times its size.
    """
    docs, ids = keyed(docs.select("doc_id", "text"))
    gone = repeats(docs, window, k, most).groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    return restored(_cut(docs.hint("merge").join(gone, "doc_id", "left")), ids)
