"""Operator 7: exact dedup, a static filter per immutable snapshot in front of exact buckets.

A snapshot's digests are dealt into buckets by their leading bits. Each bucket gets one
binary-fuse filter (three segments, 8-bit fingerprints, about 9 bits a key), built once, as
the snapshot never changes. An incoming batch is first grouped by digest on its own; one
digest of each group asks its bucket's filter; only those that pass meet the exact bucket,
where the normalised bytes of both rows are compared.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def _hashes(keys: np.ndarray, seed: int, seg: int, n_seg: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    u = np.uint64
    h = keys ^ u(seed)
    for m, s in ((0xFF51AFD7ED558CCD, 33), (0xC4CEB9FE1A85EC53, 29)):
        h = (h ^ (h >> u(s))) * u(m)
    h ^= h >> u(32)
    first = ((h >> u(32)) * u(n_seg)) >> u(32)  # the segment of the first slot
    base = first.astype(np.int64) * seg
    mask = u(seg - 1)
    g = h * u(0x9E3779B97F4A7C15)
    a = base + ((h >> u(7)) & mask).astype(np.int64)
    b = base + seg + ((g >> u(20)) & mask).astype(np.int64)
    c = base + 2 * seg + ((g >> u(42)) & mask).astype(np.int64)
    return a, b, c, ((h ^ (h >> u(23))) & u(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, fingerprints) of a binary-fuse filter over distinct 64-bit keys.

    Slots that hold one key are peeled in rounds, all of a round at once; fingerprints are then
    set in reverse order. A seed that leaves a core is replaced by the next one.
    """
    n = len(keys)
    seg = 1 << max(2, min(17, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    n_seg = max(1, -(-room // seg) - 2)
    while True:
        for seed in range(1, 40):
            slots = np.stack(_hashes(keys, seed, seg, n_seg)[:3], 1)
            size = (n_seg + 2) * seg
            count = np.bincount(slots.ravel(), minlength=size)
            total = np.zeros(size, np.int64)
            np.add.at(total, slots.ravel(), np.repeat(np.arange(n), 3))
            order = []
            left = n
            ready = np.flatnonzero(count == 1)
            while len(ready):
                key = total[ready]
                key, at = np.unique(key, return_index=True)
                order.append((key, ready[at]))
                left -= len(key)
                hit = slots[key].ravel()
                np.subtract.at(count, hit, 1)
                np.subtract.at(total, hit, np.repeat(key, 3))
                hit = np.unique(hit)
                ready = hit[count[hit] == 1]
            if not left:
                out = np.zeros(size, np.uint8)
                mark = _hashes(keys, seed, seg, n_seg)[3]
                for key, at in reversed(order):
                    three = slots[key]
                    out[at] = 0
                    out[at] = mark[key] ^ out[three[:, 0]] ^ out[three[:, 1]] ^ out[three[:, 2]]
                return seed, seg, out.tobytes()
        n_seg += max(1, n_seg // 8)


def ask_filter(keys: np.ndarray, seed: int, seg: int, marks: bytes) -> np.ndarray:
    """Whether each key may be in the filter: always for its own keys, else about once in 256."""
    t = np.frombuffer(marks, np.uint8)
    a, b, c, mark = _hashes(keys, seed, seg, len(t) // seg - 2)
    return (t[a] ^ t[b] ^ t[c]) == mark


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)


def bucket_of(n_buckets: int) -> F.Column:
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.pmod(head, F.lit(n_buckets)).cast("int")


def snapshot_filters(reps: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, seed, seg, marks): a filter for each bucket of the distinct column digest.

    A bucket holds rows / n_buckets keys, so the caller's choice of n_buckets bounds it.
    """

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, seg, marks = build_filter(np.unique(_keys(rows["digest"])))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "seg": [seg], "marks": [marks]})

    return (
        reps.select(bucket_of(n_buckets).alias("bucket"), "digest")
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed int, seg int, marks binary")
    )


def salted(incoming: DataFrame, n_buckets: int, n_salts: int) -> DataFrame:
    """(bucket, salt, digest): a bucket's digests dealt into n_salts groups, by other bits than the bucket's."""
    return incoming.select(bucket_of(n_buckets).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(n_salts)).cast("int").alias("salt"), "digest")


def screened(incoming: DataFrame, filters: DataFrame, n_buckets: int, n_salts: int = 1) -> DataFrame:
    """The digests of incoming(digest) that their bucket's filter lets through.

    A group of rows / (n_buckets * n_salts) digests asks at once; each gets its bucket's filter, about 9 bits a key.
    """

    def ask(key: tuple, rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if not len(made) or not len(rows):
            return rows[["digest"]].iloc[:0]
        f = made.iloc[0]
        return rows.loc[ask_filter(_keys(rows["digest"]), int(f["seed"]), int(f["seg"]), f["marks"]), ["digest"]]

    asked = salted(incoming, n_buckets, n_salts).groupBy("bucket", "salt")
    filters = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    return asked.cogroup(filters.groupBy("bucket", "salt")).applyInPandas(ask, "digest binary")


def shares(n_old: int, n_new: int, keys: int) -> tuple[int, int]:
    """(n_buckets, n_salts) by which neither a filter nor a group that asks it holds more than about `keys` digests."""
    n_buckets = max(1, -(-n_old // keys))
    return n_buckets, max(1, -(-n_new // (n_buckets * keys)))


class Digested(NamedTuple):
    """Texts with their digests, in tables: docs(doc_id, text), rows(doc_id, digest), groups(digest, first, n)."""

    docs: DataFrame
    rows: DataFrame
    groups: DataFrame


class Snapshot(NamedTuple):
    """An immutable snapshot: its texts and digests, and a filter for each bucket of digests, made once for any number of batches."""

    old: Digested
    filters: DataFrame
    n_keys: int


def digested(docs: DataFrame) -> Digested:
    """docs(doc_id, text) read once; doc_id is distinct and not null."""
    rows = saved(docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest")), "digests")
    return Digested(docs.select("doc_id", "text"), rows, saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups"))


def snapshot(docs: DataFrame, keys_a_bucket: int = 20_000) -> Snapshot:
    """A snapshot of docs(doc_id, text), written to the shared folder with its filters; doc_id is distinct and not null."""
    old = digested(docs)
    n = old.groups.count()
    return Snapshot(old, saved(snapshot_filters(old.groups.select("digest"), shares(n, 0, keys_a_bucket)[0]), "filters"), n)


def known(new: Digested, snap: Snapshot, keys_a_bucket: int = 20_000) -> DataFrame:
    """(digest, same) of the batch's texts that the snapshot has too: filter, exact bucket, bytes of one row of each side."""
    n_buckets, n_salts = shares(snap.n_keys, new.groups.count(), keys_a_bucket)
    passed = screened(new.groups.select("digest"), snap.filters, n_buckets, n_salts)
    # the exact bucket: the snapshot's row of the same digest, then the bytes of both
    met = saved(
        passed.join(new.groups.select("digest", F.col("first").alias("new_first")), "digest").join(snap.old.groups.select("digest", F.col("first").alias("old_first")), "digest"), "met"
    )
    sides = [side.docs.hint("merge").join(met.select("digest", F.col(name).alias("doc_id")), "doc_id") for side, name in ((new, "new_first"), (snap.old, "old_first"))]  # one plan at every size
    return sides[0].union(sides[1]).groupBy("digest").agg(F.min(normalised()).alias("a"), F.max(normalised()).alias("b")).where("a = b").select("digest", F.lit(True).alias("same"))


def arrivals(batch: DataFrame, snap: Snapshot, keys_a_bucket: int = 20_000) -> DataFrame:
    """batch(doc_id, text) against a snapshot made before: doc_id, known (the snapshot has the text), first (the batch's smallest doc_id with it), kept.

    Null and repeated ids are rows of their own, and first is null only where all ids are. kept: not known, and the row that comes first.
    """
    batch, ids = keyed(batch.select("doc_id", "text"))
    new = digested(batch)
    groups = new.groups.join(known(new, snap, keys_a_bucket), "digest", "left")
    out = new.rows.join(saved(groups, "groups"), "digest").select("doc_id", F.coalesce("same", F.lit(False)).alias("known"), "first", (F.col("same").isNull() & (F.col("doc_id") == F.col("first"))).alias("kept"))
    return restored(out, ids, "doc_id", "first")


def dedup(docs: DataFrame, in_snapshot: F.Column, keys_a_bucket: int = 20_000) -> DataFrame:
    """Exact duplicates over a snapshot and an incoming batch.

    docs: doc_id (null or repeated ids too), text; other columns are ignored. in_snapshot: which
    rows are the snapshot; the others are the batch (null counts as batch). Texts are equal when
    identical after every run of white space became one space. Null and empty texts are
    equal to one another. Returns doc_id, keep_id (the smallest doc_id of equal texts, null only if all
    are), group_size, kept (doc_id = keep_id, so null for a null id), text_sha256 for every row; an empty
    table gives no rows. Without a
    snapshot row, the batch is grouped on its own. A text of any length is digested whole.
    """
    docs, ids = keyed(docs.select("doc_id", "text", F.coalesce(in_snapshot, F.lit(False)).alias("old")))
    snap, new = snapshot(docs.where("old"), keys_a_bucket), digested(docs.where("not old"))
    both = [(snap.old, True), (new, False)]
    group, d = (reduce(DataFrame.union, [getattr(x, name).withColumn("old", F.lit(old)) for x, old in both]) for name in ("groups", "rows"))
    whole = (
        group.join(known(new, snap, keys_a_bucket), "digest", "left")
        # rows that share a digest but not their bytes stay apart, each on its own side
        .withColumn("side", F.when(F.col("same"), F.lit("both")).otherwise(F.col("old").cast("string")))
        .groupBy("digest", "side")
        .agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    one = whole.groupBy("digest").agg(
        F.min(F.when(F.col("side") != "false", F.struct("keep_id", "group_size"))).alias("of_old"),
        F.min(F.when(F.col("side") != "true", F.struct("keep_id", "group_size"))).alias("of_new"),
    )
    # read from a table, so that a digest with very many rows can be split
    rows = d.join(saved(one, "groups"), "digest").withColumn("of", F.when(F.col("old"), F.col("of_old")).otherwise(F.col("of_new")))
    out = rows.select("doc_id", F.col("of.keep_id").alias("keep_id"), F.col("of.group_size").cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    out = restored(out, ids, "doc_id", "keep_id")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def halves(docs: DataFrame) -> F.Column:
    """The condition that parts documents into an older half of the rows by id, as a snapshot, and a new batch."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5, 1000).alias("m")).first()["m"]
    return F.lit(False) if middle is None else F.col("doc_id") <= F.lit(middle)
