"""Operator 11: resampling documents towards a target by hashed n-gram features.

Runs of one to three words are counted in buckets, over all documents and over all target texts. A
bucket's gain is the logarithm of the ratio of its two shares, a document's weight the sum of its
features' gains; weights and Gumbel noise that the id seeds order the draw.

A very long text is no task's alone: it is cut at word borders into chunks that carry the first n - 1
words of the next one, and each chunk owns the features that start in its own words. Counts and
weights of chunks are summed by document. Chunks of long texts are a table; short texts are read
where they lie.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, numbered, ordered
from .scratch import saved
from .words import _LOWER, Words, sub_batches, texts_of

#: Texts of more bytes are cut into chunks of so many words; neither changes a result.
LONG, CHUNK = 1 << 18, 1 << 15
#: Longer words go through zlib one by one.
WIDE = 64


def _outside() -> np.ndarray:
    """The bytes that part words: ASCII without digits and letters."""
    out = np.zeros(256, bool)
    out[:128] = [not chr(c).isalnum() for c in range(128)]
    return out


def _steps() -> np.ndarray:
    """The CRC-32 register after each byte, from the polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


BETWEEN, STEP = _outside(), _steps()


def fed(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after the words raw[start:start + size], one for each state: a byte of all words at a time."""
    order = np.argsort(-size, kind="stable")
    s, at, size = state[order], start[order], size[order]
    wide = int(np.searchsorted(-size, -WIDE, "left"))
    for i in range(wide):
        word = raw[at[i] : at[i] + size[i]].tobytes()
        s[i] = zlib.crc32(word, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for p in range(int(size[wide]) if wide < len(size) else 0):
        to = int(np.searchsorted(-size, -p, "left"))
        now = s[wide:to]
        s[wide:to] = STEP[(now ^ raw[at[wide:to] + p]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    return out


def features(w: Words, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to n words: (index of the first word, bucket) of each run inside one text."""
    raw = _LOWER[w.raw]
    size = w.end - w.start
    state = fed(np.full(len(size), 0xFFFFFFFF, np.uint32), raw, w.start, size)
    at = np.arange(len(size))
    yield at, (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    for k in range(1, n):
        inside = at + k < len(size)
        inside[inside] = w.doc[at[inside] + k] == w.doc[at[inside]]
        at, state = at[inside], state[inside]
        state = STEP[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = fed(state, raw, w.start[at + k], size[at + k])
        yield at, (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)


def chunks(batches: Iterator[pa.RecordBatch], n: int, words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, at, own, text: pieces of `words` words each, with the n - 1 words after them."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text").slice(i, 1)
            w = Words(text, hashes=False, between=BETWEEN)
            for at in range(0, len(w.start), words):
                own, last = min(words, len(w.start) - at), min(at + words + n - 1, len(w.start))
                piece = w.raw[w.start[at] : w.end[last - 1]].tobytes().decode()
                columns = [batch.column("doc_id").slice(i, 1), pa.array([at], pa.int64()), pa.array([own], pa.int64()), pa.array([piece])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "own", "text"])


def _read(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, own words of each text, and the features that start in own words."""
    w = Words(texts_of(batch), hashes=False, between=BETWEEN)
    own = w.count
    if "own" in batch.schema.names:
        own = np.minimum(own, batch.column("own").fill_null(2**62).to_numpy(zero_copy_only=False))
    mine = np.arange(len(w.start)) - w.first[:-1][w.doc] < own[w.doc]
    return w, own, [(at[mine[at]], bucket[mine[at]]) for at, bucket in features(w, n, buckets)]


def counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: features in each bucket that has any. Each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sub_batches(batch):
                for _, bucket in _read(part, n, buckets)[2]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: dict[int, int], source: dict[int, int], buckets: int) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its share of the target over that of the source, one added to each."""
    t, s = float(sum(target.values()) + buckets), float(sum(source.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((source.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each text or chunk."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                w, own, found = _read(part, n, len(gain))
                many, sums = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for at, bucket in found:
                    many += np.bincount(w.doc[at], minlength=part.num_rows)
                    sums += np.bincount(w.doc[at], weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
                columns = [part.column("doc_id"), pa.array(own.astype(np.int64)), pa.array(many), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42, long: int = LONG, words: int = CHUNK) -> DataFrame:
    """doc_id, text and target texts -> doc_id, n_words, n_features, weight, score, rank for every row.

    floor(percent * N / 100) rows are drawn of the N with `least` words or more: the highest scores, ties to
    smaller ids, rank from 1; rank is null elsewhere. Texts without words (null, empty, signs only) have no feature, weight 0 and a
    score, and are never drawn unless `least` is 0. Repeated texts weigh the same, and repeated or null ids are rows of their own
    (null ids share the noise of an empty id, and lose ties). An empty table gives no rows; an empty target gives all buckets the gain of
    absence. Other columns are ignored.
    """
    docs, ids = keyed(docs.select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))

    def cut(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        pieces = texts.where(size > long).mapInArrow(lambda batches: chunks(batches, n, words), "doc_id long, at long, own long, text string")
        return texts.where(size <= long), saved(pieces.repartition("doc_id", "at"), "chunks")

    def counted(short: DataFrame, pieces: DataFrame) -> dict[int, int]:
        # one row for each bucket
        both = counts(short, n, buckets).unionByName(counts(pieces, n, buckets))
        return dict(map(tuple, both.groupBy("bucket").agg(F.sum("n")).collect()))

    short, pieces = cut(docs)
    other = cut(target.select(F.lit(0).cast("long").alias("doc_id"), "text"))
    gain = gains(counted(*other), counted(short, pieces), buckets)
    whole = weighed(pieces, gain, n).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    # a long text without words has no chunk
    bare = docs.where(size > long).select("doc_id").join(pieces.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")])
    rows = weighed(short, gain, n).unionByName(whole).unionByName(bare).withColumnRenamed("doc_id", "_key")
    rows = rows.withColumn("doc_id", F.col("_key")) if ids is None else rows.join(ids.select(F.col("row").alias("_key"), F.col("id").alias("doc_id")), "_key")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = saved(rows.withColumn("score", F.col("weight") + noise), "scores")
    return _ranked(rows, percent, least)


def _ranked(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """rows with their rank: those that may be drawn come first in one global order."""
    able = F.col("n_words") >= least
    placed = numbered(ordered(rows, ~able, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_key"), "_place")
    draw = percent * rows.where(able).count() // 100
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_place") < draw, F.col("_place") + 1).alias("rank"))
