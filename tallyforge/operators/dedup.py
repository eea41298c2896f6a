"""Content-addressed dedup: manifests, what is missing, hints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, digest, size): the lines of a text as its manifest."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(
        key, F.col("pos").cast("long").alias("pos"), F.md5("line").alias("digest"), F.length("line").cast("long").alias("size")
    )


def offsets(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds offset: the sum of the sizes before."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return manifest.withColumn("offset", F.sum("size").over(w) - F.col("size"))


def needed(wanted: DataFrame, held: DataFrame, key: str = "doc_id") -> DataFrame:
    """(digest, size, first_key, first_pos): distinct wanted chunks that are not held, at their first occurrence."""
    first = wanted.groupBy("digest", "size").agg(F.min(F.struct(F.col(key), F.col("pos"))).alias("f"))
    lacking = first.join(held.select("digest", "size").distinct(), ["digest", "size"], "left_anti")
    return lacking.select("digest", "size", F.col(f"f.{key}").alias("first_key"), F.col("f.pos").alias("first_pos"))


def ratio(manifest: DataFrame) -> DataFrame:
    """One row: chunks, bytes, distinct_chunks, distinct_bytes. Counted per chunk first, so no wide distinct."""
    each = manifest.groupBy("digest", "size").agg(F.count("*").alias("n"))
    return each.agg(
        F.sum("n").alias("chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count("*").alias("distinct_chunks"), F.sum("size").alias("distinct_bytes")
    )


def newest(candidates: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def manifest_refusals(manifest: DataFrame, sizes: DataFrame, key: str = "doc_id", most: int = 262144) -> DataFrame:
    """(key, reason) of manifests that cannot be right: a chunk without or with too many bytes, one digest with two
    sizes, or a sum other than the file's size."""
    two = manifest.groupBy("digest").agg(F.min("size").alias("a"), F.max("size").alias("b")).where("a <> b").select("digest", F.lit(True).alias("two"))
    m = manifest.join(two, "digest", "left")
    per = m.groupBy(key).agg(F.bool_or((F.col("size") <= 0) | (F.col("size") > most)).alias("bad"), F.bool_or(F.coalesce("two", F.lit(False))).alias("clash"), F.sum("size").alias("sum"))
    reason = F.when(F.col("bad"), "chunk-size").when(F.col("clash"), "two-sizes").when(~F.col("sum").eqNullSafe(F.col("size")), "sum")
    return per.join(sizes.select(key, "size"), key, "left").select(key, reason.alias("reason")).where("reason is not null")


_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2)


def cuts(data: bytes, least: int, normal: int, most: int) -> list[int]:
    """Ends of content-defined chunks: where the gear hash of the last 64 bytes has enough zero bits."""
    raw = _GEAR[np.frombuffer(data, np.uint8)]
    h = raw.copy()
    n, step = len(raw), 1
    while step < 64 and step < n:  # sums of shifted values over 1, 2, 4 ... 64 bytes
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    bits = int(np.log2(normal))
    strict = np.flatnonzero((h >> np.uint64(64 - bits - 1)) == 0) + 1
    easy = np.flatnonzero((h >> np.uint64(64 - bits + 1)) == 0) + 1
    out, at = [], 0
    while at < n:
        end = min(at + most, n)
        i = np.searchsorted(strict, at + least)
        if i < len(strict) and strict[i] <= min(at + normal, end):
            end = int(strict[i])
        else:
            j = np.searchsorted(easy, max(at + least, at + normal))
            if j < len(easy) and easy[j] < end:
                end = int(easy[j])
        out.append(end)
        at = end
    return out


def cdc(docs: DataFrame, least: int = 256, normal: int = 1024, most: int = 4096) -> DataFrame:
    """(doc_id, pos, start, size, digest): content-defined chunks of each text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data, at = (text or "").encode(), 0
                for pos, end in enumerate(cuts(data, least, normal, most)):
                    rows.append((key, pos, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "pos", "start", "size", "digest"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, start long, size long, digest string")
