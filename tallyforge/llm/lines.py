"""Operator 4: line dedup by overlapping three-line windows, in built-in functions only.

Every run of three consecutive lines is a window. Of equal windows over all documents, the
first by (doc_id, line) stays; a line is removed if a later occurrence covers it. The spans of
one document are merged before its text is rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, restored
from .scratch import saved


def line_dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text -> doc_id, n_lines, n_removed, kept_text for every row.

    Lines are the parts of the text between line feeds. Texts with fewer than `size`
    lines have no window and stay as they are; a null text has no line and stays null;
    an empty text is one empty line. Repeats within one document count: its first window
    stays. Null and repeated ids are rows of their own, null after all others; other columns are ignored.
    """
    d, ids = keyed(docs.select("doc_id", "text"))
    lines = F.split("text", "\n", -1)
    # two independent 64-bit hashes of each line, folded over the window's lines
    hashed = d.select("doc_id", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), F.reverse(x), x).alias("b"))).alias("h"))
    wins = hashed.where(F.size("h") >= size).select(
        "doc_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("h") - size),
                lambda i: F.struct(
                    F.xxhash64(*[F.get("h", i + j)["a"] for j in range(size)]).alias("a"),
                    F.xxhash64(F.lit(11), *[F.get("h", i + j)["b"] for j in range(size)]).alias("b"),
                ),
            )
        ).alias("pos", "key"),
    ).select("doc_id", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    first = (
        wins.groupBy("a", "b")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("a", "b", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    )
    # read from a table, so that the rows of a very common window can be split
    later = (
        wins.join(saved(first, "windows"), ["a", "b"])
        .where((F.col("doc_id") != F.col("first_doc")) | (F.col("pos") != F.col("first_pos")))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("pos")).alias("at"))
    )
    # sorted starts to merged spans: a span begins where the gap to the start before is wider than a
    # window, and ends where the gap to the next is
    begins = F.filter("at", lambda p, i: (i == 0) | (p > F.get("at", i - 1) + size))
    stops = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > p + size))
    spans = later.select(
        "doc_id", F.transform(F.arrays_zip(begins.alias("a"), stops.alias("b")), lambda z: F.struct(z["a"].alias("a"), (z["b"] + size).alias("b"))).alias("gone")
    )
    both = d.join(spans, "doc_id", "left").withColumn("lines", lines)
    # what stays are the slices between the merged spans
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda s: s["b"]))
    ends = F.concat(F.transform("gone", lambda s: s["a"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice("lines", z["s"] + 1, z["e"] - z["s"])))
    removed = F.aggregate("gone", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    out = both.select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
    return restored(out, ids)
