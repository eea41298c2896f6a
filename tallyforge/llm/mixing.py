"""Operator 6: mixing sources to target weights, in built-in functions only.

The words of each source are packed into blocks of fixed length. Every output shard draws, slot
by slot, multinomial counts of the sources; the draw is then conditioned on the targets, so
that surplus slots of one source pass to sources still short. A source's slots are numbered
over all shards; a pseudorandom permutation of its block numbers, a new one for each pass
over the source, maps slots to blocks, which are joined by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import keyed, prefixed, restored, running
from .scratch import saved

WORD = "[^\\x20\\x09-\\x0D]+"
#: Most tasks that make or unfold slots.
TASKS = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text; none for null."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", n.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...], times: int) -> DataFrame:
    """A row for each source: source, rank, n_docs, source_size, target.

    Sources in code point order, null last, weigh `weights` in turn. The total of all sizes is
    shared by weight; a target stops at `times` its source's size and what it leaves is
    shared again by weight among the others. One pass over the sources ordered by the level at which they stop.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("one", F.lit(1))
    s = prefixed(s, [F.col("source").isNull(), "source"], {"rank": "one"}).drop("one")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * times).withColumn("stop", F.col("cap") / F.col("weight"))
    s = saved(prefixed(s, ["stop", "rank"], {"before": "cap", "weight_before": "weight"}), "levels")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("before")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    # the level of the first source that does not stop below it holds for all after it
    level = s.select("stop", "rank", level.alias("level")).where("stop >= level").agg(F.min_by("level", F.struct("stop", "rank")).alias("level")).first()["level"]
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), F.col("cap").cast("double"))
    return s.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast where it has at most that many rows, and merged with where it has more."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def _unit(*parts: F.Column) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def shard_counts(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """plan(rank, slots) -> (shard, rank, n): slots of each source in each shard, `slots` in all."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0
    ends = running(plan.where("slots > 0"), [], "rank", "slots", "lo")
    ends = ends.select("rank", (F.col("lo") / F.lit(total)).alias("lo"), ((F.col("lo") + F.col("slots")) / F.lit(total)).alias("hi"))
    slots = spark.range(0, total, 1, min(TASKS, 1 + total // 200_000)).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("slot"))
    slots = slots.select("shard", _unit(F.lit(seed), F.lit("slot"), F.col("shard"), F.col("slot")).alias("u"))
    # the draw: a slot's number falls into one source's part of [0, 1); met through cells of equal width
    cells = 4096
    parts = ends.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))).alias("cell"))
    drawn = (
        slots.withColumn("cell", F.floor(F.col("u") * cells))
        .join(small(parts), "cell")
        .where("u >= lo and u < hi")
        .groupBy("shard", "rank")
        .agg(F.count("*").alias("c"))
    )
    drawn = saved(drawn.join(plan.select("rank", "slots"), "rank"), "drawn")
    held = running(drawn, ["rank"], "shard", "c", "before")
    held = saved(held.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("c"), F.col("slots") - F.col("before")))), "held")
    # surplus slots, shard by shard, go to the sources still short, source by source: both are runs
    # of one line of numbers, which meet in cells of equal width
    over = held.groupBy("shard").agg(F.sum(F.col("c") - F.col("keep")).alias("n")).where("n > 0")
    kept = held.groupBy("rank").agg(F.sum("keep").alias("kept"))
    short = plan.join(kept, "rank", "left").select("rank", (F.col("slots") - F.coalesce("kept", F.lit(0))).alias("n")).where("n > 0")
    width = 1 + (over.agg(F.sum("n")).first()[0] or 0) // cells

    def runs(df: DataFrame, place: str, start: str, end: str) -> DataFrame:
        df = running(df, [], place, "n", start).withColumn(end, F.col(start) + F.col("n"))
        first, last = (F.floor(x / width) for x in (F.col(start), F.col(end) - 1))
        return df.select(place, start, end, F.explode(F.sequence(first, last)).alias("cell"))

    cuts = runs(over, "shard", "at", "to").join(small(runs(short, "rank", "a", "b")), "cell")
    low, high = F.greatest("at", "a"), F.least("to", "b")
    cuts = cuts.where((low < high) & (F.col("cell") == F.floor(low / width))).select("shard", "rank", (high - low).alias("n"))
    return held.select("shard", "rank", F.col("keep").alias("n")).union(cuts).groupBy("shard", "rank").agg(F.sum("n").alias("n")).where("n > 0")


def permuted(x: F.Column, n: F.Column, *key: F.Column, rounds: int = 24) -> F.Column:
    """Image of x in a pseudorandom permutation of 0 .. n - 1: the swap-or-not shuffle.

    Each round pairs x with k - x (mod n) and swaps the two by a bit that both share.
    """

    def turn(x: F.Column, i: F.Column) -> F.Column:
        k = F.pmod(F.xxhash64(F.lit("k"), i, *key), n)
        y = F.pmod(k - x, n)
        bit = F.xxhash64(F.lit("b"), i, *key, F.greatest(x, y)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), turn)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), times: int = 3, block: int = 64, shard_slots: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, placed): what the mix takes of each document, and which block each slot holds.

    rows: doc_id, size, source_size, target, taken, pieces (array of (from, to, uses): the text's words, block by
    block, and how often each is taken; null without words) for every row of docs(doc_id, source, text). placed: shard, rank (of
    the source), slot, index. Null and repeated ids are rows of their own; other columns are
    ignored. A null text has no word; a null source is one of its own, the last; a source without
    words gets nothing; an empty table gives no rows. No word is taken more than `times` times.
    The same rows, in any order or partitioning, give the same mix.
    """
    docs, ids = keyed(docs.select("doc_id", "source", "text"))
    sized = saved(sizes(docs), "sizes")
    s = targets(sized, weights, times)
    s = saved(
        s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn(
            "slots", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * times)).otherwise(F.lit(0))
        ),
        "sources",
    )
    counts = shard_counts(s.select("rank", "slots"), shard_slots, seed)
    # few rows that unfold into many: dealt first to as many tasks as the slots ask for, 20,000 at most, and never broadcast
    n_tasks = min(TASKS, 1 + (s.agg(F.sum("slots")).first()[0] or 0) // 50_000)
    counts = running(counts, ["rank"], "shard", "n", "base").repartition(int(n_tasks), "shard", "rank")
    slots = counts.select("shard", "rank", F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)).alias("slot"))
    at = slots.join(small(s.select("rank", "blocks")), "rank")
    placed = at.select(
        "shard", "rank", "slot",
        permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.floor(F.col("slot") / F.col("blocks"))).alias("index"),
    )
    used = placed.groupBy("rank", "index").agg(F.count("*").alias("uses"))
    # documents of a source in the order of a hashed bucket, then id: offsets are sums of whole
    # buckets and running sums within one
    known = small(s.withColumnRenamed("source", "_source"))
    in_source = sized.join(known, sized["source"].eqNullSafe(known["_source"])).select(
        "doc_id", "size", "source_size", "target", "rank", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_docs") / 5000)).alias("bucket")
    )
    buckets = in_source.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    buckets = running(buckets, ["rank"], "bucket", "held", "head").drop("held")
    offset = F.col("head") + F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("doc_id")) - F.col("size")
    laid = saved(in_source.join(buckets.hint("merge"), ["rank", "bucket"]).select("doc_id", "size", "source_size", "target", "rank", offset.alias("offset")), "laid")
    # hints: numbers of rows that unfold are not to be guessed from
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = laid.where("size > 0").select("doc_id", "rank", "offset", "size", F.explode(F.sequence(first, last)).alias("index"))
    pieces = pieces.join(used.hint("merge"), ["rank", "index"], "left").select(
        "doc_id",
        F.struct(
            F.greatest(F.col("index") * block - F.col("offset"), F.lit(0)).cast("int").alias("from"),
            F.least((F.col("index") + 1) * block - F.col("offset"), F.col("size")).cast("int").alias("to"),
            F.coalesce("uses", F.lit(0)).cast("int").alias("uses"),
        ).alias("piece"),
    )
    taken = pieces.groupBy("doc_id").agg(
        F.sum((F.col("piece.to") - F.col("piece.from")).cast("long") * F.col("piece.uses")).alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    rows = laid.select("doc_id", "size", "source_size", "target").join(taken, "doc_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return restored(rows, ids), placed


def mixed_texts(docs: DataFrame, rows: DataFrame, block: int = 64) -> DataFrame:
    """docs as the mix has them: a row for each use of a document's words.

    rows and block are those of mix_plan on the same docs, whose doc_id is distinct and not null (keyed() makes it so). The row of use e has the words taken at least e times, in order,
    joined by one space; n_chars, where there is one, is set anew and the other columns are kept.
    Documents of which nothing is taken go.
    """
    # a word's block follows from its place and where the first block ends
    of_block = rows.where("taken > 0").select(
        "doc_id", F.transform("pieces", lambda p: p["uses"]).alias("_uses"), (F.lit(block) - F.col("pieces")[0]["to"]).alias("_phase")
    )
    each = docs.join(of_block, "doc_id").withColumn("_use", F.explode(F.sequence(F.lit(1), F.array_max("_uses"))))
    taken = F.filter(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w, i: F.get("_uses", ((F.col("_phase") + i) / block).cast("int")) >= F.col("_use")
    )
    out = each.withColumn("text", F.array_join(taken, " "))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
