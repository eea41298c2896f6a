"""Smaller comparisons and roll-ups: snapshots, candidates, retention, verdicts, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attribute_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, columns): added, removed or changed, and the names of the columns that differ; equal rows are left out."""
    names = [c for c in before.columns if c != key]
    a = before.select(F.col(key), F.struct(*names).alias("a"))
    b = after.select(F.col(key), F.struct(*names).alias("b"))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    x = a.join(b, key, "full_outer").withColumn("kind", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed"))
    x = x.withColumn("columns", F.when(F.col("kind") == "changed", F.array_join(differ, ",")).otherwise(""))
    return x.where("kind <> 'changed' or columns <> ''").select(key, "kind", "columns")


def candidate_actions(base: DataFrame, candidate: DataFrame, live: DataFrame, key: str, attempts: DataFrame) -> DataFrame:
    """(key, action) of a candidate made from base, applied to live: unchanged, insert, tried (an earlier attempt's row is
    gone from live and not put back), same (live has it) or conflict. Values are structs of all columns but the key."""

    def side(x: DataFrame, name: str) -> DataFrame:
        return x.select(key, F.struct(*[c for c in x.columns if c != key]).alias(name))

    x = side(candidate, "c").join(side(base, "b"), key, "left").join(side(live, "l"), key, "left")
    x = x.join(attempts.select(key, F.lit(True).alias("tried")).distinct(), key, "left")
    action = (
        F.when(F.col("c").eqNullSafe(F.col("b")), "unchanged")
        .when(F.col("b").isNull() & F.col("l").isNull(), F.when(F.col("tried"), "tried").otherwise("insert"))
        .when(F.col("c").eqNullSafe(F.col("l")), "same")
        .otherwise("conflict")
    )
    return x.select(key, action.alias("action"))


def compose(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """incoming with provenance: equivalent (a whole row equal in base), conflict (its key is there) or inserted."""
    whole = base.select(F.struct(*base.columns).alias("_w")).distinct().withColumn("_eq", F.lit(True))
    keys = base.select(key).distinct().withColumn("_held", F.lit(True))
    x = incoming.withColumn("_w", F.struct(*base.columns)).join(whole, "_w", "left").join(keys, key, "left")
    return x.withColumn("provenance", F.when(F.col("_eq"), "equivalent").when(F.col("_held"), "conflict").otherwise("inserted")).drop("_w", "_eq", "_held")


def roll_up(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, verdict): Fail if any fails; Pass needs one pass; else Skip."""
    return verdicts.groupBy(by).agg(F.when(F.bool_or(F.col("verdict") == "Fail"), "Fail").when(F.bool_or(F.col("verdict") == "Pass"), "Pass").otherwise("Skip").alias("verdict"))


def pair_verdict(verdicts: DataFrame, gate: str) -> DataFrame:
    """(gate, verdict): PASS only if every pair passes, FAIL only if every pair fails, else INCONCLUSIVE."""
    return verdicts.groupBy(gate).agg(
        F.when(F.every(F.col("verdict") == "PASS"), "PASS").when(F.every(F.col("verdict") == "FAIL"), "FAIL").otherwise("INCONCLUSIVE").alias("verdict")
    )


def in_window(rows: DataFrame, windows: DataFrame, t: str, width: int) -> DataFrame:
    """rows with the window (start, end, name) that holds t: start <= t < end, the latest start where several do.

    Windows and rows meet through cells of `width` units of t, not all with all. Equal rows stay as many as they are;
    a null t lies in no window.
    """
    cells = windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    keys = [*rows.columns, "_n"]
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    met = rows.withColumn("_cell", F.floor(F.col(t) / width)).join(cells, "_cell").where((F.col(t) >= F.col("start")) & (F.col(t) < F.col("end")))
    return met.groupBy(*keys).agg(F.max_by(F.struct("name", "start", "end"), "start").alias("_w")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*keys[:-1], "_w.name", "_w.start", "_w.end")


def share_covered(windows: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """(name, share): how much of each window [start, end) runs (a, b), which don't overlap, cover."""
    w = windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    r = runs.where("b > a").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    met = w.join(r, "_cell").where("a < end and b > start").select("name", "start", "end", "a", "b").distinct()
    got = met.groupBy("name").agg(F.sum(F.least("b", "end") - F.greatest("a", "start")).alias("_c"))
    return windows.join(got, "name", "left").select("name", (F.coalesce("_c", F.lit(0)) / (F.col("end") - F.col("start"))).alias("share"))


def counter_deltas(samples: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """samples with delta: the counter's change since the sample before; null for the first."""
    return samples.withColumn("delta", F.col(counter) - F.lag(counter).over(W.partitionBy(by).orderBy(order)))


def ewma(samples: DataFrame, by: str, order: str, value: str, keep: float) -> DataFrame:
    """(by, load): load <- load * keep + value * (1 - keep), from 0, over each group's samples in order.

    The load is a sum of weighted samples: ranges of the order, each summed from its own end, then weighed by the
    number of samples in later ranges. A group of any size is spread over tasks. A null value counts as 0; without
    any other value the load is null.
    """
    x = samples.select(by, order, value).repartitionByRange(by, order, value).withColumn("_range", F.spark_partition_id())
    back = F.row_number().over(W.partitionBy(by, "_range").orderBy(F.desc(order), F.desc(value))) - 1
    x = x.withColumn("_back", back).groupBy(by, "_range").agg(F.sum(F.col(value) * (1 - keep) * F.pow(F.lit(keep), "_back")).alias("_s"), F.count("*").alias("_n"))
    later = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_later", later).groupBy(by).agg(F.sum(F.col("_s") * F.pow(F.lit(keep), "_later")).alias("load"))


def retained(files: DataFrame, by: list[str], order: str, size: str, most_files: int, most_bytes: int) -> DataFrame:
    """The newest files of each group, within a number of files and a sum of bytes.

    The number comes first, so that each task keeps no more than that of a group before rows are dealt.
    """
    first = files.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= most_files)
    w = W.partitionBy(*by).orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return first.withColumn("_s", F.sum(size).over(w)).where(F.col("_s") <= most_bytes).drop("_n", "_s")


def retention_holds(sources: DataFrame, files: DataFrame, now: int, margin: int) -> DataFrame:
    """One row: days (the least over the sources), holds (every file is younger than that with the margin), bytes."""
    least = sources.agg(F.min("days").alias("days"))
    return files.agg(F.min("mtime").alias("oldest"), F.sum("size").alias("bytes")).crossJoin(least).select(
        "days", (F.col("oldest") + F.col("days") * 86400 > F.lit(now + margin)).alias("holds"), "bytes"
    )


def fold_whitespace(c: Column) -> Column:
    """Ends trimmed, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), "^ | $", "")


def tracking_name(ref: Column, source: str) -> Column:
    """refs/heads/X and any other refs/X -> refs/remotes/source/X; a name outside refs/ stands whole behind it."""
    return F.concat(F.lit(f"refs/remotes/{source}/"), F.regexp_replace(ref, "^refs/(heads/)?", ""))


def placed(files: DataFrame) -> DataFrame:
    """files(source, dest) with outcome: land, or collision where several sources want one destination."""
    n = files.groupBy("dest").agg(F.count_distinct("source").alias("_n"))
    return files.join(n, "dest").withColumn("outcome", F.when(F.col("_n") > 1, "collision").otherwise("land")).drop("_n")


def prefix_proof(held: DataFrame, manifest: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, proven): whether the chunks that end within the held length have the digests held(key, pos, digest)."""
    m = manifest.join(lengths.select(key, F.col("length")), key).where(F.col("offset") + F.col("size") <= F.col("length"))
    h = held.select(key, "pos", F.col("digest").alias("_d"))
    return m.join(h, [key, "pos"], "left").groupBy(key).agg(F.bool_and(F.col("digest").eqNullSafe(F.col("_d"))).alias("proven"))


def tally(lines: DataFrame, column: str) -> DataFrame:
    """(type, n, bytes) of lines `oid type size`; `oid missing` counts as type missing."""
    p = F.split(column, " ")
    return lines.select(F.get(p, F.lit(1)).alias("type"), F.get(p, F.lit(2)).cast("long").alias("size")).groupBy("type").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def carried_over(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that stand for each source: of its latest record, and, where that did not complete, of the record before.

    records(source, session, started, completed), entries(source, session, path).
    """
    w = W.partitionBy("source").orderBy(F.desc("started"))
    r = records.withColumn("_n", F.row_number().over(w)).withColumn("_last_done", F.first("completed").over(w)).where((F.col("_n") == 1) | ((F.col("_n") == 2) & ~F.col("_last_done")))
    return entries.join(r.select("source", "session"), ["source", "session"]).select("source", "path").distinct()
