"""Named references: three-way decisions, classes, ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.incremental import work_folder


def decide(native: DataFrame, ledger: DataFrame, carried: DataFrame) -> DataFrame:
    """(name, action): native(name, oid, checked_out), ledger(name, oid null for a tombstone, t), carried(name, oid, t).

    The first rule that holds decides. Names are distinct on each side.
    """
    n = native.select("name", F.col("oid").alias("n"), "checked_out")
    l = ledger.select("name", F.col("oid").alias("l"), F.col("t").alias("tl"), F.lit(True).alias("row"))
    c = carried.select("name", F.col("oid").alias("c"), F.col("t").alias("t"))
    x = n.join(l, "name", "full_outer").join(c, "name", "full_outer")
    n, l, c, row = F.col("n"), F.col("l"), F.col("c"), F.coalesce("row", F.lit(False))
    tomb = row & l.isNull()
    newer = F.coalesce(F.col("t"), F.lit(0)) > F.coalesce(F.col("tl"), F.lit(-1))
    action = (
        F.when(F.coalesce("checked_out", F.lit(False)), "skip")
        .when(tomb & c.isNotNull() & ~newer, "stale")
        .when(n.isNull() & c.isNull(), F.when(tomb, "move-tombstone").otherwise("deleted-at-both"))
        .when(n.isNull() & (~row | tomb), "create")
        .when(n.isNull(), "deleted-at-destination")
        .when((~row | tomb) & (n == c), "adopt")
        .when(~row | tomb, "keep-dest")
        .when(n != l, "modified")
        .when(n == c, "verify")
        .when(c.isNotNull() & ~newer, "stale")
        .when(c.isNotNull(), "move")
        .when(F.col("name").startswith("refs/remotes/"), "prune")
        .otherwise("deleted-at-source")
    )
    return x.select("name", action.alias("action"))


def ancestry(edges: DataFrame) -> DataFrame:
    """(child, ancestor, steps): the whole closure of edges(child, parent); the fewest steps count. Edges with a null end are none.

    Each round joins on only the pairs that the round before found first, and writes what is new to the
    shared folder, until nothing is.
    """
    spark = edges.sparkSession
    folder = work_folder(spark)
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    e.write.parquet(f"{folder}/edges")
    e = spark.read.schema(e.schema).parquet(f"{folder}/edges")
    found = e.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    schema, steps = found.schema, 1
    while True:
        found.write.parquet(f"{folder}/pairs/{steps}")
        last = spark.read.schema(schema).parquet(f"{folder}/pairs/{steps}")
        every = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/pairs")
        if last.isEmpty():
            return every
        steps += 1
        on = last.select("child", F.col("ancestor").alias("via")).join(e.withColumnRenamed("child", "via"), "via")
        found = on.select("child", F.col("parent").alias("ancestor")).distinct().join(every, ["child", "ancestor"], "left_anti").withColumn("steps", F.lit(steps))


def classes(source: DataFrame, dest: DataFrame, closure: DataFrame) -> DataFrame:
    """(name, class): same, source-only, dest-only, source-ahead, dest-ahead or diverged."""
    x = source.select("name", F.col("oid").alias("s")).join(dest.select("name", F.col("oid").alias("d")), "name", "full_outer")
    ahead = closure.select(F.col("child").alias("s"), F.col("ancestor").alias("d"), F.lit(True).alias("s_ahead"))
    behind = closure.select(F.col("child").alias("d"), F.col("ancestor").alias("s"), F.lit(True).alias("d_ahead"))
    x = x.join(ahead, ["s", "d"], "left").join(behind, ["s", "d"], "left")
    kind = (
        F.when(F.col("d").isNull(), "source-only")
        .when(F.col("s").isNull(), "dest-only")
        .when(F.col("s") == F.col("d"), "same")
        .when(F.col("s_ahead"), "source-ahead")
        .when(F.col("d_ahead"), "dest-ahead")
        .otherwise("diverged")
    )
    return x.select("name", kind.alias("class"))


def name_conflicts(creates: DataFrame, names: DataFrame) -> DataFrame:
    """creates(name) that are a path prefix of, or lie under, another name that will exist."""
    every = names.select("name").union(creates.select("name")).distinct()
    parts = F.split("name", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = every.where(F.size(parts) > 1).select("name", F.explode(up).alias("prefix"))
    clash = above.join(every.select(F.col("name").alias("prefix")), "prefix")
    bad = clash.select(F.explode(F.array("name", "prefix")).alias("name")).distinct()
    return creates.select("name").distinct().join(bad, "name", "left_semi")
