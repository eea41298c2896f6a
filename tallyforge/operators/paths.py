"""Path prefixes: the longest that owns a path, rewriting, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column, sep: str = "/") -> Column:
    """The path and every whole-component prefix of it."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def owners(paths: DataFrame, path: str, maps: DataFrame) -> DataFrame:
    """paths with owner and target of the longest prefix in maps(owner, target), null without one.

    Every path unfolds into its prefixes, which meet the maps by equality: no comparison of all with all. maps'
    owners are distinct.
    """
    up = paths.withColumn("_prefix", F.explode(ancestors(F.col(path))))
    hit = up.join(maps.select(F.col("owner").alias("_prefix"), "target"), "_prefix")
    keys = [c for c in paths.columns]
    best = hit.groupBy(*keys).agg(F.max_by(F.struct(F.col("_prefix").alias("owner"), "target"), F.length("_prefix")).alias("_m"))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    return paths.alias("p").join(best.alias("b"), on, "left").select(*[F.col(f"p.{c}").alias(c) for c in keys], F.col("b._m.owner").alias("owner"), F.col("b._m.target").alias("target"))


def mapped(path: Column, owner: Column, target: Column) -> Column:
    """The path with its owner replaced by the target; unchanged without an owner."""
    return F.when(owner.isNull(), path).otherwise(F.concat(target, F.substring(path, F.length(owner) + 1, F.length(path))))


def overlaps(roots: DataFrame) -> DataFrame:
    """(inner, outer): roots(id, root) equal to or under another one's path; of equal roots the smallest id stands for all, so no pairs of all with all."""
    up = roots.select(F.col("id").alias("inner"), F.explode(ancestors(F.col("root"))).alias("_p"))
    r = roots.groupBy(F.col("root").alias("_p")).agg(F.min("id").alias("outer"))
    return up.join(r, "_p").where(F.col("inner") != F.col("outer")).select("inner", "outer")


def project_key(path: Column) -> Column:
    """A name made of a path: every character but letters and digits becomes a dash. For up to 200 characters of the basic plane."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def unique_keys(pairs: DataFrame) -> DataFrame:
    """pairs(source, target) with usable: neither side's key stands for two."""
    d = pairs.distinct()
    s = d.groupBy("source").agg(F.count("*").alias("_s"))
    t = d.groupBy("target").agg(F.count("*").alias("_t"))
    return d.join(s, "source").join(t, "target").select("source", "target", ((F.col("_s") == 1) & (F.col("_t") == 1)).alias("usable"))
