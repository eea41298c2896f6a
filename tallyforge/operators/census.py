"""Inventories: classes, histograms, rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import git_class


def path_class(path: Column) -> Column:
    """sqlite, append-log, config or opaque, by a path's ending; a sidecar goes with its store. Null for null."""
    bare = F.regexp_replace(path, "-(wal|shm|journal)$", "")
    return (
        F.when(path.isNull(), F.lit(None).cast("string"))
        .when(bare.rlike(r"\.(sqlite|sqlite3|db)$"), "sqlite")
        .when(path.endswith(".jsonl"), "append-log")
        .when(path.rlike(r"\.(json|toml)$"), "config")
        .otherwise("opaque")
    )


def bucket(value: Column, edges: list[int]) -> Column:
    """The first edge at or above the value: intervals closed on the right; null beyond the last."""
    out = F.when(F.lit(False), F.lit(None).cast("long"))
    for e in edges:
        out = out.when(value <= e, F.lit(e).cast("long"))
    return out


def totals(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """by..., files, bytes."""
    return rows.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def histogram(rows: DataFrame, size: str, edges: list[int]) -> DataFrame:
    """edge (null: above all), files, bytes."""
    return totals(rows.withColumn("edge", bucket(F.col(size), edges)), ["edge"], size)


def ranked_values(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(q, value): the value of rank int(q * (n - 1) + 0.5), counted from 0, for each share q.

    Equal values are counted together first. Running counts are sums of whole cells, whose
    borders are approximate quantiles, and running sums within one cell, so no task sees all.
    Nulls take no part; no rows give no rows.
    """
    seen = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    borders = seen.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("borders"))
    seen = seen.crossJoin(F.broadcast(borders))  # one row
    seen = seen.select("v", "n", F.size(F.filter("borders", lambda b: b < F.col("v"))).alias("cell"))
    cells = seen.groupBy("cell").agg(F.sum("n").alias("held"))
    cells = cells.select("cell", (F.sum("held").over(W.orderBy("cell")) - F.col("held")).alias("before"), F.sum("held").over(W.partitionBy()).alias("all"))
    at = seen.join(F.broadcast(cells), "cell").withColumn("hi", F.col("before") + F.sum("n").over(W.partitionBy("cell").orderBy("v")))
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.lit(q) * (F.col("all") - 1) + 0.5).alias("rank")) for q in shares]))
    return (
        at.select("v", "n", "hi", asked.alias("a"))
        .where((F.col("a.rank") < F.col("hi")) & (F.col("a.rank") >= F.col("hi") - F.col("n")))
        .select(F.col("a.q").alias("q"), F.col("v").alias("value"))
    )


def sidecars(files: DataFrame) -> DataFrame:
    """(path, base): each write-ahead, shared-memory or journal file and the store it belongs to, null where that is missing."""
    side = files.where(F.col("path").rlike("-(wal|shm|journal)$")).select("path", F.regexp_replace("path", "-(wal|shm|journal)$", "").alias("base"))
    held = files.select(F.col("path").alias("base"), F.lit(True).alias("held")).distinct()
    return side.join(held, "base", "left").select("path", F.when(F.col("held"), F.col("base")).alias("base"))


def depth_refusals(files: DataFrame, deepest: int = 256, longest: int = 4095) -> DataFrame:
    """files with refusal: too-deep, too-long or null."""
    return files.withColumn(
        "refusal", F.when(F.size(F.split("path", "/")) > deepest, "too-deep").when(F.octet_length("path") > longest, "too-long")
    )


def fan_out(files: DataFrame) -> DataFrame:
    """(dir, children): direct children of each directory."""
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).groupBy("dir").agg(F.count("*").alias("children"))


def repo_metrics(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, eleven counts and sums of bytes) for each of repos(repo), 0 where there are no files.

    files(repo, below, size): below is the path inside the repository's own directory, null for a file of the checkout.
    """
    git = F.col("below").isNotNull()
    kind = F.when(git, git_class(F.col("below")))
    size = F.col("size")

    def both(name: str, amount: str, of: Column) -> list[Column]:
        return [F.count_if(of).alias(name), F.coalesce(F.sum(F.when(of, size)), F.lit(0)).cast("long").alias(amount)]

    admin = F.when(F.col("below").rlike("^worktrees/[^/]+/"), F.split("below", "/")[1])
    sums = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"), *both("git_files", "git_bytes", git), *both("loose", "loose_bytes", F.coalesce(kind == "git-loose", F.lit(False))), *both("packs", "pack_bytes", F.coalesce(kind == "git-pack", F.lit(False))),
        *both("checkout_files", "checkout_bytes", ~git), F.count_distinct(admin).alias("worktree_admins"),
    )
    names = [c for c in sums.columns if c != "repo"]
    return repos.select("repo").distinct().join(sums, "repo", "left").select("repo", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])


def distribution(rows: DataFrame, by: list[str], metrics: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """(by..., metric, sum, p10, p50, p90, p99, max) of each metric, a whole-number column, in each group: exact, all of them in one pass.

    A share q is the value of rank int(q * (n - 1) + 0.5), counted from 0. Equal values of a group and metric are counted together; running
    counts are sums of cells between approximate quantiles, then sums within one cell, so that neither a large group nor a metric is one
    task's. Nulls take no part; a group without values has nulls.
    """
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99} if shares is None else shares
    by = [*by, "metric"]
    each = rows.select(*by[:-1], F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in metrics])).alias("x")).select(*by[:-1], "x.metric", "x.v")
    seen = each.groupBy(*by, "v").agg(F.count("*").alias("n"))
    known = seen.where("v is not null")
    totals_ = seen.groupBy(*by).agg(F.sum(F.col("v") * F.col("n")).cast("long").alias("sum"), F.max("v").alias("max"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("all"))
    borders = known.groupBy(*by).agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("borders"))
    at = known.join(borders, by).select(*by, "v", "n", F.size(F.filter("borders", lambda b: b < F.col("v"))).alias("cell"))
    cells = at.groupBy(*by, "cell").agg(F.sum("n").alias("held"))
    cells = cells.withColumn("before", F.sum("held").over(W.partitionBy(*by).orderBy("cell")) - F.col("held"))
    at = at.join(cells, [*by, "cell"]).withColumn("hi", F.col("before") + F.sum("n").over(W.partitionBy(*by, "cell").orderBy("v"))).join(totals_.select(*by, "all"), by)
    rank = {name: F.floor(F.lit(q) * (F.col("all") - 1) + 0.5) for name, q in shares.items()}
    found = at.groupBy(*by).agg(*[F.max(F.when((r < F.col("hi")) & (r >= F.col("hi") - F.col("n")), F.col("v"))).alias(name) for name, r in rank.items()])
    return totals_.join(found, by, "left").select(*by, "sum", *shares, "max")
