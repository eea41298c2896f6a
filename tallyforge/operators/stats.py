"""Measurement statistics: ranks, medians, baselines between brackets, intervals, resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by..., n, value: the value of rank ceil(share * n), counted from 1."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.expr(f"percentile_disc({share}) within group (order by {value})").alias(value))


def median_of_medians(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    return rows.groupBy(*outer, *inner).agg(F.median(value).alias("_m")).groupBy(*outer).agg(F.median("_m").alias("median"), F.count("*").alias("groups"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def linear_fit(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count_distinct(x).alias("distinct_x")
    )


def lag_corrected(rows: DataFrame, by: list[str], t: str, value: str, tau: float) -> DataFrame:
    """by..., level: mean plus tau times the slope from the first to the last value; the mean alone where they coincide."""
    g = rows.groupBy(*by).agg(F.avg(value).alias("m"), F.min_by(value, t).alias("a"), F.max_by(value, t).alias("b"), F.min(t).alias("ta"), F.max(t).alias("tb"))
    slope = F.when(F.col("tb") > F.col("ta"), (F.col("b") - F.col("a")) / (F.col("tb") - F.col("ta"))).otherwise(0.0)
    return g.select(*by, (F.col("m") + tau * slope).alias("level"))


def bracketed(windows: DataFrame, by: list[str], mid: str, level: str, p95: str) -> DataFrame:
    """Each window with on = true against the nearest off windows before and after: by..., mid, interp, d_load, d_p95.

    The baseline is interpolated at the window's middle; without one side the results are null.
    """
    w = W.partitionBy(*by).orderBy(mid)
    off = F.when(~F.col("on"), F.struct(F.col(mid).alias("t"), F.col(level).alias("l"), F.col(p95).alias("p")))
    x = windows.withColumn("_b", F.last(off, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_a", F.first(off, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    x = x.where("on")
    span = F.col("_a.t") - F.col("_b.t")
    weight = F.when(span == 0, 0.5).otherwise((F.col(mid) - F.col("_b.t")) / span)

    def between(name: str) -> Column:
        return F.col(f"_b.{name}") + weight * (F.col(f"_a.{name}") - F.col(f"_b.{name}"))

    interp = between("l")
    p = between("p")
    return x.select(*by, mid, interp.alias("interp"), (F.col(level) - interp).alias("d_load"), F.when(p > 0, F.col(p95) / p - 1).alias("d_p95"))


def interval_union(rows: DataFrame, by: list[str], start: str, end: str, widen: tuple[int, int] = (0, 0), cap: str | None = None) -> DataFrame:
    """by..., covered: the length of the union of half-open intervals, each widened and cut to 0 .. cap first.

    Intervals that touch count as one; an empty one as nothing.
    """
    a = F.greatest(F.col(start) - widen[0], F.lit(0))
    b = F.col(end) + widen[1]
    b = F.least(b, F.col(cap)) if cap else b
    x = rows.select(*by, a.alias("a"), b.alias("b")).where("b > a")
    w = W.partitionBy(*by).orderBy("a", "b")
    x = x.withColumn("reach", F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)))
    return x.groupBy(*by).agg(F.sum(F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce("reach", F.col("a"))), F.lit(0))).alias("covered"))


def largest_remainder(rows: DataFrame, by: list[str], weight: str, total: int) -> DataFrame:
    """rows with share: whole parts of total in proportion to weight, what is left going to the largest remainders."""
    exact = F.col(weight) * total / F.sum(weight).over(W.partitionBy(*by))
    x = rows.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(total) - F.sum("_f").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.col("_e") - F.col("_f")), *[c for c in rows.columns if c != weight]))
    return x.withColumn("_left", left).withColumn("_rank", rank).withColumn("share", F.col("_f") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_e", "_f", "_left", "_rank")


def stalls(rows: DataFrame, by: list[str], t: str, counter: str, at_least: int) -> DataFrame:
    """by..., start, end: stretches in which the counter didn't move for at_least units of t."""
    w = W.partitionBy(*by).orderBy(t)
    moved = F.coalesce(~F.col(counter).eqNullSafe(F.lag(counter).over(w)), F.lit(True)).cast("int")
    x = rows.withColumn("_new", moved).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*by, "_run").agg(F.min(t).alias("start"), F.max(t).alias("end")).where(F.col("end") - F.col("start") >= at_least).drop("_run")


def space(rows: DataFrame, mounts: DataFrame, group: str, planned: str, floor_pct: int) -> DataFrame:
    """group, planned, available, total, fits: bytes planned on each group against what its mounts have left."""
    p = rows.groupBy(group).agg(F.sum(planned).alias("planned"))
    m = mounts.groupBy(group).agg(F.min("available").alias("available"), F.min("total").alias("total"))
    return p.join(m, group).withColumn("fits", (F.col("available") - F.col("planned")) * 100 >= F.col("total") * floor_pct)


def verdict(low: Column, high: Column, limit: float) -> Column:
    """PASS if the whole interval is at most the limit, FAIL if it lies above, else INCONCLUSIVE."""
    return F.when(high <= limit, "PASS").when(low > limit, "FAIL").otherwise("INCONCLUSIVE")


def block_draws(samples: DataFrame, by: str, replicates: int = 1000, seed: int = 34) -> DataFrame:
    """(by, state, replicate, window, block, times): two-stage resamples of samples(by, state, window, block).

    A replicate draws as many windows of a state as it has, each with replacement, and from each drawn window as many
    blocks as that has. Draws are hashes of their place, so reruns agree however rows are dealt. Windows are numbered
    within their state: one row for each stretch of time.
    """
    at = [by, "state"]
    blocks = samples.select(*at, "window", "block").distinct()
    blocks = blocks.withColumn("_j", F.row_number().over(W.partitionBy(*at, "window").orderBy("block")) - 1)
    windows = blocks.groupBy(*at, "window").agg(F.count("*").alias("_blocks"))
    windows = windows.withColumn("_i", F.row_number().over(W.partitionBy(*at).orderBy("window")) - 1)
    many = windows.groupBy(*at).agg(F.count("*").alias("_windows"))

    def drawn(below: str, *place: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *place), F.col(below)).cast("int")

    slots = windows.select(*at, F.col("_i").alias("slot")).join(many, at).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picked = slots.withColumn("_i", drawn("_windows", *at, "replicate", "slot")).join(windows, [*at, "_i"])
    picked = picked.withColumn("_turn", F.explode(F.expr("sequence(0, cast(_blocks as int) - 1)"))).withColumn("_j", drawn("_blocks", *at, "replicate", "slot", "_turn"))
    times = picked.groupBy(*at, "replicate", "window", "_j").agg(F.count("*").alias("times"))
    return times.join(blocks, [*at, "window", "_j"]).select(*at, "replicate", "window", "block", "times")


def replicate_p95(samples: DataFrame, draws: DataFrame, by: str) -> DataFrame:
    """(by, state, replicate, p95): the nearest-rank 95th percentile of the values that each replicate drew.

    The pooled percentiles from the 80th on are the bounds of bins. Counts by bin say which bin holds a replicate's rank, and
    only the values of that bin are ranked, so a replicate never reads all its values; bins change no result.
    """
    at = [by, "state"]
    cuts = samples.groupBy(*at).agg(F.percentile_approx("value", F.lit([x / 100 for x in range(80, 100)]), 10_000).alias("_cuts"))
    binned = samples.join(cuts, at).withColumn("bin", F.size(F.filter("_cuts", lambda c: c <= F.col("value"))))
    binned = binned.groupBy(*at, "window", "block", "bin", "value").agg(F.count("*").alias("n"))
    held = binned.groupBy(*at, "window", "block", "bin").agg(F.sum("n").alias("n"))
    one = [*at, "replicate"]
    counts = draws.join(held, [*at, "window", "block"]).groupBy(*one, "bin").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    above = W.partitionBy(*one).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumns({"_above": F.coalesce(F.sum("n").over(above), F.lit(0)), "_all": F.sum("n").over(W.partitionBy(*one))})
    rank = F.col("_all") - F.ceil(F.col("_all") * 95 / 100) + 1 - F.col("_above")
    found = counts.withColumn("rank", rank).where("rank between 1 and n").select(*one, "bin", "rank")
    values = draws.join(found, one).join(binned, [*at, "window", "block", "bin"])
    values = values.groupBy(*one, "rank", "value").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    reach = F.sum("n").over(W.partitionBy(*one).orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0))
    return values.withColumn("_reach", reach).where("_reach >= rank").groupBy(*one).agg(F.max("value").alias("p95"))


def bootstrap(samples: DataFrame, levels: DataFrame, by: str, alpha: float = 0.05, replicates: int = 1000, seed: int = 34) -> DataFrame:
    """(by, p95_low, p95_high, load_low, load_high): bounds at alpha and 1 - alpha of a two-stage block bootstrap.

    samples: by, state ('on' or 'off'), window, block, value; levels: by, state, window, level, n. Rows with a null in any of them take no
    part. A replicate gives the p95 of 'on' over that of 'off' less 1, and the difference of the mean levels,
    weighed by n, of the windows it drew. A p95 of 0 when off gives no ratio; a group that lacks a state has null bounds.
    """
    samples = samples.select(by, "state", "window", "block", "value").dropna()
    levels = levels.select(by, "state", "window", "level", "n").dropna()
    draws = block_draws(samples, by, replicates, seed)
    one = [by, "replicate"]

    def side(name: str, of: str) -> Column:
        return F.max(F.when(F.col("state") == name, F.col(of)))

    p95 = replicate_p95(samples, draws, by).groupBy(*one).agg(side("on", "p95").alias("on"), side("off", "p95").alias("off"))
    p95 = p95.select(*one, F.when(F.col("off") != 0, F.col("on") / F.col("off") - 1).alias("ratio"))
    # a window drawn k times has k times its number of blocks
    size = samples.groupBy(by, "state", "window").agg(F.count_distinct("block").alias("_blocks"))
    picks = draws.groupBy(*one, "state", "window").agg(F.sum("times").alias("k")).join(size, [by, "state", "window"]).join(levels, [by, "state", "window"])
    weight = F.col("k") / F.col("_blocks") * F.col("n")
    load = picks.groupBy(*one, "state").agg((F.sum(weight * F.col("level")) / F.sum(weight)).alias("level"))
    load = load.groupBy(*one).agg((side("on", "level") - side("off", "level")).alias("load"))

    def at(q: float, of: str) -> Column:
        return F.expr(f"percentile_disc({q}) within group (order by {of})")

    got = p95.join(load, one, "full_outer").groupBy(by)
    return got.agg(*[at(q, of).alias(f"{name}_{end}") for name, of in (("p95", "ratio"), ("load", "load")) for q, end in ((alpha, "low"), (1 - alpha, "high"))])


def byte_difference(pairs: DataFrame, key: str) -> DataFrame:
    """(key, first, last): the first and last differing byte of the binaries a and b; null where equal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            first, last = [], []
            for a, b in zip(x["a"], x["b"], strict=True):
                u, v = np.frombuffer(a or b"", np.uint8), np.frombuffer(b or b"", np.uint8)
                m = min(len(u), len(v))
                d = np.flatnonzero(u[:m] != v[:m])
                n = max(len(u), len(v))
                first.append(int(d[0]) if len(d) else (m if n > m else None))
                last.append(n - 1 if n > m else (int(d[-1]) if len(d) else None))
            yield pd.DataFrame({key: x[key], "first": pd.array(first, "Int64"), "last": pd.array(last, "Int64")})

    return pairs.select(key, "a", "b").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, first long, last long")
