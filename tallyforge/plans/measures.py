"""Queries on measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from .catalogue import query
from .tables import table


@query("p95_by_type", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def p95_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@query(
    "median_of_medians",
    "SELECT l_returnflag, round(median(m), 6) AS median, count(*) AS groups FROM (SELECT l_returnflag, l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY 1",
)
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.median_of_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_suppkey"], "l_extendedprice")
    return got.withColumn("median", F.round("median", 6))


@query("value_spread", "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spread(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("median", F.round("median", 6))


@query(
    "linear_fit",
    """SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
    count(DISTINCT l_quantity) AS distinct_x FROM lineitem GROUP BY 1""",
)
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.linear_fit(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity")
    return got.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


@query(
    "lag_corrected_level",
    """SELECT user_id, round(avg(value) + 5.0 * CASE WHEN max(event_id) > min(event_id) THEN (arg_max(value, event_id) - arg_min(value, event_id)) / (max(event_id) - min(event_id)) ELSE 0 END, 6) AS level FROM events GROUP BY 1""",
)
def lag_corrected_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lag_corrected(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 5.0).withColumn("level", F.round("level", 6))


_HOURS = """h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, avg(value) AS level, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL),
  w AS (SELECT event_type, hour, hour * 1.0 + 0.5 AS mid, level, p95, hour % 2 = 1 AS is_on FROM h)"""


@query(
    "asof_bracket",
    f"""WITH {_HOURS}, f AS (SELECT *, last_value(CASE WHEN NOT is_on THEN struct_pack(t := mid, l := level, p := p95) END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
      first_value(CASE WHEN NOT is_on THEN struct_pack(t := mid, l := level, p := p95) END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY mid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM w),
    g AS (SELECT *, (mid - b.t) / (a.t - b.t) AS wt FROM f WHERE is_on)
    SELECT event_type, CAST(mid AS DOUBLE) AS mid, round(b.l + wt * (a.l - b.l), 6) AS interp, round(level - (b.l + wt * (a.l - b.l)), 6) AS d_load, round(CASE WHEN b.p + wt * (a.p - b.p) > 0 THEN p95 / (b.p + wt * (a.p - b.p)) - 1 END, 6) AS d_p95 FROM g""",
)
def asof_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("hour", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000"))
    h = e.groupBy("event_type", "hour").agg(F.avg("value").alias("level"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))
    w = h.withColumns({"mid": F.col("hour") + F.lit(0.5).cast("double"), "on": F.expr("hour % 2 = 1")})
    return stats.bracketed(w, ["event_type"], "mid", "level", "p95").select("event_type", "mid", *[F.round(c, 6).alias(c) for c in ("interp", "d_load", "d_p95")])


@query(
    "interval_union",
    """WITH i AS (SELECT l_orderkey, greatest(l_partkey % 900 - 10, 0) AS a, least(l_partkey % 900 + CAST(l_quantity AS BIGINT) + 20, 900) AS b FROM lineitem),
    r AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE b > a)
    SELECT l_orderkey, CAST(sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS BIGINT) AS covered FROM r GROUP BY 1""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 900).alias("a0"), (F.col("l_partkey") % 900 + F.col("l_quantity").cast("long")).alias("b0"), F.lit(900).cast("long").alias("size"))
    return stats.interval_union(l, ["l_orderkey"], "a0", "b0", widen=(10, 20), cap="size")


@query(
    "space_preflight",
    """WITH p AS (SELECT s_nationkey, CAST(sum(CAST(floor(abs(s_acctbal)) AS BIGINT)) AS BIGINT) AS planned FROM supplier GROUP BY 1), m AS (SELECT n_nationkey AS s_nationkey, CAST(n_nationkey * 1000 + 5000 AS BIGINT) AS available, CAST(40000 AS BIGINT) AS total FROM nation)
    SELECT s_nationkey, planned, available, total, (available - planned) * 100 >= total * 10 AS fits FROM p JOIN m USING (s_nationkey)""",
)
def space_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select("s_nationkey", F.floor(F.abs("s_acctbal")).alias("bytes"))
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 1000 + 5000).cast("long").alias("available"), F.lit(40000).cast("long").alias("total"))
    return stats.space(p, m, "s_nationkey", "bytes", 10)


@query(
    "largest_remainder",
    """WITH c AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS w FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), e AS (SELECT *, w * 1000 / sum(w) OVER (PARTITION BY n_regionkey) AS x FROM c),
    f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl FROM e)
    SELECT n_regionkey, n_nationkey, fl + CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY round(x - fl, 9) DESC, n_nationkey) <= 1000 - sum(fl) OVER (PARTITION BY n_regionkey) THEN 1 ELSE 0 END AS share FROM f""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    w = n.groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").alias("w"))
    return stats.largest_remainder(w, ["n_regionkey"], "w", 1000).select("n_regionkey", "n_nationkey", "share")


@query(
    "stalled_progress",
    """WITH t AS (SELECT user_id, event_id AS t, event_type FROM events), l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS n FROM t),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS run FROM l)
    SELECT user_id, min(t) AS "start", max(t) AS "end" FROM r GROUP BY user_id, run HAVING max(t) - min(t) >= 100""",
)
def stalled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stalls(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), "event_type"), ["user_id"], "t", "event_type", 100)


@query("bootstrap_p95")
def bootstrap_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are days, every other one on; blocks are their hours."""
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    e = table(spark, sf_dir, "events").select("event_type", hour.alias("block"), "value").withColumn("window", F.floor(F.col("block") / 24))
    e = e.withColumn("state", F.when(F.col("window") % 2 == 1, "on").otherwise("off"))
    levels = e.groupBy("event_type", "state", "window").agg(F.avg("value").alias("level"), F.count("value").alias("n"))
    return stats.bootstrap(e, levels, "event_type")
