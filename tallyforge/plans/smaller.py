"""Queries on the smaller comparisons and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, dedup, logs
from .catalogue import query
from .tables import table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")


@query(
    "change_attribution",
    """WITH a AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0)
    SELECT * FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
      CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN 'c_name' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END) END AS columns
      FROM a FULL JOIN b ON a.c_custkey = b.c_custkey) WHERE kind <> 'changed' OR columns <> ''""",
)
def change_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    after = c.where("c_custkey % 11 <> 0").select("c_custkey", F.when(F.expr("c_custkey % 3 = 0"), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.expr("c_custkey % 5 <> 0"), F.col("c_nationkey")).alias("c_nationkey"))
    return checks.attribute_changes(c.where("c_custkey % 10 <> 0"), after, "c_custkey")


@query(
    "candidate_apply",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS v FROM customer), b AS (SELECT c_custkey, c_name AS v FROM customer WHERE c_custkey % 4 <> 0), l AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_name || '!' ELSE c_name END AS v FROM customer WHERE c_custkey % 8 <> 0)
    SELECT c.c_custkey, CASE WHEN c.v IS NOT DISTINCT FROM b.v THEN 'unchanged' WHEN b.c_custkey IS NULL AND l.c_custkey IS NULL THEN CASE WHEN c.c_custkey % 16 = 0 THEN 'tried' ELSE 'insert' END WHEN c.v IS NOT DISTINCT FROM l.v THEN 'same' ELSE 'conflict' END AS action
    FROM c LEFT JOIN b USING (c_custkey) LEFT JOIN l USING (c_custkey)""",
)
def candidate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)

    def marked(mod: int) -> F.Column:
        return F.when(F.col("c_custkey") % mod == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("v")

    return checks.candidate_actions(
        c.where("c_custkey % 4 <> 0").select("c_custkey", F.col("c_name").alias("v")), c.select("c_custkey", marked(3)), c.where("c_custkey % 8 <> 0").select("c_custkey", marked(6)), "c_custkey", c.where("c_custkey % 16 = 0").select("c_custkey")
    )


@query(
    "snapshot_compose",
    """WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name FROM customer), b AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0)
    SELECT CASE WHEN i.c_name = b.c_name THEN 'equivalent' WHEN b.c_custkey IS NOT NULL THEN 'conflict' ELSE 'inserted' END AS provenance, count(*) AS n FROM i LEFT JOIN b USING (c_custkey) GROUP BY 1""",
)
def snapshot_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).select("c_custkey", "c_name")
    incoming = c.withColumn("c_name", F.when(F.expr("c_custkey % 3 = 0"), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return checks.compose(c.where("c_custkey % 5 <> 0"), incoming, "c_custkey").groupBy("provenance").agg(F.count("*").alias("n"))


@query(
    "verdict_roll_up",
    """SELECT c_nationkey, CASE WHEN bool_or(c_acctbal < -990) THEN 'Fail' WHEN bool_or(c_acctbal > 9900) THEN 'Pass' ELSE 'Skip' END AS verdict FROM customer GROUP BY 1""",
)
def verdict_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") < -990, "Fail").when(F.col("c_acctbal") > 9900, "Pass").otherwise("Skip")
    return checks.roll_up(table(spark, sf_dir, "customer").select("c_nationkey", v.alias("verdict")), "c_nationkey")


_PAIRS = """WITH v AS (SELECT l_suppkey, CASE WHEN l_quantity > CASE WHEN l_suppkey % 9 = 0 THEN 0 WHEN l_suppkey % 9 = 1 THEN 50 ELSE 49 END THEN 'FAIL' ELSE 'PASS' END AS verdict FROM lineitem)
    SELECT l_suppkey, CASE WHEN bool_and(verdict = 'PASS') THEN 'PASS' WHEN bool_and(verdict = 'FAIL') THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM v GROUP BY 1"""


@query("pair_verdict", _PAIRS)
@query("pair_verdict_all", _PAIRS)
def pair_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.expr("case l_suppkey % 9 when 0 then 0 when 1 then 50 else 49 end")
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > limit, "FAIL").otherwise("PASS").alias("verdict"))
    return checks.pair_verdict(l, "l_suppkey")


_WINDOWS = "w AS (SELECT p_partkey AS name, p_partkey * 7 AS \"start\", p_partkey * 7 + p_size AS \"end\" FROM part WHERE p_size > 0)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size > 0")
    return p.select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("end"))


_WINDOW_LOCATION = f"""WITH {_WINDOWS}, m AS (SELECT e.event_id, w.name, w."start", w."end", row_number() OVER (PARTITION BY event_id ORDER BY w."start" DESC) AS rn FROM events e JOIN w ON event_id >= w."start" AND event_id < w."end")
    SELECT event_id, name, "start", "end" FROM m WHERE rn = 1"""


@query("window_location", _WINDOW_LOCATION)
@query("window_location_all", _WINDOW_LOCATION)
def window_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.in_window(table(spark, sf_dir, "events").select("event_id"), _windows(spark, sf_dir), "event_id", 64)


_OVERLAP_FRACTION = f"""WITH {_WINDOWS}, r AS (SELECT event_id * 3 AS a, event_id * 3 + event_id % 4 AS b FROM events), c AS (SELECT name, sum(least(b, "end") - greatest(a, "start")) AS n FROM w JOIN r ON b > a AND a < "end" AND b > "start" GROUP BY 1)
    SELECT name, round(coalesce(n, 0) / ("end" - "start"), 6) AS share FROM w LEFT JOIN c USING (name)"""


@query("overlap_fraction", _OVERLAP_FRACTION)
@query("overlap_fraction_all", _OVERLAP_FRACTION)
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("a"), (F.col("event_id") * 3 + F.col("event_id") % 4).alias("b"))
    return checks.share_covered(_windows(spark, sf_dir), r, 64).withColumn("share", F.round("share", 6))


@query("counter_deltas", "SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return checks.counter_deltas(e, "user_id", "at", "event_id").drop("at")


@query(
    "load_replay",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back FROM events) SELECT user_id, round(sum(value * 0.1 * pow(0.9, back)), 6) AS load FROM s GROUP BY 1""",
)
def load_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ewma(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9).withColumn("load", F.round("load", 6))


@query(
    "bounded_retention",
    """WITH r AS (SELECT source, doc_id, n_chars, count(*) OVER w AS n, sum(n_chars) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, n_chars FROM r WHERE n <= 8 AND s <= 20000""",
)
def bounded_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.retained(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 8, 20000)


@query("whitespace_fold", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')) AS folded, regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g') <> text AS changed FROM documents")
def whitespace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = checks.fold_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(f).alias("folded"), (f != F.col("text")).alias("changed"))


@query(
    "placement_collisions",
    """WITH f AS (SELECT c_custkey AS source, c_nationkey * 100 + c_custkey % 50 AS dest FROM customer), n AS (SELECT dest, count(DISTINCT source) AS n FROM f GROUP BY 1) SELECT source, dest, CASE WHEN n > 1 THEN 'collision' ELSE 'land' END AS outcome FROM f JOIN n USING (dest)""",
)
def placement_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_nationkey") * 100 + F.col("c_custkey") % 50).alias("dest"))).select("source", "dest", "outcome")


@query(
    "prefix_proof",
    """WITH seg AS (SELECT doc_id, pos, md5(line) AS digest, length(line) AS size FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    o AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS reach FROM seg), h AS (SELECT doc_id, pos, CASE WHEN doc_id % 7 = 0 AND pos = 1 THEN md5('x') ELSE digest END AS d FROM seg)
    SELECT o.doc_id, bool_and(o.digest IS NOT DISTINCT FROM h.d) AS proven FROM o JOIN documents USING (doc_id) LEFT JOIN h ON h.doc_id = o.doc_id AND h.pos = o.pos WHERE reach <= n_chars // 2 GROUP BY 1""",
)
def prefix_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = dedup.offsets(dedup.segments(docs))
    held = m.select("doc_id", "pos", F.when(F.expr("doc_id % 7 = 0 and pos = 1"), F.md5(F.lit("x"))).otherwise(F.col("digest")).alias("digest"))
    return checks.prefix_proof(held, m, docs.select("doc_id", F.expr("n_chars div 2").alias("length")), "doc_id")


@query(
    "object_tally",
    "SELECT CASE WHEN l_linenumber = 7 THEN 'missing' ELSE 't' || l_returnflag END AS type, count(*) AS n, CAST(coalesce(sum(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END), 0) AS BIGINT) AS bytes FROM lineitem GROUP BY 1",
)
def object_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 7, "missing").otherwise(F.concat(F.lit("t"), "l_returnflag")), F.when(F.col("l_linenumber") != 7, F.col("l_partkey").cast("string")))
    return checks.tally(l.select(line.alias("line")), "line")


@query(
    "record_carry_over",
    """WITH r AS (SELECT o_custkey AS source, o_orderkey AS session, o_orderkey AS started, o_orderstatus <> 'P' AS completed FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started DESC) AS n, first_value(completed) OVER (PARTITION BY source ORDER BY started DESC) AS d FROM r),
    k AS (SELECT source, session FROM x WHERE n = 1 OR (n = 2 AND NOT d)) SELECT DISTINCT k.source, l_partkey % 20 AS path FROM k JOIN lineitem ON l_orderkey = k.session""",
)
def record_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("session"), F.col("o_orderkey").alias("started"), (F.col("o_orderstatus") != "P").alias("completed"))
    e = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("session"), (F.col("l_partkey") % 20).alias("path"))
    return checks.carried_over(r, e)


@query(
    "missing_and_extra",
    """SELECT 'missing' AS kind, c_name AS name FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 7 <> 0 UNION ALL SELECT 'extra', c_name FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 9 <> 0""",
)
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    want, have = c.where("c_custkey % 9 = 0").select("name"), c.where("c_custkey % 7 = 0").select("name")
    return want.exceptAll(have).select(F.lit("missing").alias("kind"), "name").union(have.exceptAll(want).select(F.lit("extra").alias("kind"), "name"))


@query(
    "retention_check",
    """WITH c AS (SELECT unnest([1000000, 2900000, 40000000]) AS now), d AS (SELECT min(p_size) + 30 AS days FROM part)
    SELECT now, days, min(n_chars) * 10000 + days * 86400 > now + 100000 AS holds, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents, c, d GROUP BY now, days""",
)
def retention_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "part").select((F.col("p_size") + 30).alias("days"))
    files = table(spark, sf_dir, "documents").select((F.col("n_chars") * 10000).alias("mtime"), F.col("n_chars").alias("size"))
    out = None
    for now in (1_000_000, 2_900_000, 40_000_000):
        one = checks.retention_holds(sources, files, now, 100_000).select(F.lit(now).alias("now"), "days", "holds", "bytes")
        out = one if out is None else out.union(one)
    return out


@query("stash_union", "SELECT event_type || '-' || CAST(event_id % 300 AS VARCHAR) AS oid, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND event_type || '-' || CAST(event_id % 300 AS VARCHAR) NOT IN (SELECT event_type || '-' || CAST(event_id % 300 AS VARCHAR) FROM events WHERE event_id % 4 = 0) GROUP BY 1")
def stash_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("event_id") % 300).cast("string")).alias("oid"), "event_id")
    return logs.keyed_extras(e.where("event_id % 2 = 1"), e.where("event_id % 4 = 0"), "oid", "event_id")
