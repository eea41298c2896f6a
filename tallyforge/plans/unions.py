"""Queries on unions of logs and of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs, rows
from .catalogue import query
from .tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("line"))


_EV = "ev AS (SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS line FROM events)"


@query(
    "log_union_counted",
    f"""WITH ev AS (SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS line, props FROM events), seat AS (SELECT * FROM ev WHERE event_id % 3 = 0), h AS (SELECT line, count(*) AS n FROM seat GROUP BY 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY event_id) AS rn FROM ev WHERE event_id % 3 <> 0)
    SELECT event_id, line, props, 0 AS side FROM seat UNION ALL SELECT event_id, l.line, props, 1 FROM l LEFT JOIN h USING (line) WHERE rn > coalesce(n, 0)""",
)
def log_union_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("line"), "props")
    seat, live = e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")
    return logs.union_log(seat, logs.counted_extras(live, seat, ["line"], "event_id"))


@query(
    "log_bag_difference",
    f"WITH {_EV} SELECT line FROM ev WHERE event_id % 3 <> 0 EXCEPT ALL SELECT line FROM ev WHERE event_id % 3 = 0",
)
def log_bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.where("event_id % 3 <> 0").select("line").exceptAll(e.where("event_id % 3 = 0").select("line"))


_TURNS = """t AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn % 7 AS VARCHAR) AS uid, conv_id * 1000 + turn AS pos, role || ':' || text AS line, turn FROM conversations)"""


@query(
    "log_union_keyed",
    f"""WITH {_TURNS}, seat AS (SELECT * FROM t WHERE turn % 2 = 0), l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pos) AS rn FROM t WHERE turn % 3 <> 0)
    SELECT uid, pos, line, 0 AS side FROM seat UNION ALL SELECT uid, pos, line, 1 FROM l WHERE rn = 1 AND uid NOT IN (SELECT uid FROM seat)""",
)
def log_union_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") % 7).cast("string")).alias("uid"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat("role", F.lit(":"), "text").alias("line"), "turn"
    )
    seat, live = t.where("turn % 2 = 0").drop("turn"), t.where("turn % 3 <> 0").drop("turn")
    return logs.union_log(seat, logs.keyed_extras(live, seat, "uid", "pos"))


_SIDES = """raw AS (SELECT conv_id, turn, role || ':' || text AS line, CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) END AS uid FROM conversations),
  sides AS (
    SELECT conv_id, 's' AS side, line, uid, turn FROM raw WHERE conv_id % 4 <> 1 OR turn < 2
    UNION ALL SELECT conv_id, 'l', CASE WHEN conv_id % 4 = 3 AND turn = 1 THEN line || '!' ELSE line END, uid, turn FROM raw WHERE conv_id % 4 <> 2 OR turn < 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, line) - 1 AS pos FROM sides)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), "text").alias("line"), F.when(F.expr("turn % 2 = 0"), F.col("turn").cast("string")).alias("uid"))
    s = raw.where("conv_id % 4 <> 1 or turn < 2").withColumn("side", F.lit("s"))
    l = raw.where("conv_id % 4 <> 2 or turn < 2").withColumn("side", F.lit("l"))
    l = l.withColumn("line", F.when(F.expr("conv_id % 4 = 3 and turn = 1"), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    pos = F.row_number().over(W.partitionBy("conv_id", "side").orderBy("turn", "line")) - 1
    return s.unionByName(l).withColumn("pos", pos)


@query(
    "log_union_action",
    f"""WITH {_SIDES}, f AS (
      SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NOT NULL AS in_s, b.pos IS NOT NULL AS in_l,
             (a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.line IS NOT DISTINCT FROM b.line) AS eq
      FROM (SELECT * FROM n WHERE side = 's') a FULL JOIN (SELECT * FROM n WHERE side = 'l') b ON a.conv_id = b.conv_id AND a.pos = b.pos),
    cut AS (SELECT conv_id, min(CASE WHEN NOT eq THEN pos END) AS cut, count(*) FILTER (in_s) AS n_s, count(*) FILTER (in_l) AS n_l FROM f GROUP BY 1),
    c AS (SELECT *, coalesce(cut, greatest(n_s, n_l)) AS same FROM cut),
    ids AS (SELECT DISTINCT conv_id, uid FROM n WHERE side = 's' AND uid IS NOT NULL),
    have AS (SELECT n.conv_id, line, count(*) AS h FROM n JOIN c USING (conv_id) WHERE side = 's' AND uid IS NULL AND pos >= same GROUP BY ALL),
    live AS (SELECT n.*, row_number() OVER (PARTITION BY n.conv_id, uid IS NULL, coalesce(uid, line) ORDER BY pos) AS rn FROM n JOIN c USING (conv_id) WHERE side = 'l' AND pos >= same),
    kept AS (SELECT live.conv_id, count(*) AS extras FROM live LEFT JOIN have USING (conv_id, line) LEFT JOIN ids ON ids.conv_id = live.conv_id AND ids.uid = live.uid
      WHERE (live.uid IS NULL AND rn > coalesce(h, 0)) OR (live.uid IS NOT NULL AND rn = 1 AND ids.uid IS NULL) GROUP BY 1)
    SELECT c.conv_id, CASE WHEN cut IS NULL AND n_s = n_l THEN 'adopt' WHEN same >= n_s THEN 'covered' WHEN same >= n_l THEN 'extend' WHEN coalesce(extras, 0) = 0 THEN 'covered' ELSE 'consolidate' END AS action,
      coalesce(extras, 0) AS extras FROM c LEFT JOIN kept ON kept.conv_id = c.conv_id""",
)
def log_union_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.union_actions(_sides(spark, sf_dir), "conv_id")


@query(
    "coverage_verdict",
    """WITH e AS (SELECT user_id, event_type, event_id FROM events), s AS (SELECT * FROM e WHERE event_id % 5 <> 0), t AS (SELECT * FROM e WHERE event_id % 7 <> 0 OR user_id % 3 = 0),
    half AS (SELECT user_id, median(event_id) AS h FROM e GROUP BY 1),
    tt AS (SELECT t.* FROM t JOIN half USING (user_id) WHERE (user_id % 4 <> 1 OR event_id % 5 <> 0) AND (user_id % 12 <> 9 OR event_id <= h)),
    a AS (SELECT user_id, event_type, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS m FROM tt GROUP BY ALL),
    lack AS (SELECT user_id, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS lacking FROM a LEFT JOIN b USING (user_id, event_type) GROUP BY 1),
    x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type FROM s), y AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type FROM tt),
    o AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, count(x.i) AS n_a, count(y.i) AS n_b, bool_and(y.i IS NULL OR (x.i IS NOT NULL AND x.event_type IS NOT DISTINCT FROM y.event_type)) AS prefix
      FROM x FULL JOIN y ON x.user_id = y.user_id AND x.i = y.i GROUP BY 1)
    SELECT user_id, CASE WHEN lacking = 0 THEN 'covered' WHEN prefix AND n_b < n_a THEN 'extends' ELSE 'lacks' END AS verdict, lacking FROM lack JOIN o USING (user_id)""",
)
def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    half = e.groupBy("user_id").agg(F.median("event_id").alias("h"))
    target = e.join(half, "user_id").where("(event_id % 7 <> 0 or user_id % 3 = 0) and (user_id % 4 <> 1 or event_id % 5 <> 0) and (user_id % 12 <> 9 or event_id <= h)").drop("h")
    return logs.coverage(e.where("event_id % 5 <> 0"), target, "user_id", "event_type", "event_id")


@query(
    "exclude_missing",
    r"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    k AS (SELECT doc_id * 100000 + i AS pos, doc_id, line, regexp_replace(regexp_replace(line, '\r$', ''), ' +$', '') AS k FROM l),
    f AS (SELECT pos, line, k, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM k WHERE doc_id % 2 = 0 AND k <> '')
    SELECT pos, line FROM f WHERE rn = 1 AND k NOT IN (SELECT k FROM k WHERE doc_id % 2 = 1)""",
)
def exclude_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("pos"), "line")
    return logs.ordered_difference(l.where("doc_id % 2 = 0"), l.where("doc_id % 2 = 1"), "line", "pos")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_custkey").alias("version")).where("c_custkey % 11 <> 0")
    s = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_custkey").alias("version")).where("c_custkey % 7 <> 0")
    s = s.withColumn("c_name", F.when(F.expr("c_custkey % 5 = 0"), F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    v = F.when(F.expr("c_custkey % 10 = 0"), F.col("version") + 1).when(F.expr("c_custkey % 15 = 0"), F.col("version") - 1).when(F.expr("c_custkey % 25 = 0"), F.lit(None)).otherwise(F.col("version"))
    return s.withColumn("version", v), d


_CUST = """d AS (SELECT c_custkey, c_name, c_nationkey, c_custkey AS version FROM customer WHERE c_custkey % 11 <> 0),
  s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_nationkey,
    CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 WHEN c_custkey % 15 = 0 THEN c_custkey - 1 WHEN c_custkey % 25 = 0 THEN NULL ELSE c_custkey END AS version FROM customer WHERE c_custkey % 7 <> 0),
  u AS (SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey, s.c_name AS s_name, d.c_name AS d_name,
    CASE WHEN d.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'keep'
      WHEN s.c_name IS NOT DISTINCT FROM d.c_name AND s.c_nationkey IS NOT DISTINCT FROM d.c_nationkey AND s.version IS NOT DISTINCT FROM d.version THEN 'adopt'
      WHEN s.version > d.version THEN 'replace' ELSE 'hold' END AS action,
    CASE WHEN s.version IS NULL OR d.version IS NULL THEN 'unversioned' WHEN s.version > d.version THEN 'newer' WHEN s.version < d.version THEN 'older' ELSE 'same-version' END AS ord
    FROM s FULL JOIN d ON s.c_custkey IS NOT DISTINCT FROM d.c_custkey)"""


@query(
    "row_union_natural",
    f"""WITH {_CUST} SELECT c_custkey, action, CASE WHEN action IN ('replace', 'hold') THEN ord END AS reason,
    CASE WHEN action IN ('insert', 'replace') THEN s_name ELSE d_name END AS kept_name FROM u""",
)
def row_union_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = _customers(spark, sf_dir)
    return rows.union_natural(s, d, ["c_custkey"], "version").select("c_custkey", "action", "reason", F.col("kept.c_name").alias("kept_name"))


@query(
    "row_union_ledger",
    f"WITH {_CUST} SELECT action, ord AS reason, count(*) AS n, max(CASE WHEN action = 'replace' THEN d_name ELSE s_name END) AS last_lost FROM u WHERE action IN ('replace', 'hold') GROUP BY 1, 2",
)
def row_union_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = _customers(spark, sf_dir)
    out = rows.union_natural(s, d, ["c_custkey"], "version").where("lost is not null")
    return out.groupBy("action", "reason").agg(F.count("*").alias("n"), F.max("lost.c_name").alias("last_lost"))


@query(
    "row_union_surrogate",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(event_id % 50 AS BIGINT) AS slot, CAST(round(value) AS BIGINT) AS v FROM events),
    d AS (SELECT user_id, slot, min((event_type, v)) AS there FROM e WHERE event_id % 2 = 0 GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY event_id) AS rn FROM (SELECT * FROM e WHERE event_id % 2 = 1 UNION ALL SELECT event_id + 1, user_id, event_type, slot, v FROM e WHERE event_id % 20 = 0))
    SELECT event_id, CASE WHEN there IS NOT NULL AND there[1] = event_type AND there[2] = v THEN 'adopt' WHEN there IS NOT NULL THEN 'keep-dest' WHEN rn > 1 THEN 'repeat' ELSE 'insert' END AS action
    FROM s LEFT JOIN d USING (user_id, slot)""",
)
def row_union_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 50).alias("slot"), F.round("value").cast("long").alias("v"))
    s = e.where("event_id % 2 = 1").unionByName(e.where("event_id % 20 = 0").withColumn("event_id", F.col("event_id") + 1))
    return rows.union_surrogate(s, e.where("event_id % 2 = 0"), ["user_id", "slot"], "event_id").select("event_id", "action")


@query(
    "row_union_incremental",
    """WITH m AS (SELECT o_custkey, max(epoch_us(o_orderdate)) AS mark FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT o_orderkey, o_custkey FROM orders LEFT JOIN m USING (o_custkey) WHERE mark IS NULL OR epoch_us(o_orderdate) >= mark""",
)
def row_union_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rows.since_marks(o, rows.marks_of(o.where("o_orderkey % 3 = 0"), "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate").drop("o_orderdate")


_THREADS = """r AS (SELECT o_custkey AS thread, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
  th AS (SELECT c_custkey AS thread, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'source' WHEN 1 THEN 'dest' ELSE 'same' END AS winner FROM customer),
  d AS (SELECT thread, id, ord, 'x' AS body FROM r WHERE id % 3 <> 0),
  s AS (SELECT thread, id, CASE WHEN id % 5 = 0 THEN ord + 1 ELSE ord END AS ord, CASE WHEN id % 4 = 0 THEN 'y' ELSE 'x' END AS body, id AS rowid FROM r WHERE id % 2 = 0),
  b AS (SELECT s.*, d.id IS NOT NULL AS hit, d.ord AS d_ord, d.body AS d_body, th.winner FROM s LEFT JOIN d ON s.thread = d.thread AND s.id = d.id LEFT JOIN th ON th.thread = s.thread),
  c AS (SELECT b.*, winner IN ('source', 'dest') AND NOT hit AND (
      EXISTS (SELECT 1 FROM b e WHERE e.thread = b.thread AND e.rowid < b.rowid AND e.ord = b.ord AND (NOT e.hit OR e.winner = 'source'))
      OR EXISTS (SELECT 1 FROM d x WHERE x.thread = b.thread AND x.ord = b.ord AND NOT (b.winner = 'source' AND EXISTS (SELECT 1 FROM b e WHERE e.thread = b.thread AND e.id = x.id AND e.rowid < b.rowid)))) AS clash FROM b),
  f AS (SELECT *, min(CASE WHEN clash THEN rowid END) OVER (PARTITION BY thread) AS first FROM c)"""


@query(
    "row_union_threads",
    f"""WITH {_THREADS} SELECT thread, id, CASE WHEN rowid >= first THEN 'held' WHEN NOT hit THEN 'insert' WHEN ord = d_ord AND body = d_body THEN 'adopt' WHEN winner = 'source' THEN 'replace' ELSE 'hold' END AS outcome FROM f""",
)
def row_union_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"))
    winner = F.element_at(F.array(F.lit("source"), F.lit("dest"), F.lit("same")), (F.col("c_custkey") % 3 + 1).cast("int"))
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread"), winner.alias("winner"))
    d = r.where("id % 3 <> 0").withColumn("body", F.lit("x"))
    s = r.where("id % 2 = 0").select(
        "thread", "id", F.when(F.expr("id % 5 = 0"), F.col("ord") + 1).otherwise(F.col("ord")).alias("ord"), F.when(F.expr("id % 4 = 0"), "y").otherwise("x").alias("body"), F.col("id").alias("rowid")
    )
    return rows.union_threads(threads, s, d, "thread", ["id"], "ord", "rowid").select("thread", "id", "outcome")
