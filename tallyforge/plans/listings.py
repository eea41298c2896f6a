"""Queries on listings, sets of names and ids, ordered digests and roll-ups of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listings, rows
from .catalogue import query
from .tables import table


@query("refs_listed", "SELECT sha256(p_partkey::VARCHAR)[1:40] AS oid, 'refs/heads/a b' || p_partkey AS name FROM part")
def refs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return listings.refs_listed(table(spark, sf_dir, "part").select(F.concat(F.substring(F.sha2(k, 256), 1, 40), F.lit(" refs/heads/a b"), k).alias("line")), "line")


@query(
    "stash_listed",
    """SELECT CASE WHEN p_partkey % 3 = 0 THEN sha256(p_partkey::VARCHAR) END AS oid, CASE WHEN p_partkey % 3 = 0 THEN 'WIP ' || p_partkey END AS message, p_partkey % 3 = 0 AS valid FROM part WHERE p_partkey % 5 > 0""",
)
def stash_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.sha2(k.cast("string"), 256), F.when(k % 3 == 0, "\x00").when(k % 3 == 1, " ").otherwise("zz\x00"), F.lit("WIP "), k.cast("string"))
    return listings.stash_listed(table(spark, sf_dir, "part").select(F.when(k % 5 > 0, line).otherwise("").alias("line")), "line")


@query("nul_records", "SELECT conv_id, turn AS pos, role || turn AS record FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS turn FROM conversations)")
def nul_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    blob = F.concat(F.array_join(F.transform("r", lambda x, i: F.concat(x["role"], i.cast("string"))), "\x00"), F.lit("\x00"))
    return listings.nul_records(c.select("conv_id", blob.alias("blob")), "conv_id", "blob").withColumn("pos", F.col("pos").cast("long"))


_TREE = "f AS (SELECT doc_id, source || '/' || doc_id % 7 || '/' || doc_id AS path FROM documents)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string"), F.col("doc_id").cast("string")).alias("path"))


@query("pruned_paths", f"WITH {_TREE}, x AS (SELECT DISTINCT source || '/' || doc_id % 7 AS p FROM documents WHERE doc_id % 7 IN (1, 2)) SELECT doc_id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM x WHERE f.path = x.p OR starts_with(f.path, x.p || '/'))")
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").where("doc_id % 7 in (1, 2)").select(F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string")).alias("prefix"))
    return listings.pruned(_tree(spark, sf_dir), "path", x)


@query(
    "asides",
    """WITH f AS (SELECT p_size::VARCHAR AS dir, 'f' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.txt' ELSE '' END AS name, p_partkey AS k FROM part),
    x AS (SELECT dir, name FROM f UNION ALL SELECT dir, CASE WHEN k % 16 = 8 THEN 'gone' ELSE '' END || name || CASE CAST(k % 8 AS INT) WHEN 0 THEN '.host-2026.01' WHEN 1 THEN '.old' WHEN 2 THEN '.older' WHEN 3 THEN '.spare-' WHEN 4 THEN '.x.host-1' ELSE '.bak' END FROM f)
    SELECT DISTINCT a.dir, b.name, a.name AS aside FROM x a JOIN x b ON a.dir = b.dir AND starts_with(a.name, b.name || '.')
      AND (starts_with(substr(a.name, length(b.name) + 2), 'host-') OR starts_with(substr(a.name, length(b.name) + 2), 'spare-') OR substr(a.name, length(b.name) + 2) = 'old')""",
)
def asides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("dir"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise("")).alias("name"), k.alias("k"))
    tail = F.element_at(F.array(*map(F.lit, [".host-2026.01", ".old", ".older", ".spare-", ".x.host-1", ".bak", ".bak", ".bak"])), (F.col("k") % 8 + 1).cast("int"))
    more = f.select("dir", F.concat(F.when(F.expr("k % 16 = 8"), "gone").otherwise(""), "name", tail).alias("name"))
    return listings.asides(f.select("dir", "name").union(more), ["host", "spare"], "old")


@query(
    "name_elsewhere",
    """WITH f AS (SELECT c_nationkey AS key, c_custkey % 40 AS name FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_nationkey AS key, c_custkey % 60 AS name FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 6 = 0)
    SELECT f.key, f.name, EXISTS (SELECT 1 FROM o WHERE o.name = f.name AND o.key <> f.key) AS held FROM f""",
)
def name_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    f = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("key"), F.expr("c_custkey % 40").alias("name"))
    return listings.elsewhere(f, c.where("c_custkey % 2 = 1 or c_custkey % 6 = 0").select(F.col("c_nationkey").alias("key"), F.expr("c_custkey % 60").alias("name")))


@query("have_and_lack", "SELECT DISTINCT l_partkey AS id, CASE WHEN l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 3 = 0) THEN 'have' ELSE 'lack' END AS state FROM lineitem WHERE l_orderkey % 2 = 0")
def have_and_lack(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey")
    return listings.holdings(l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 3 = 0"), "id")


@query(
    "manifest_states",
    "WITH r AS (SELECT l_orderkey AS name, max(l_linenumber) AS started FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) SELECT o_orderkey AS name, CASE WHEN started IS NULL THEN 'missing' WHEN started < 4 THEN 'stale' ELSE 'there' END AS state FROM orders LEFT JOIN r ON name = o_orderkey",
)
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("started"))
    return listings.expected(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name")), r, 4)


@query(
    "reviews_unmatched",
    """WITH o AS (SELECT o_orderkey AS item, o_custkey AS instance, 'C' || o_orderkey % 6 AS code FROM orders), held AS (SELECT item, instance, code FROM o WHERE item % 4 = 0 AND code <> 'C5'),
    rev AS (SELECT CASE WHEN item % 50 > 0 THEN item END AS item, CASE WHEN item % 50 = 0 THEN NULL WHEN item % 3 = 0 THEN -1 ELSE instance END AS instance, CASE WHEN item % 7 = 3 THEN 'C3' ELSE code END AS code FROM o)
    SELECT DISTINCT item, code, CASE WHEN code = 'C5' THEN 'refusal-code-retired' WHEN EXISTS (SELECT 1 FROM held h WHERE h.item = rev.item AND h.code = rev.code) THEN 'refusal-instance-stale' ELSE 'no-such-refusal' END AS reason FROM rev
    WHERE code = 'C5' OR (item IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.item = rev.item AND h.instance = rev.instance AND h.code = rev.code))""",
)
def reviews_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("instance"), F.expr("concat('C', o_orderkey % 6)").alias("code"))
    reviews = o.selectExpr("if(item % 50 > 0, item, null) as item", "case when item % 50 = 0 then null when item % 3 = 0 then -1 else instance end as instance", "if(item % 7 = 3, 'C3', code) as code")
    codes = o.where("code <> 'C5'").select("code").distinct()
    return listings.unmatched_reviews(reviews, o.where("item % 4 = 0 and code <> 'C5'"), codes)


@query(
    "manifest_roots",
    """WITH v AS (SELECT l_orderkey, l_linenumber AS o, length(l_partkey::VARCHAR) || ':' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN '~' ELSE length(l_suppkey::VARCHAR) || ':' || l_suppkey END AS v FROM lineitem)
    SELECT l_orderkey, sha256(string_agg(v, '' ORDER BY o, v)) AS root FROM v GROUP BY 1""",
)
def manifest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.when(F.expr("l_linenumber % 3 > 0"), F.col("l_suppkey")))
    return listings.folded(l, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "corpus_identity",
    """WITH a AS (SELECT doc_id // 64 AS run, sha256(string_agg(length(doc_id::VARCHAR) || ':' || doc_id || length(n_chars::VARCHAR) || ':' || n_chars, '' ORDER BY doc_id)) AS root FROM documents GROUP BY 1),
    b AS (SELECT run // 64 AS run, sha256(string_agg(length(run::VARCHAR) || ':' || run || '64:' || root, '' ORDER BY run)) AS root FROM a GROUP BY 1),
    c AS (SELECT run // 64 AS run, sha256(string_agg(length(run::VARCHAR) || ':' || run || '64:' || root, '' ORDER BY run)) AS root FROM b GROUP BY 1),
    d AS (SELECT run // 64 AS run, sha256(string_agg(length(run::VARCHAR) || ':' || run || '64:' || root, '' ORDER BY run)) AS root FROM c GROUP BY 1)
    SELECT CASE WHEN m < 64 THEN (SELECT max(root) FROM a) WHEN m < 4096 THEN (SELECT max(root) FROM b) WHEN m < 262144 THEN (SELECT max(root) FROM c) ELSE (SELECT max(root) FROM d) END AS root FROM (SELECT max(doc_id) AS m FROM documents)""",
)
def corpus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.identity(table(spark, sf_dir, "documents"), "doc_id", 64, "n_chars")


@query("item_digests", "SELECT event_id, sha256(length(event_type) || ':' || event_type || '|' || coalesce(length(u::VARCHAR) || ':' || u, '~')) AS digest FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 > 0 THEN user_id END AS u FROM events)")
def item_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("u", F.when(F.expr("event_id % 3 > 0"), F.col("user_id"))).select("event_id", listings.item_digest("event_type", "u").alias("digest"))


@query("weighted_level", "SELECT event_type, round(sum(value * n) / sum(n), 6) AS level FROM (SELECT event_type, value, event_id % 9 AS n FROM events) GROUP BY 1")
def weighted_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value", F.expr("event_id % 9").alias("n"))
    return listings.weighted_level(e, ["event_type"], "value", "n").withColumn("level", F.round("level", 6))


@query("share_of_wall", "SELECT l_returnflag, round(sum(l_partkey % 100)::DOUBLE / sum(l_partkey), 6) AS share FROM lineitem GROUP BY 1")
def share_of_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr("l_partkey % 100").alias("part"), F.col("l_partkey").alias("whole"))
    return listings.share_of(l, ["l_returnflag"], "part", "whole").withColumn("share", F.round("share", 6))


_BLOCKS = "b AS (SELECT user_id, (event_id % 1000 - 100) // 30 AS block, count(*) AS n FROM events WHERE event_id % 1000 >= 100 AND event_id % 1000 < 900 GROUP BY ALL)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.expr("event_id % 1000").alias("t"), F.lit(0).alias("a"), F.lit(900).alias("b"))
    return listings.settled_blocks(e, "t", "a", "b", 100, 30).groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query("settled_blocks", f"WITH {_BLOCKS} SELECT * FROM b")
def settled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(
    "early_and_late",
    f"""WITH {_BLOCKS}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY block) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM b)
    SELECT user_id, CASE WHEN i <= m // 2 THEN 'early' ELSE 'late' END AS half, CAST(sum(n) AS BIGINT) AS n FROM i WHERE i <= m // 2 OR i > (m + 1) // 2 GROUP BY 1, 2""",
)
def early_and_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.halves(_blocks(spark, sf_dir), "user_id", "block").groupBy("user_id", "half").agg(F.sum("n").alias("n"))


@query(
    "omission_back_fill",
    """WITH r AS (SELECT o_custkey AS w, 'a' AS metric, o_orderkey AS value FROM orders), m AS (SELECT o_custkey AS w, o_orderkey * 2 AS lag FROM orders WHERE o_orderkey % 10 = 0),
    x AS (SELECT * FROM r UNION ALL SELECT w, unnest(['a', 'b']), lag FROM m) SELECT w AS "window", metric, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM x GROUP BY 1, 2""",
)
def omission_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("window"), F.lit("a").alias("metric"), F.col("o_orderkey").alias("value"))
    missed = o.where("value % 10 = 0").select("window", (F.col("value") * 2).alias("lag"))
    return listings.back_filled(o, missed, ["a", "b"]).groupBy("window", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_SAMPLES = """s AS (SELECT l_suppkey % 97 AS run, CASE WHEN l_orderkey % 2 = 0 THEN 'ours' ELSE 'theirs' END AS arm, ['initial', 'delta', 'warm-resume', 'interrupted-resume'][CAST(l_linenumber % 4 + 1 AS INT)] AS phase,
  l_partkey % 100 + CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 97 % 3 - 1 ELSE 0 END * 20 AS ms, CASE WHEN l_suppkey % 97 % 5 = 1 AND l_linenumber % 4 = 3 THEN NULL ELSE 0 END AS transferred,
  CASE WHEN l_suppkey % 97 % 5 = 2 AND l_linenumber % 4 = 2 THEN 1 ELSE 0 END AS source_read, CASE WHEN l_suppkey % 97 % 6 = 5 AND l_partkey % 50 = 0 THEN 2097152 ELSE 1000 END AS rss_kib, l_suppkey % 97 % 11 > 0 AS gated FROM lineitem)"""


@query(
    "bench_gate",
    f"""WITH {_SAMPLES}, g AS (SELECT run, coalesce(median(ms) FILTER (arm = 'ours' AND phase = 'initial') < median(ms) FILTER (arm = 'theirs' AND phase = 'initial'), false) AS initial_win,
      coalesce(median(ms) FILTER (arm = 'ours' AND phase = 'delta') < median(ms) FILTER (arm = 'theirs' AND phase = 'delta'), false) AS delta_win,
      count(*) FILTER (arm = 'ours' AND phase = 'warm-resume' AND (transferred IS DISTINCT FROM 0 OR source_read IS DISTINCT FROM 0)) = 0 AS warm_zero,
      count(*) FILTER (arm = 'ours' AND phase = 'interrupted-resume' AND (transferred IS DISTINCT FROM 0 OR source_read IS DISTINCT FROM 0)) = 0 AS interrupted_zero,
      count(*) FILTER (arm = 'ours' AND rss_kib >= 2097152) = 0 AS memory_ok, bool_and(gated) AS gated FROM s GROUP BY 1)
    SELECT run, initial_win, delta_win, warm_zero, interrupted_zero, memory_ok, CASE WHEN NOT gated THEN 'INFORMATIONAL' WHEN initial_win AND delta_win AND warm_zero AND interrupted_zero AND memory_ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""",
)
def bench_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("run", F.expr("l_suppkey % 97"))
    s = l.selectExpr(
        "run", "if(l_orderkey % 2 = 0, 'ours', 'theirs') as arm", "element_at(array('initial', 'delta', 'warm-resume', 'interrupted-resume'), cast(l_linenumber % 4 + 1 as int)) as phase",
        "l_partkey % 100 + if(l_orderkey % 2 = 0, run % 3 - 1, 0) * 20 as ms", "if(run % 5 = 1 and l_linenumber % 4 = 3, null, 0) as transferred", "if(run % 5 = 2 and l_linenumber % 4 = 2, 1, 0) as source_read",
        "if(run % 6 = 5 and l_partkey % 50 = 0, 2097152, 1000) as rss_kib", "run % 11 > 0 as gated",
    )
    return listings.bench_gate(s, "run")


@query(
    "one_percent_delta",
    """WITH f AS (SELECT source, doc_id, n_chars, CAST(ceil(sum(n_chars) OVER (PARTITION BY source) / 100) AS BIGINT) - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM documents WHERE n_chars > 0)
    SELECT source, doc_id, CAST(least(l, n_chars) AS BIGINT) AS bytes FROM f WHERE l > 0""",
)
def one_percent_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.one_percent(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars").select("source", "doc_id", F.col("bytes").cast("long").alias("bytes"))


_PAYLOAD = """a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'link' ELSE 'file' END AS kind, p_size AS size, 1 AS mtime FROM part),
  b AS (SELECT 'as it is' AS what, * FROM a UNION ALL SELECT 'times differ', k, kind, size, CASE WHEN kind = 'link' THEN 2 ELSE 1 END FROM a
    UNION ALL SELECT 'sizes differ', k, kind, size + CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END, mtime FROM a UNION ALL SELECT 'one gone', * FROM a WHERE k <> 1)"""


@query(
    "payload_equality",
    f"""WITH {_PAYLOAD}, w AS (SELECT DISTINCT what FROM b), x AS (SELECT w.what, a.* FROM a, w)
    SELECT coalesce(x.what, b.what) AS what, bool_and(coalesce(x.kind = b.kind AND x.size = b.size AND (x.kind = 'link' OR x.mtime = b.mtime), false)) AS equal FROM x FULL JOIN b ON x.what = b.what AND x.k = b.k GROUP BY 1""",
)
def payload_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.when(F.expr("p_partkey % 3 = 0"), "link").otherwise("file").alias("kind"), F.col("p_size").alias("size"), F.lit(1).alias("mtime"))
    sides = {
        "as it is": a, "times differ": a.withColumn("mtime", F.when(F.col("kind") == "link", 2).otherwise(1)),
        "sizes differ": a.withColumn("size", F.col("size") + F.expr("if(p_partkey % 6 = 1, 1, 0)")), "one gone": a.where("p_partkey <> 1"),
    }
    out = None
    for what, b in sides.items():
        one = listings.payload_equal(a, b, "p_partkey", "kind", {"file": ["size", "mtime"], "link": ["size"]}).select(F.lit(what).alias("what"), "equal")
        out = one if out is None else out.union(one)
    return out


@query(
    "omission_totals",
    "SELECT o_orderstatus, CAST(coalesce(sum(e), 0) AS BIGINT) AS entries, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes, count(*) FILTER (e IS NULL) AS unknown FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS e, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS b FROM orders) GROUP BY 1",
)
def omission_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.expr("o_orderkey % 4 > 0")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(known, F.col("o_custkey")).alias("entries"), F.when(known, F.col("o_orderkey")).alias("bytes"))
    return listings.omissions(o, ["o_orderstatus"])


@query(
    "ids_missing",
    """WITH e AS (SELECT DISTINCT user_id, event_id % 40 AS i FROM events WHERE event_id % 2 = 0), t AS (SELECT DISTINCT user_id, event_id % 40 AS i, true AS h FROM events WHERE event_id % 3 = 0)
    SELECT user_id, count(*) AS ids, count(*) FILTER (h IS NULL) AS missing FROM e LEFT JOIN t USING (user_id, i) GROUP BY 1""",
)
def ids_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.format_string('{"turn_id":"%d","call_id":"%d"}', F.expr("event_id % 40"), F.expr("event_id % 40")).alias("line"))
    return listings.ids_missing(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "user_id", "line", '"(?:turn_id|call_id)":"([^"]+)"')


@query(
    "refs_united",
    """WITH s AS (SELECT p_partkey AS oid, CASE WHEN p_partkey % 10 = 3 THEN 'refs/remotes/o/' WHEN p_partkey % 10 = 7 THEN 'refs/tags/' WHEN p_partkey = 5 THEN 'refs/stash' ELSE 'refs/heads/' END || CASE WHEN p_partkey = 5 THEN '' ELSE p_partkey::VARCHAR END AS name FROM part),
    d AS (SELECT name, CASE CAST(oid % 4 AS INT) WHEN 0 THEN oid WHEN 1 THEN oid - 1 WHEN 2 THEN oid + 1 ELSE oid + 5 END AS oid FROM s WHERE oid % 9 > 0), c AS (SELECT name, oid % 3 > 0 AS clean FROM s WHERE oid % 6 = 1)
    SELECT s.name, CASE WHEN d.oid IS NULL THEN 'create' WHEN s.oid = d.oid THEN 'same' WHEN d.oid = s.oid - 1 THEN CASE WHEN clean IS NULL THEN 'forward' WHEN clean THEN 'switch' ELSE 'track' END WHEN d.oid = s.oid + 1 THEN 'kept' ELSE 'track' END AS action,
      CASE WHEN action = 'track' THEN CASE WHEN starts_with(s.name, 'refs/heads/') THEN 'refs/remotes/there/' || s.name[12:] ELSE 'refs/remotes/there/' || s.name[6:] END END AS tracking
    FROM s LEFT JOIN d USING (name) LEFT JOIN c USING (name) WHERE s.name <> 'refs/stash' AND NOT starts_with(s.name, 'refs/remotes/')""",
)
def refs_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case when p_partkey % 10 = 3 then 'refs/remotes/o/' when p_partkey % 10 = 7 then 'refs/tags/' when p_partkey = 5 then 'refs/stash' else 'refs/heads/' end"
    s = table(spark, sf_dir, "part").selectExpr("p_partkey as oid", f"concat({kind}, if(p_partkey = 5, '', cast(p_partkey as string))) as name")
    d = s.where("oid % 9 > 0").selectExpr("name", "case oid % 4 when 0 then oid when 1 then oid - 1 when 2 then oid + 1 else oid + 5 end as oid")
    ahead = s.select(F.explode(F.array(F.col("oid"), F.col("oid") + 1)).alias("oid")).select("oid", (F.col("oid") - 1).alias("ancestor"))
    return listings.refs_united(s, d, ahead, "there", s.where("oid % 6 = 1").selectExpr("name", "oid % 3 > 0 as clean"))


@query("projected_rows", "SELECT c_custkey, '/home/' || CASE WHEN c_custkey % 4 = 0 THEN '../' ELSE '' END || c_custkey AS path, c_custkey % 4 > 0 AS supported FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'rel/' || c_custkey, false FROM customer WHERE c_custkey % 3 = 0")
def projected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    path = F.when(F.expr("c_custkey % 3 = 0"), F.concat(F.lit("rel/"), k)).otherwise(F.concat(F.lit("/home/"), F.when(F.expr("c_custkey % 4 = 0"), "../").otherwise(""), k))
    return listings.projected(table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"), "c_name"), ["c_custkey", "path"], "path")


@query(
    "worktree_fields",
    """SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, '/w t/' || c_custkey AS path, CASE WHEN c_custkey % 4 > 0 THEN md5(c_custkey::VARCHAR) END AS head, CASE WHEN c_custkey % 4 = 1 THEN 'refs/heads/b' || c_custkey END AS branch,
    c_custkey % 4 = 0 AS bare, c_custkey % 4 > 1 AS detached, c_custkey % 7 = 0 AS locked, false AS prunable FROM customer""",
)
def worktree_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("concat('worktree /w t/', c_custkey, '\\0', case c_custkey % 4 when 0 then 'bare' when 1 then concat('HEAD ', md5(cast(c_custkey as string)), '\\0branch refs/heads/b', c_custkey) else concat('HEAD ', md5(cast(c_custkey as string)), '\\0detached') end, if(c_custkey % 7 = 0, '\\0locked by hand', ''), '\\0\\0')")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("r")))), lambda x: x["r"]), "").alias("blob"))
    return listings.worktrees(c, "c_nationkey", "blob")


@query("directory_order", f"WITH {_TREE} SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, row_number() OVER (PARTITION BY dir ORDER BY regexp_extract(path, '[^/]*$')) AS place FROM f")
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.in_directory_order(_tree(spark, sf_dir).select("path"), "path").withColumn("place", F.col("place").cast("long"))


@query(
    "joined_samples",
    """SELECT l_orderkey::VARCHAR AS sequence, 'p' || l_linenumber AS phase, l_partkey::VARCHAR AS ms, max(CASE WHEN l_orderkey % 3 > 0 AND l_suppkey % 4 > 0 THEN l_suppkey::VARCHAR END) OVER (PARTITION BY l_orderkey, l_linenumber) AS rss, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber::VARCHAR END AS reread FROM lineitem""",
)
def joined_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    kinds = [("true", "'sample sequence=', l_orderkey, ' phase=p', l_linenumber, ' ms=', l_partkey"), ("l_orderkey % 3 > 0", "'memory phase=p', l_linenumber, ' sequence=', l_orderkey, ' rss=', if(l_suppkey % 4 > 0, cast(l_suppkey as string), 'unknown')"), ("l_orderkey % 5 = 0", "'read sequence=', l_orderkey, ' phase=p', l_linenumber, ' reread=9 reread=', l_linenumber")]
    lines = None
    for where, parts in kinds:
        one = l.where(where).selectExpr(f"concat({parts}) as line")
        lines = one if lines is None else lines.union(one)
    return listings.joined_samples(lines, "line", "sample", ["memory", "read"], ["sequence", "phase"], {"sample": ["ms"], "memory": ["rss"], "read": ["reread"]})


@query(
    "unique_probe",
    """WITH s AS (SELECT c_custkey AS pos, 'n' || c_custkey % 700 AS a, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 900 END AS b, c_nationkey::BIGINT AS v FROM customer WHERE c_custkey % 3 > 0), d AS (SELECT 'n' || c_custkey % 2100 AS a, c_custkey % 1800 AS b, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE -1 END::BIGINT AS v FROM customer WHERE c_custkey % 3 = 0),
    da AS (SELECT a, min({'a': a, 'b': b, 'v': v}) AS r FROM d GROUP BY 1), db AS (SELECT b, min({'a': a, 'b': b, 'v': v}) AS r FROM d GROUP BY 1),
    x AS (SELECT s.*, coalesce(da.r, db.r) AS r, CASE WHEN da.r IS NOT NULL THEN 1 WHEN db.r IS NOT NULL THEN 2 END AS key_no FROM s LEFT JOIN da ON da.a = s.a LEFT JOIN db ON db.b = s.b),
    f AS (SELECT pos, a, b, v, least(min(pos) OVER (PARTITION BY a), CASE WHEN b IS NOT NULL THEN min(pos) OVER (PARTITION BY b) ELSE pos END) < pos AS again FROM x WHERE key_no IS NULL)
    SELECT pos, a, b, v, CASE WHEN again THEN 'repeat' ELSE 'insert' END AS action, CAST(NULL AS INTEGER) AS key_no FROM f UNION ALL SELECT pos, a, b, v, CASE WHEN r.a = a AND r.b IS NOT DISTINCT FROM b AND r.v = v THEN 'adopt' ELSE 'keep-dest' END, key_no FROM x WHERE key_no IS NOT NULL""",
)
def unique_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    s = c.where("c_custkey % 3 > 0").selectExpr("c_custkey as pos", "concat('n', c_custkey % 700) as a", "if(c_custkey % 5 > 0, c_custkey % 900, null) as b", "cast(c_nationkey as bigint) as v")
    d = c.where("c_custkey % 3 = 0").selectExpr("concat('n', c_custkey % 2100) as a", "c_custkey % 1800 as b", "cast(if(c_custkey % 2 = 0, c_nationkey, -1) as bigint) as v")
    return rows.unique_probe(s, d, [["a"], ["b"]], "pos")
