"""Queries on reuse, references, paths, documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closure, documents, history, paths, refs
from .catalogue import query
from .tables import table


@query(
    "reuse_decision",
    """WITH held AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'refused' WHEN h.k IS NULL THEN 'send' WHEN h.p = o_totalprice THEN 'reuse' ELSE 'stale' END AS decision FROM orders LEFT JOIN held h ON h.k = o_orderkey""",
)
def reuse_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    held = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_totalprice") + F.when(F.expr("o_orderkey % 6 = 1"), 1).otherwise(0)).alias("p"), F.lit(True).alias("held"))
    refused = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(True).alias("no"))
    x = o.join(held, "o_orderkey", "left").join(refused, "o_orderkey", "left")
    return x.select("o_orderkey", F.when(F.col("no"), "refused").when(F.col("held").isNull(), "send").when(F.col("p") == F.col("o_totalprice"), "reuse").otherwise("stale").alias("decision"))


_REFS = """p AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'refs/remotes/o/' ELSE 'refs/heads/' END || CAST(p_partkey AS VARCHAR) AS name, p_partkey AS k, p_size AS t FROM part),
  n AS (SELECT name, md5(name || CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END) AS oid, k % 97 = 0 AS checked_out FROM p WHERE k % 3 <> 0),
  l AS (SELECT name, CASE WHEN k % 11 = 0 THEN NULL ELSE md5(name || CASE WHEN k % 8 = 0 THEN 'x' ELSE '' END) END AS oid, 25 AS t FROM p WHERE k % 2 = 0),
  c AS (SELECT name, md5(name || CASE WHEN k % 9 = 0 THEN 'y' ELSE '' END) AS oid, t FROM p WHERE k % 7 <> 0)"""


@query(
    "ref_three_way",
    f"""WITH {_REFS}, x AS (SELECT coalesce(n.name, l.name, c.name) AS name, n.oid AS n, checked_out, l.oid AS l, l.t AS tl, l.name IS NOT NULL AS r, c.oid AS c, c.t AS t
      FROM n FULL JOIN l ON n.name = l.name FULL JOIN c ON c.name = coalesce(n.name, l.name))
    SELECT name, CASE WHEN coalesce(checked_out, false) THEN 'skip' WHEN r AND l IS NULL AND c IS NOT NULL AND NOT coalesce(t, 0) > coalesce(tl, -1) THEN 'stale'
      WHEN n IS NULL AND c IS NULL THEN CASE WHEN r AND l IS NULL THEN 'move-tombstone' ELSE 'deleted-at-both' END
      WHEN n IS NULL AND (NOT r OR l IS NULL) THEN 'create' WHEN n IS NULL THEN 'deleted-at-destination'
      WHEN (NOT r OR l IS NULL) AND n = c THEN 'adopt' WHEN NOT r OR l IS NULL THEN 'keep-dest' WHEN n <> l THEN 'modified' WHEN n = c THEN 'verify'
      WHEN c IS NOT NULL AND NOT coalesce(t, 0) > coalesce(tl, -1) THEN 'stale' WHEN c IS NOT NULL THEN 'move' WHEN name LIKE 'refs/remotes/%' THEN 'prune' ELSE 'deleted-at-source' END AS action FROM x""",
)
def ref_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.concat(F.when(F.expr("p_partkey % 5 = 0"), "refs/remotes/o/").otherwise("refs/heads/"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("k"), F.col("p_size").alias("t")
    )

    def oid(mod: int, mark: str) -> F.Column:
        return F.md5(F.concat("name", F.when(F.col("k") % mod == 0, mark).otherwise("")))

    n = p.where("k % 3 <> 0").select("name", oid(4, "x").alias("oid"), F.expr("k % 97 = 0").alias("checked_out"))
    l = p.where("k % 2 = 0").select("name", F.when(F.expr("k % 11 <> 0"), oid(8, "x")).alias("oid"), F.lit(25).alias("t"))
    return refs.decide(n, l, p.where("k % 7 <> 0").select("name", oid(9, "y").alias("oid"), "t"))


_ANCESTRY = """WITH RECURSIVE e AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0), up AS (SELECT child, parent AS ancestor FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON up.ancestor = e.child),
    s AS (SELECT o_orderkey AS name, o_orderkey AS oid FROM orders WHERE o_orderkey % 3 <> 0),
    d AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 4 WHEN o_orderkey % 4 = 1 THEN o_orderkey * 2 WHEN o_orderkey % 4 = 2 THEN o_orderkey ELSE o_orderkey + 1 END AS oid FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT coalesce(s.name, d.name) AS name, CASE WHEN d.oid IS NULL THEN 'source-only' WHEN s.oid IS NULL THEN 'dest-only' WHEN s.oid = d.oid THEN 'same' WHEN a.child IS NOT NULL THEN 'source-ahead' WHEN b.child IS NOT NULL THEN 'dest-ahead' ELSE 'diverged' END AS class
    FROM s FULL JOIN d ON s.name = d.name LEFT JOIN up a ON a.child = s.oid AND a.ancestor = d.oid LEFT JOIN up b ON b.child = d.oid AND b.ancestor = s.oid"""


@query("ref_class_ancestry", _ANCESTRY)
@query("ref_class_ancestry_all", _ANCESTRY)
def ref_class_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ref_classes(table(spark, sf_dir, "orders"))


def _ref_classes(orders: DataFrame) -> DataFrame:
    o = orders.select(F.col("o_orderkey").alias("k"))
    edges = o.where("k > 0").select(F.col("k").alias("child"), F.expr("k div 2").alias("parent"))
    s = o.where("k % 3 <> 0").select(F.col("k").alias("name"), F.col("k").alias("oid"))
    d = o.where("k % 5 <> 0").select(F.col("k").alias("name"), F.expr("case k % 4 when 0 then k div 4 when 1 then k * 2 when 2 then k else k + 1 end").alias("oid"))
    both = s.select("name", F.col("oid").alias("a")).join(d.select("name", F.col("oid").alias("b")), "name")
    asked = both.select(F.col("a").alias("child"), F.col("b").alias("ancestor")).union(both.select("b", "a"))
    return refs.classes(s, d, history.above(history.index(edges), asked))


@query(
    "have_want",
    """WITH RECURSIVE e AS (SELECT l_orderkey * 10 + l_linenumber AS child, l_orderkey * 10 + l_linenumber - 1 AS parent FROM lineitem WHERE l_linenumber > 1
      UNION SELECT o_orderkey * 10 + 1, (o_orderkey // 2) * 10 + 1 FROM orders WHERE o_orderkey > 1 UNION SELECT o_orderkey * 10 + 1, (o_orderkey // 3) * 10 + 1 FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey > 1),
    w AS (SELECT l_orderkey * 10 + l_linenumber AS node FROM lineitem WHERE l_orderkey % 5 = 0), o AS (SELECT l_orderkey * 10 + l_linenumber AS node FROM lineitem WHERE l_orderkey % 35 = 0 OR l_orderkey % 11 = 0 UNION SELECT -1),
    n AS (SELECT child AS node FROM e UNION SELECT parent FROM e UNION SELECT node FROM w), h AS (SELECT node FROM o WHERE node IN (SELECT node FROM n)), d AS (SELECT node FROM w WHERE node NOT IN (SELECT node FROM h)),
    rd AS (SELECT node FROM d UNION SELECT e.parent FROM rd JOIN e ON e.child = rd.node), rh AS (SELECT node FROM h UNION SELECT e.parent FROM rh JOIN e ON e.child = rh.node)
    SELECT node FROM rd EXCEPT SELECT node FROM rh""",
)
def have_want(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    edges = l.where("l_linenumber > 1").select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"))
    edges = edges.union(o.where("k > 1").selectExpr("k * 10 + 1", "(k div 2) * 10 + 1")).union(o.where("k % 8 = 0 and k > 1").selectExpr("k * 10 + 1", "(k div 3) * 10 + 1"))
    offered = l.where("l_orderkey % 35 = 0 or l_orderkey % 11 = 0").select("node").union(spark.range(1).selectExpr("-1"))
    return history.have_want(edges, l.where("l_orderkey % 5 = 0").select("node"), offered)


_NAMES = "nm AS (SELECT 'a/' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS name, p_partkey AS k FROM part)"


@query(
    "ref_name_conflicts",
    f"WITH {_NAMES}, al AS (SELECT DISTINCT name FROM nm) SELECT DISTINCT c.name FROM nm c JOIN al a ON a.name LIKE c.name || '/%' OR c.name LIKE a.name || '/%' WHERE c.k % 2 = 0",
)
def ref_name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(
        F.concat(F.lit("a/"), F.col("p_size").cast("string"), F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit("/"), F.col("p_partkey").cast("string"))).otherwise("")).alias("name"), F.col("p_partkey").alias("k")
    )
    return refs.name_conflicts(n.where("k % 2 = 0"), n)


_URL = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))


_MAPS = "m AS (SELECT DISTINCT split_part(path, '/', 1) AS owner, '/host/' || split_part(path, '/', 1) AS target FROM u WHERE page_id % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), '/lang/' || split_part(path, '/', 2) FROM u WHERE page_id % 5 = 0 AND path LIKE '%/%')"


def _maps(u: DataFrame) -> DataFrame:
    host, lang = F.split("path", "/")[0], F.get(F.split("path", "/"), F.lit(1))
    return (
        u.where("page_id % 3 = 0").select(host.alias("owner"), F.concat(F.lit("/host/"), host).alias("target"))
        .union(u.where("page_id % 5 = 0").where(F.col("path").contains("/")).select(F.concat(host, F.lit("/"), lang), F.concat(F.lit("/lang/"), lang)))
        .distinct()
    )


@query(
    "path_map_longest",
    f"""WITH {_URL}, {_MAPS}, x AS (SELECT u.page_id, u.path, m.owner, m.target, row_number() OVER (PARTITION BY page_id ORDER BY length(m.owner) DESC NULLS LAST) AS rn
      FROM u LEFT JOIN m ON u.path = m.owner OR starts_with(u.path, m.owner || '/'))
    SELECT page_id, owner, CASE WHEN owner IS NULL THEN path ELSE target || substr(path, length(owner) + 1) END AS mapped FROM x WHERE rn = 1""",
)
def path_map_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _urls(spark, sf_dir)
    got = paths.owners(u, "path", _maps(u))
    return got.select("page_id", "owner", paths.mapped(F.col("path"), F.col("owner"), F.col("target")).alias("mapped"))


@query(
    "path_owner_conflicts",
    f"""WITH {_URL}, r AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN split_part(path, '/', 1) ELSE path END AS root FROM u)
    , f AS (SELECT root, min(id) AS id FROM r GROUP BY 1)
    SELECT a.id AS "inner", b.id AS "outer" FROM r a JOIN f b ON a.id <> b.id AND (a.root = b.root OR starts_with(a.root, b.root || '/'))""",
)
def path_owner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _urls(spark, sf_dir)
    return paths.overlaps(u.select(F.col("page_id").alias("id"), F.when(F.expr("page_id % 4 = 0"), F.split("path", "/")[0]).otherwise(F.col("path")).alias("root")))


@query(
    "key_map_unique",
    f"""WITH {_URL}, k AS (SELECT DISTINCT regexp_replace(split_part(path, '/', 1), '[^A-Za-z0-9]', '-', 'g') AS source, regexp_replace(substr(path, 1, CASE WHEN page_id % 4 = 0 THEN 6 ELSE 12 END), '[^A-Za-z0-9]', '-', 'g') AS target FROM u)
    SELECT source, target, count(*) OVER (PARTITION BY source) = 1 AND count(*) OVER (PARTITION BY target) = 1 AS usable FROM k""",
)
def key_map_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _urls(spark, sf_dir)
    return paths.unique_keys(u.select(paths.project_key(F.split("path", "/")[0]).alias("source"), paths.project_key(F.expr("substring(path, 1, if(page_id % 4 = 0, 6, 12))")).alias("target")))


_PROPS = """x AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS lk, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS sk,
  CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'live' END AS later FROM events)"""


@query(
    "json_merge_conflicts",
    f"""WITH {_PROPS} SELECT event_id, 'k' AS name, CASE WHEN lk = sk THEN 'same' ELSE later END AS kept_side, CASE WHEN lk = sk OR later = 'live' THEN lk ELSE sk END AS kept,
      CASE WHEN lk = sk THEN NULL WHEN later = 'source' THEN lk ELSE sk END AS lost FROM x
    UNION ALL SELECT event_id, 'added', 'source', CAST(event_id AS VARCHAR), NULL FROM events WHERE event_id % 4 = 0""",
)
def json_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("live"))
    k = F.when(F.expr("event_id % 3 = 0"), (F.col("live")["k"].cast("long") + 1).cast("string")).otherwise(F.col("live")["k"])
    more = F.when(F.expr("event_id % 4 = 0"), F.create_map(F.lit("added"), F.col("event_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    e = e.withColumn("source", F.map_concat(F.create_map(F.lit("k"), k), more)).withColumn("later", F.when(F.expr("event_id % 2 = 0"), "source").otherwise("live"))
    return documents.top_level_conflicts(e, "event_id")


@query(
    "json_array_union",
    """WITH a AS (SELECT o_orderkey, [o_orderkey % 3, o_orderkey % 5, o_orderkey % 3] AS live, [o_orderkey % 4, o_orderkey % 5, o_orderkey % 7, o_orderkey % 4] AS src FROM orders),
    s AS (SELECT o_orderkey, unnest(src) AS v, unnest(range(0, 4)) AS i FROM a), n AS (SELECT s.o_orderkey, v, min(i) AS i FROM s JOIN a USING (o_orderkey) WHERE NOT list_contains(live, v) GROUP BY ALL),
    t AS (SELECT o_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS extra FROM n GROUP BY 1)
    SELECT o_orderkey, array_to_string(live, ',') || coalesce(',' || extra, '') AS merged FROM a LEFT JOIN t USING (o_orderkey)""",
)
def json_array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    got = documents.array_union_by_value(F.array(k % 3, k % 5, k % 3), F.array(k % 4, k % 5, k % 7, k % 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("merged"))


_PLAN = """plan AS (SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 10 <> 9),
  outc AS (SELECT o_orderkey AS item, o_custkey AS instance, CASE WHEN o_orderkey % 4 = 0 THEN 'refused' WHEN o_orderstatus = 'P' THEN 'held' ELSE 'done' END AS state,
    CASE CAST(o_orderkey % 44 AS INT) WHEN 8 THEN 'IO' WHEN 12 THEN 'FRAME_CODEC' WHEN 16 THEN 'TRANSPORT_LOST' WHEN 20 THEN 'OLD' ELSE 'C' || CAST(o_orderkey % 6 AS VARCHAR) END AS code FROM orders WHERE o_orderkey % 13 <> 0),
  rev AS (SELECT 'item' AS scope, o_orderkey AS item, o_custkey AS instance, 'C' || CAST(o_orderkey % 6 AS VARCHAR) AS code, 'accept' AS decision, 1 AS seq FROM orders WHERE o_orderkey % 16 = 0
    UNION ALL SELECT 'item', o_orderkey, o_custkey, 'C' || CAST(o_orderkey % 6 AS VARCHAR), 're-carry', 2 FROM orders WHERE o_orderkey % 32 = 0
    UNION ALL SELECT 'policy', NULL, NULL, 'C2', 'abandon', 3),
  li AS (SELECT item, instance, code, arg_max(decision, seq) AS d FROM rev WHERE scope = 'item' GROUP BY ALL), lp AS (SELECT code, arg_max(decision, seq) AS d FROM rev WHERE scope = 'policy' GROUP BY ALL),
  disp AS (SELECT plan.item, outc.instance, outc.code, coalesce(li.d, lp.d) AS decision, CASE WHEN state IS NULL OR (state = 'refused' AND outc.code IN ('IO', 'FRAME_CODEC', 'TRANSPORT_LOST', 'OLD')) THEN 'unaccounted'
      WHEN state = 'refused' THEN CASE WHEN coalesce(coalesce(li.d, lp.d) IN ('accept', 'abandon'), false) THEN 'refused' ELSE 'refused-pending-review' END ELSE state END AS disposition
    FROM plan LEFT JOIN outc ON outc.item = plan.item LEFT JOIN li ON li.item = outc.item AND li.instance = outc.instance AND li.code = outc.code LEFT JOIN lp ON lp.code = outc.code)"""


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in ("C0", "C1", "C2", "C3", "C4", "C5", "IO", "FRAME_CODEC", "TRANSPORT_LOST")], "code string")


def _closure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    code = F.concat(F.lit("C"), (F.col("o_orderkey") % 6).cast("string")).alias("code")
    state = F.when(F.expr("o_orderkey % 4 = 0"), "refused").when(F.col("o_orderstatus") == "P", "held").otherwise("done").alias("state")
    special = F.expr("case o_orderkey % 44 when 8 then 'IO' when 12 then 'FRAME_CODEC' when 16 then 'TRANSPORT_LOST' when 20 then 'OLD' end")
    outcomes = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("instance"), state, F.coalesce(special, code).alias("code"))

    def review(where: str, decision: str, seq: int) -> DataFrame:
        return o.where(where).select(F.lit("item").alias("scope"), F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("instance"), code, F.lit(decision).alias("decision"), F.lit(seq).alias("seq"))

    policy = spark.range(1).select(F.lit("policy").alias("scope"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("instance"), F.lit("C2").alias("code"), F.lit("abandon").alias("decision"), F.lit(3).alias("seq"))
    reviews = review("o_orderkey % 16 = 0", "accept", 1).union(review("o_orderkey % 32 = 0", "re-carry", 2)).union(policy)
    return o.where("o_orderkey % 10 <> 9").select(F.col("o_orderkey").alias("item")), outcomes, reviews, _codes(spark)


@query("closure_report", f"WITH {_PLAN} SELECT disposition, CASE WHEN disposition LIKE 'refused%' THEN code END AS code, count(*) AS n FROM disp GROUP BY 1, 2")
def closure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.report(closure.dispositions(*_closure(spark, sf_dir)))


@query(
    "closure_gate",
    f"""WITH {_PLAN}, d AS (SELECT disposition FROM disp)
    SELECT -1 AS batch, count(*) FILTER (disposition = 'unaccounted') AS unaccounted, count(*) FILTER (disposition = 'refused-pending-review') AS pending, unaccounted = 0 AND pending = 0 AS passed FROM d
    UNION ALL SELECT 0, 0, 0, true
    UNION ALL SELECT 1, 0, count(*), count(*) = 0 FROM d WHERE disposition = 'refused-pending-review'""",
)
def closure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = closure.dispositions(*_closure(spark, sf_dir))
    parts = {-1: rows, 0: rows.where("disposition not in ('unaccounted', 'refused-pending-review')"), 1: rows.where("disposition <> 'unaccounted'")}
    out = None
    for batch, part in parts.items():
        one = closure.gate(part).select(F.lit(batch).alias("batch"), "unaccounted", "pending", "passed")
        out = one if out is None else out.union(one)
    return out


@query("review_latest", f"WITH {_PLAN} SELECT item, code, decision FROM disp WHERE disposition LIKE 'refused%'")
def review_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.dispositions(*_closure(spark, sf_dir)).where("disposition like 'refused%'").select("item", "code", "decision")


@query(
    "attest_buckets",
    f"""WITH {_PLAN}, a AS (SELECT o_orderkey * CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE 1 END AS item, o_orderkey % 3 <> 0 AS valid, 'done' AS claims FROM orders WHERE o_orderkey % 5 < 4)
    SELECT CASE WHEN disposition IS NULL THEN 'foreign' WHEN NOT valid THEN 'rejected' WHEN disposition = 'unaccounted' THEN 'accepted' WHEN disposition = claims THEN 'superseded' ELSE 'disagreement' END AS bucket, count(*) AS n
    FROM a LEFT JOIN disp USING (item) GROUP BY 1""",
)
def attest_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderkey % 5 < 4").select(F.expr("o_orderkey * if(o_orderkey % 19 = 0, -1, 1)").alias("item"), F.expr("o_orderkey % 3 <> 0").alias("valid"), F.lit("done").alias("claims"))
    return closure.attested(closure.dispositions(*_closure(spark, sf_dir)), a)


@query("outcomes_unplanned", f"WITH {_PLAN} SELECT item, state FROM outc WHERE item NOT IN (SELECT item FROM plan)")
def outcomes_unplanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, outcomes, *_ = _closure(spark, sf_dir)
    return closure.unmatched(plan, outcomes).select("item", "state")


_WORDS = ["workspace-restored", "refs-imported", "refused", "carried-as-files", "workspace-beside", "index-repaired", "captured", "previous-ref-custody-not-workspace-parity", "refused", "made-up"]
_JOURNAL = ["workspace-restored", "refs-imported", "workspace-beside", "absent", "no-capture", "unreadable"]
_REFUSED = ["C1", "IO", "C2", "FRAME_CODEC", "OLD", "TRANSPORT_LOST", "C3"]


def _nth(key: str, values: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_nth(key: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({key}) % {len(values)} AS INT) + 1]"


_ENTRIES = f"""e AS (SELECT o_orderkey AS item, 's' || o_custkey AS source, o_orderkey % 3 > 0 AS ws, CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'outcome-record-unreadable' ELSE 'ok' END AS record,
  CASE WHEN o_orderkey % 23 = 0 THEN 'elsewhere' ELSE 's' || o_custkey END AS rs, {_sql_nth('o_orderkey // 2', _WORDS)} AS outcome, {_sql_nth('o_orderkey // 3', _REFUSED)} AS refusal, {_sql_nth('o_orderkey // 5', _JOURNAL)} AS journal,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'beside-refs-pending' ELSE 'ok' END AS beside, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'carried-digest-mismatch' ELSE 'ok' END AS carried,
  CASE WHEN o_orderkey % 13 = 0 THEN 'elsewhere' ELSE 's' || o_custkey END AS cs, CASE WHEN o_orderkey % 17 < 8 THEN o_custkey END AS via FROM orders),
  j AS (SELECT *, CASE WHEN outcome LIKE '%beside' THEN 'workspace-beside' WHEN outcome = 'workspace-restored' THEN 'workspace-restored' ELSE 'refs-imported' END AS body FROM e),
  k AS (SELECT *, CASE WHEN journal = body THEN NULL WHEN journal = 'absent' THEN 'journal-missing' WHEN journal = 'no-capture' THEN 'capture-record-missing' WHEN journal = 'unreadable' THEN 'capture-record-unreadable' ELSE 'journal-outcome-mismatch' END AS jr FROM j),
  r AS (SELECT *, CASE WHEN record IS NULL THEN 'no-outcome-record' WHEN record <> 'ok' THEN record WHEN rs <> source THEN 'record-source-mismatch'
    WHEN outcome = 'refused' THEN CASE refusal WHEN 'IO' THEN 'refusal-untyped-io' WHEN 'FRAME_CODEC' THEN 'refusal-untyped-frame-codec' WHEN 'TRANSPORT_LOST' THEN 'transport-lost' WHEN 'OLD' THEN 'refusal-code-retired' END
    WHEN outcome = 'workspace-beside' THEN CASE WHEN NOT ws THEN 'outcome-workspace-mismatch' WHEN beside IS NULL THEN 'beside-record-missing' WHEN beside <> 'ok' THEN beside ELSE jr END
    WHEN outcome = 'workspace-restored' THEN CASE WHEN ws THEN jr ELSE 'outcome-workspace-mismatch' END
    WHEN outcome = 'index-repaired' THEN CASE WHEN ws THEN 'index-repaired-for-workspace-item' ELSE jr END
    WHEN outcome IN ('refs-imported', 'previous-ref-custody-not-workspace-parity') THEN CASE WHEN ws THEN 'refs-only-for-workspace-item' ELSE jr END
    WHEN outcome = 'captured' THEN 'not-an-apply-outcome'
    WHEN outcome = 'carried-as-files' THEN CASE WHEN carried IS NULL THEN 'carried-record-missing' WHEN carried <> 'ok' THEN carried WHEN cs <> source THEN 'carried-source-mismatch' WHEN (via IS NOT NULL) = ws THEN 'carried-shape-mismatch' END
    ELSE 'outcome-unknown' END AS reason FROM k),
  c AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unaccounted' WHEN outcome = 'refused' THEN 'refused-pending-review' WHEN outcome = 'workspace-beside' THEN 'applied-beside' WHEN outcome = 'workspace-restored' THEN 'applied' WHEN outcome = 'carried-as-files' THEN 'carried' ELSE 'referenced-only' END AS disposition FROM r)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey", *[F.expr(f"o_orderkey div {n}").alias(f"k{n}") for n in (2, 3, 5)])
    return o.select(
        "item", F.expr("concat('s', o_custkey)").alias("source"), F.expr("item % 3 > 0").alias("has_workspace"), F.expr("case when item % 29 = 0 then null when item % 31 = 0 then 'outcome-record-unreadable' else 'ok' end").alias("record"),
        F.expr("if(item % 23 = 0, 'elsewhere', concat('s', o_custkey))").alias("record_source"), _nth("k2", _WORDS).alias("outcome"), _nth("k3", _REFUSED).alias("refusal"), _nth("k5", _JOURNAL).alias("journal"),
        F.expr("case item % 7 when 0 then null when 1 then 'beside-refs-pending' else 'ok' end").alias("beside"), F.expr("case item % 11 when 0 then null when 1 then 'carried-digest-mismatch' else 'ok' end").alias("carried"),
        F.expr("if(item % 13 = 0, 'elsewhere', concat('s', o_custkey))").alias("carried_source"), F.expr("if(item % 17 < 8, o_custkey, null)").alias("carried_via"),
    )


@query("dispositions_native", f"WITH {_ENTRIES} SELECT item, disposition, reason, CASE WHEN disposition LIKE 'refused%' THEN refusal END AS code FROM c")
def dispositions_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.classified(_entries(spark, sf_dir), _codes(spark)).select("item", "disposition", "reason", "code")


@query(
    "attestation_reasons",
    f"""WITH {_ENTRIES}, a AS (SELECT CASE WHEN o_orderkey % 37 = 0 THEN -o_orderkey ELSE o_orderkey END AS item, CASE WHEN o_orderkey % 19 = 0 THEN 'elsewhere' ELSE 's' || o_custkey END AS a_source,
      CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE 'digest' END AS named, 'd' || CASE WHEN o_orderkey % 21 = 2 THEN 0 ELSE o_orderkey END AS a_capture, {_sql_nth('o_orderkey // 4', ['applied', 'refused', 'referenced-only', 'gone', 'refused', 'present'])} AS claim,
      {_sql_nth('o_orderkey // 6', ['audit', 'audit', '', 'native-closure-report', 'audit'])} AS basis, {_sql_nth('o_orderkey // 7', ['C1', 'IO', 'OLD', 'C4'])} AS a_refusal, CASE WHEN o_orderkey % 8 = 3 THEN '' ELSE 'log' END AS evidence FROM orders WHERE o_orderkey % 5 > 0),
    m AS (SELECT a.*, c.disposition, c.source, CASE WHEN c.item % 9 = 1 AND c.item % 2 = 0 THEN NULL ELSE 'd' || c.item END AS capture, c.item % 25 <> 7 AS readable, CASE WHEN record = 'ok' AND outcome = 'refused' THEN refusal END AS own FROM a LEFT JOIN c USING (item)),
    v AS (SELECT *, CASE WHEN own = 'OLD' THEN 'native-refusal-code-retired' WHEN own IN ('IO', 'FRAME_CODEC') THEN 'native-refusal-untyped' WHEN own = 'TRANSPORT_LOST' THEN 'native-transport-lost' WHEN a_source <> source THEN 'source-mismatch'
      WHEN named = 'missing' THEN 'capture-missing' WHEN NOT readable THEN 'capture-record-unreadable' WHEN named = 'null' AND capture IS NOT NULL THEN 'capture-mismatch' WHEN named = 'digest' AND capture IS DISTINCT FROM a_capture THEN 'capture-mismatch'
      WHEN claim = 'gone' THEN 'disposition-unknown' WHEN basis = '' THEN 'basis-missing' WHEN basis = 'native-closure-report' THEN 'basis-claims-native' WHEN evidence = '' THEN 'evidence-missing' WHEN claim = 'refused' AND a_refusal IN ('IO', 'OLD') THEN 'refusal-untyped' END AS why FROM m),
    b AS (SELECT item, why, CASE WHEN disposition IS NULL THEN 'foreign' WHEN disposition <> 'unaccounted' THEN CASE WHEN claim = disposition OR (claim = 'refused' AND disposition = 'refused-pending-review') THEN 'superseded' ELSE 'disagreement' END WHEN why IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS bucket FROM v)
    SELECT item, bucket, CASE WHEN bucket = 'rejected' THEN why END AS reason FROM b""",
)
def attestation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = closure.classified(_entries(spark, sf_dir), _codes(spark))
    rows = rows.select(
        "item", "source", "disposition", F.expr("if(item % 9 = 1 and item % 2 = 0, null, concat('d', item))").alias("capture"), F.expr("item % 25 <> 7").alias("capture_readable"), F.expr("if(record = 'ok' and outcome = 'refused', refusal, null)").alias("refusal"), F.lit(False).alias("refusal_untyped")
    )
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("k"), "o_custkey", *[F.expr(f"o_orderkey div {n}").alias(f"k{n}") for n in (4, 6, 7)])
    ledger = o.select(
        F.expr("if(k % 37 = 0, -k, k)").alias("item"), F.expr("if(k % 19 = 0, 'elsewhere', concat('s', o_custkey))").alias("source"), F.expr("case k % 9 when 0 then 'missing' when 1 then 'null' else 'digest' end").alias("capture_named"),
        F.expr("concat('d', if(k % 21 = 2, 0, k))").alias("capture"), _nth("k4", ["applied", "refused", "referenced-only", "gone", "refused", "present"]).alias("disposition"), _nth("k6", ["audit", "audit", "", "native-closure-report", "audit"]).alias("basis"),
        _nth("k7", ["C1", "IO", "OLD", "C4"]).alias("refusal"), F.expr("if(k % 8 = 3, '', 'log')").alias("evidence"),
    )
    return closure.attestations(rows, ledger, _codes(spark))
