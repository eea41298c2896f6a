"""Queries on reuse: the ladder of decisions, digests and scans behind ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reuse
from ..streaming.incremental import work_folder
from .catalogue import query
from .tables import table

_SEATS = """s AS (SELECT o_orderkey AS k, 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 19 = 0 THEN 'directory' ELSE 'regular' END AS kind, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 2 + o_custkey % 2 END AS ino FROM orders),
  outp AS (SELECT CASE WHEN k % 3 = 0 THEN k WHEN k % 3 = 1 THEN -k ELSE k + 1000000000 END AS key, path, CASE WHEN k % 10 = 3 THEN -1 ELSE ino END AS ino FROM s WHERE k % 5 > 1 AND ino IS NOT NULL),
  no AS (SELECT k AS key, CASE WHEN k % 14 = 0 THEN -2 ELSE ino END AS ino, ['exchange-unsupported', 'occupied', 'not-prefix'][CAST(k % 3 AS INT) + 1] AS reason FROM s WHERE k % 7 = 0 AND ino IS NOT NULL)"""


def _seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    ino = F.expr("if(key % 4 > 0, key * 2 + o_custkey % 2, null)")
    fixed = {c: F.when(ino.isNotNull(), F.lit(n).cast("long")).alias(c) for c, n in (("dev", 1), ("size", 10), ("mtime_ns", 5), ("ctime_ns", 6))}
    return o.select(
        "key", F.expr("concat('p', key)").alias("path"), F.expr("if(key % 19 = 0, 'directory', 'regular')").alias("kind"), fixed["dev"], ino.alias("ino"), fixed["size"], fixed["mtime_ns"], fixed["ctime_ns"],
        F.expr("key % 6 = 0").alias("may_extend"), F.expr("key % 11 = 0").alias("captured"), F.expr("key % 13 = 0").alias("in_ledger"), F.expr("key % 16 = 4").alias("sidecars"),
    )


@query(
    "reuse_ladder",
    f"""WITH {_SEATS}, x AS (SELECT s.*, EXISTS (SELECT 1 FROM outp o WHERE o.key = s.k AND o.ino = s.ino) AS own, EXISTS (SELECT 1 FROM outp o WHERE o.key = -s.k AND o.ino = s.ino) AS alias,
      EXISTS (SELECT 1 FROM outp o WHERE o.path = s.path AND o.ino = s.ino) AS owned, EXISTS (SELECT 1 FROM outp o WHERE o.key = s.k) AS known, (SELECT reason FROM no WHERE no.key = s.k AND no.ino = s.ino) AS reason FROM s),
    y AS (SELECT *, reason IS NOT NULL AND NOT (reason IN ('occupied', 'not-prefix') AND owned) AND NOT (reason = 'occupied' AND k % 6 = 0) AS stands FROM x),
    z AS (SELECT *, CASE WHEN kind <> 'regular' THEN 'skip:' || kind WHEN ino IS NOT NULL AND own THEN 'reuse:output' WHEN ino IS NOT NULL AND alias THEN 'reuse:alias' WHEN ino IS NOT NULL AND stands THEN 'refuse:' || reason WHEN ino IS NOT NULL AND k % 11 = 0 THEN 'reuse:captured'
      WHEN ino IS NULL AND k % 16 = 4 THEN 'refuse:sidecars' WHEN ino IS NOT NULL THEN 'want-manifest:occupied' WHEN known OR k % 13 = 0 THEN 'want-manifest:known' ELSE 'send:new' END AS d FROM y)
    SELECT k AS key, split_part(d, ':', 1) AS decision, split_part(d, ':', 2) AS why FROM z""",
)
def reuse_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seats(spark, sf_dir)
    there = s.where("ino is not null")
    outputs = there.where("key % 5 > 1").withColumns({"ino": F.expr("if(key % 10 = 3, -1L, ino)"), "key": F.expr("case key % 3 when 0 then key when 1 then -key else key + 1000000000 end")}).select("key", "path", *reuse.IDENTITY)
    refused = there.where("key % 7 = 0").select("key", *[F.expr("if(key % 14 = 0, -2L, ino)").alias(c) if c == "ino" else F.col(c) for c in reuse.IDENTITY], F.element_at(F.array(*map(F.lit, ["exchange-unsupported", "occupied", "not-prefix"])), (F.col("key") % 3 + 1).cast("int")).alias("reason"))
    aliases = s.select("key", (-F.col("key")).alias("earlier"))
    return reuse.decide(s, outputs, aliases, refused).select("key", "decision", "why")


_TREE = "t AS (SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'symlink' ELSE 'regular' END AS kind, doc_id AS ino, n_chars AS size, coalesce(text, '') AS text FROM documents), h AS (SELECT ino, size + CASE WHEN path % 6 = 1 THEN 1 ELSE 0 END AS size, 'old' || path AS digest FROM t WHERE path % 4 > 0)"


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("path"), F.expr("if(doc_id % 9 = 0, 'symlink', 'regular')").alias("kind"), F.lit(1).cast("long").alias("dev"), F.col("doc_id").alias("ino"), F.col("n_chars").alias("size"), F.lit(5).cast("long").alias("mtime_ns"), F.lit(6).cast("long").alias("ctime_ns"))
    held = rows.where("path % 4 > 0").withColumn("size", F.expr("size + if(path % 6 = 1, 1, 0)")).select(*reuse.IDENTITY, F.expr("concat('old', path)").alias("digest"))
    return rows, held, d.select(F.col("doc_id").alias("path"), "text")


@query(
    "digest_reuse",
    f"""WITH {_TREE} SELECT path, CASE WHEN kind <> 'regular' THEN NULL WHEN h.digest IS NOT NULL THEN h.digest ELSE sha256(text) END AS digest, CASE WHEN kind <> 'regular' THEN NULL WHEN h.digest IS NOT NULL THEN 'held' ELSE 'read' END AS source FROM t LEFT JOIN h USING (ino, size)""",
)
def digest_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, held, texts = _tree(spark, sf_dir)

    def read(todo: DataFrame) -> DataFrame:
        return todo.join(texts, "path").select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))

    return reuse.hashed(rows, held, "stale-only", read).select("path", "digest", "source")


@query(
    "walk_stats",
    f"""WITH {_TREE}, x AS (SELECT t.*, h.digest IS NOT NULL AND kind = 'regular' AS fresh FROM t LEFT JOIN h USING (ino, size)), p AS (SELECT unnest(['never', 'stale-only', 'always']) AS policy),
    r AS (SELECT policy, x.*, kind = 'regular' AND (policy = 'always' OR (policy = 'stale-only' AND NOT fresh)) AS reads FROM x, p)
    SELECT policy, count(*) AS seats, CAST(sum(size) FILTER (kind = 'regular') AS BIGINT) AS bytes_seen, CAST(coalesce(sum(size) FILTER (reads), 0) AS BIGINT) AS bytes_read, count(*) FILTER (fresh) AS fresh_skipped, count(*) FILTER (fresh AND reads) AS reread FROM r GROUP BY 1""",
)
def walk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, held, _ = _tree(spark, sf_dir)
    out = None
    for policy in reuse.POLICIES:
        one = reuse.walk_stats(rows, held, policy).withColumn("policy", F.lit(policy))
        out = one if out is None else out.union(one)
    return out


@query(
    "cached_scan",
    """WITH e AS (SELECT user_id AS file, event_id, event_type FROM events) SELECT file, event_id, event_type, file % 8 > 0 AND file % 5 > 0 AS cached FROM e WHERE file % 7 > 0""",
)
def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", "event_type")
    files = events.select("file").distinct().select("file", *[F.lit(1).cast("long").alias(c) for c in reuse.IDENTITY])
    cache = reuse.ScanCache(spark, work_folder(spark))

    def read(todo: DataFrame) -> DataFrame:
        return events.join(todo.select("file"), "file")

    # every fifth file is too young to be remembered, then every eighth changes and every seventh goes
    cache.scan(files, read, F.col("file") % 5 == 0)
    return cache.scan(files.where("file % 7 > 0").withColumn("mtime_ns", F.expr("if(file % 8 = 0, 2L, 1L)")), read)
