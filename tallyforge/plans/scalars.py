"""Queries on classes of names and codes, tokens and small decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scalars
from .catalogue import query
from .tables import table


def _pick(key: str, values: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _case(key: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({key} % {len(values)} AS INT) + 1]"


_BELOW = ["objects/pack/a.pack", "objects/pack/a.idx", "objects/ab/cdef", "HEAD", "objects/info/packs", "refs/heads/main"]


@query(
    "git_classes",
    f"""WITH p AS (SELECT {_case('p_partkey', _BELOW)} AS b, p_size FROM part), c AS (SELECT p_size, CASE WHEN regexp_matches(b, '^objects/pack/.*\\.pack$') THEN 'git-pack' WHEN b LIKE 'objects/pack/%' THEN 'git-pack-index'
      WHEN regexp_matches(b, '^objects/[^/][^/]/[^/]+$') THEN 'git-loose' ELSE 'git-admin' END AS class FROM p) SELECT class, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes FROM c GROUP BY 1""",
)
def git_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(scalars.git_class(_pick("p_partkey", _BELOW)).alias("class"), "p_size")
    return p.groupBy("class").agg(F.count("*").alias("files"), F.sum("p_size").cast("long").alias("bytes"))


_LOGS = ["projects/a.jsonl", "x/.claude/projects/b.jsonl", ".claude/projects/c.jsonl", "my-projects/d.jsonl", "x/projects/e.jsonl"]


@query("transcript_paths", f"SELECT p_partkey, CAST(p_partkey % 5 AS INT) < 3 AS by_uuid FROM part WHERE {_case('p_partkey', _LOGS)} IS NOT NULL")
def transcript_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.by_uuid(_pick("p_partkey", _LOGS)).alias("by_uuid"))


_CODES = ["TRANSPORT_LOST", "IO:5", "MOVE_STATE_BUSY", "SPACE_EXHAUSTED", "NO_CLOBBER", "ITEMS_REFUSED", "GIT_CONVERGE_INTERRUPTED"]


@query(
    "refusal_codes",
    f"""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN {_case('o_orderkey', _CODES)} END AS code, o_orderkey % 4 = 0 AS held FROM orders)
    SELECT o_orderkey, CASE code WHEN 'TRANSPORT_LOST' THEN 'transport-lost' WHEN 'MOVE_STATE_BUSY' THEN 'state-busy' WHEN 'ITEMS_REFUSED' THEN 'run-level-refusal' WHEN 'GIT_CONVERGE_INTERRUPTED' THEN 'converge-interrupted' END AS rerun,
      CASE WHEN held THEN 'held' WHEN code LIKE 'IO%' OR code = 'SPACE_EXHAUSTED' THEN 'transient' WHEN code IS NOT NULL THEN 'refused' ELSE 'pending' END AS state FROM c""",
)
def refusal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.expr("o_orderkey % 5 > 0"), _pick("o_orderkey", _CODES))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.rerun_only(code).alias("rerun"), scalars.capture_state(F.expr("o_orderkey % 4 = 0"), code).alias("state"))


@query("lane_verdicts", "SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderkey % 3 < 2 AND coalesce(o_orderkey % 7 > 0, false) AS done FROM orders")
def lane_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    git = _pick("o_orderkey", ["identical", "waived", "differs"])
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.lane_verdict(F.col("o_orderstatus") != "P", git, F.expr("o_orderkey % 7 > 0")).alias("done"))


@query(
    "number_tokens",
    """SELECT p_partkey, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN p_partkey WHEN 1 THEN -p_partkey WHEN 2 THEN p_partkey WHEN 3 THEN p_partkey * 1000 + 5 WHEN 4 THEN NULL WHEN 5 THEN NULL
        WHEN 6 THEN p_partkey * 18446744073709551616::HUGEINT + 18446744073709551615::HUGEINT ELSE p_partkey * 1099511627776::HUGEINT + 1099511627775 END::VARCHAR AS whole,
      CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN p_partkey WHEN 1 THEN -p_partkey WHEN 2 THEN p_partkey WHEN 3 THEN p_partkey * 1000 + 5 WHEN 4 THEN p_partkey + 0.5 ELSE NULL END::DOUBLE AS real FROM part""",
)
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = k.cast("string")
    token = F.when(k % 8 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 8 == 1, F.concat(F.lit("-"), d)).when(k % 8 == 2, F.concat(F.lit("0b"), F.bin(k))).when(k % 8 == 3, F.concat(d, F.lit("_005"))).when(k % 8 == 4, F.concat(d, F.lit(".5"))).when(k % 8 == 5, "1x")
    # tokens of many digits: 64 bits of ones behind k, and 40
    token = F.coalesce(token, F.when(k % 8 == 6, F.concat(F.lit("0x"), F.hex(k), F.lit("f" * 16))).otherwise(F.concat(F.lit("0b"), F.bin(k), F.lit("1" * 40))))
    long = k % 8 >= 6
    return table(spark, sf_dir, "part").select("p_partkey", scalars.integer_token(token).cast("string").alias("whole"), F.when(~long, scalars.float_token(token)).alias("real"))


@query(
    "date_tokens",
    """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) SELECT o_orderkey, d || 'T10:00:00Z' AS key, o_orderkey % 3 < 2 AS is_date FROM t""",
)
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    token = F.concat(d, F.when(F.expr("o_orderkey % 2 = 0"), "t").otherwise(" "), F.lit("10:00:00z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.datetime_key(token).alias("key"), scalars.is_date(F.when(F.expr("o_orderkey % 3 < 2"), d).otherwise("2024-02-30")).alias("is_date"))


@query(
    "names_with_uuid",
    """WITH u AS (SELECT doc_id, md5(source || doc_id::VARCHAR) AS h FROM documents), v AS (SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, sha256(h) AS s FROM u)
    SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN id END AS id, doc_id % 2 = 0 AS hex FROM v""",
)
def names_with_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.concat("source", F.col("doc_id").cast("string")))
    id_ = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    name = F.concat(F.lit("log-"), id_, _pick("doc_id", [".jsonl", ".jsonl.zst", ".jsonl.gz", ".json"]))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.uuid_in_name(name).alias("id"), scalars.is_hex64(F.when(F.expr("doc_id % 2 = 0"), F.sha2(h, 256)).otherwise(h)).alias("hex"))


@query(
    "paths_in_text",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'see /new/a/' || page_id || ' and (/old/ab) or /home/x.' WHEN page_id % 3 = 1 THEN 'at /home/x/' || page_id || ',/newb' ELSE 'no /xold/a here' END AS text FROM pages""",
)
def paths_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    text = F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("see /old/a/"), k, F.lit(" and (/old/ab) or /home/x."))).when(F.expr("page_id % 3 = 1"), F.concat(F.lit("at /old/home/"), k, F.lit(",/old/b"))).otherwise("no /xold/a here")
    return table(spark, sf_dir, "pages").select("page_id", scalars.rewritten(text, [("/old/a", "/new/a"), ("/old/b", "/newb"), ("/old/home", "/home/x")]).alias("text"))


@query(
    "file_merges",
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 3 END AS b, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 2 END AS o, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 4 END AS t FROM customer)
    SELECT k AS c_custkey, CASE WHEN t IS NULL THEN 'same' WHEN o IS NULL THEN 'land' WHEN o = t THEN 'same' WHEN b IS NULL THEN 'conflict' WHEN b = o THEN 'merge' WHEN b = t THEN 'same' ELSE 'conflict' END AS verdict FROM f""",
)
def file_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [F.when(F.expr(f"c_custkey % {a} > 0"), F.expr(f"c_custkey % {b}")) for a, b in ((5, 3), (7, 2), (11, 4))]
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.file_merge(*sides).alias("verdict"))


@query(
    "refusal_buckets",
    """SELECT CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'routed' WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN 'blocked' ELSE 'other' END AS bucket, count(*) AS n FROM orders GROUP BY 1""",
)
def refusal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _pick("o_orderkey", ["STORE_LIVE now", "NO_CLOBBER seat", "IO"])
    b = scalars.refusal_bucket(code, F.expr("o_orderkey % 2 = 0"), F.expr("o_orderkey % 5 = 0"), ("STORE_LIVE",), ("NO_CLOBBER",))
    return table(spark, sf_dir, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("extension_candidates", "SELECT doc_id, n_chars // 2 > 0 AND n_chars // 2 < n_chars AND doc_id % 9 > 0 AND doc_id % 4 > 0 AS candidate FROM documents")
def extension_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.when(F.expr("doc_id % 9 > 0"), 1).otherwise(2)
    return table(spark, sf_dir, "documents").select("doc_id", scalars.extension_candidate(F.expr("n_chars div 2"), F.col("n_chars"), links, F.expr("doc_id % 4 > 0")).alias("candidate"))
