"""Queries on inventories and content-addressed dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census, dedup
from .catalogue import query
from .tables import table

EDGES = [100, 500, 1000, 2000, 5000, 10000, 50000]
_PATHS = """
  files AS (SELECT source || '/' || CAST(doc_id % 13 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) ||
    CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '.sqlite' WHEN 1 THEN '.txt' WHEN 2 THEN '.jsonl' WHEN 3 THEN '.json' WHEN 4 THEN '.toml' ELSE '.txt' END AS path,
    n_chars AS size FROM documents
    UNION ALL SELECT source || '/' || CAST(doc_id % 13 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) || '.sqlite-wal', n_chars // 2 FROM documents WHERE doc_id % 6 < 2)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with paths made from documents."""
    ends = F.element_at(F.array(*map(F.lit, [".sqlite", ".txt", ".jsonl", ".json", ".toml", ".txt"])), (F.col("doc_id") % 6 + 1).cast("int"))
    stem = F.concat("source", F.lit("/"), (F.col("doc_id") % 13).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    side = docs.where("doc_id % 6 < 2").select(F.concat(stem, F.lit(".sqlite-wal")).alias("path"), F.expr("n_chars div 2").alias("size"))
    return docs.select(F.concat(stem, ends).alias("path"), F.col("n_chars").alias("size")).union(side)


@query(
    "census_class_totals",
    f"""WITH {_PATHS} SELECT CASE WHEN regexp_replace(path, '-(wal|shm|journal)$', '') LIKE '%.sqlite' THEN 'sqlite' WHEN path LIKE '%.jsonl' THEN 'append-log'
      WHEN path LIKE '%.json' OR path LIKE '%.toml' THEN 'config' ELSE 'opaque' END AS class, split_part(path, '/', 1) AS top,
      count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1, 2""",
)
def census_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumns({"class": census.path_class(F.col("path")), "top": F.split("path", "/")[0]})
    return census.totals(rows, ["class", "top"], "size")


@query(
    "census_size_histogram",
    "SELECT CASE " + " ".join(f"WHEN n_chars <= {e} THEN {e}" for e in EDGES) + " END::BIGINT AS edge, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1",
)
def census_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.histogram(table(spark, sf_dir, "documents"), "n_chars", EDGES)


@query(
    "census_distribution",
    """WITH o AS (SELECT l_orderkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM o)
    SELECT q, v AS value FROM s JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) t(q) ON i = CAST(floor(q * (n - 1) + 0.5) AS BIGINT)""",
)
def census_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("v"))
    return census.ranked_values(per, "v", [0.1, 0.5, 0.9, 0.99, 1.0])


_REPOS = """f AS (SELECT doc_id % 3 AS kind, doc_id % 89 AS repo, n_chars AS size, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'objects/pack/p.pack' WHEN 1 THEN 'objects/pack/p.idx' WHEN 2 THEN 'objects/ab/' || doc_id WHEN 3 THEN 'worktrees/w' || doc_id % 5 || '/HEAD' END AS below FROM documents WHERE doc_id % 89 <> 5),
  r AS (SELECT DISTINCT doc_id % 89 AS repo FROM documents),
  m AS (SELECT repo, count(size) AS files, coalesce(sum(size), 0) AS bytes, count(below) AS git_files, coalesce(sum(size) FILTER (below IS NOT NULL), 0) AS git_bytes, count(*) FILTER (below LIKE 'objects/ab/%') AS loose, coalesce(sum(size) FILTER (below LIKE 'objects/ab/%'), 0) AS loose_bytes,
    count(*) FILTER (below LIKE '%.pack') AS packs, coalesce(sum(size) FILTER (below LIKE '%.pack'), 0) AS pack_bytes, count(*) FILTER (below IS NULL AND size IS NOT NULL) AS checkout_files, coalesce(sum(size) FILTER (below IS NULL), 0) AS checkout_bytes,
    count(DISTINCT CASE WHEN below LIKE 'worktrees/%' THEN below END) AS worktree_admins FROM r LEFT JOIN f USING (repo) GROUP BY 1)"""
_METRICS = ["files", "bytes", "git_files", "git_bytes", "loose", "loose_bytes", "packs", "pack_bytes", "checkout_files", "checkout_bytes", "worktree_admins"]
_EACH = " UNION ALL ".join(f"SELECT repo % 2 AS side, '{m}' AS metric, CAST({m} AS BIGINT) AS v FROM m" for m in _METRICS)


@query(
    "repo_distribution",
    f"""WITH {_REPOS}, e AS ({_EACH}), s AS (SELECT side, metric, v, row_number() OVER (PARTITION BY side, metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY side, metric) AS n FROM e)
    SELECT side, metric, CAST(sum(v) AS BIGINT) AS sum, max(v) FILTER (i = floor(0.1::DOUBLE * (n - 1) + 0.5)) AS p10, max(v) FILTER (i = floor(0.5::DOUBLE * (n - 1) + 0.5)) AS p50, max(v) FILTER (i = floor(0.9::DOUBLE * (n - 1) + 0.5)) AS p90,
      max(v) FILTER (i = floor(0.99::DOUBLE * (n - 1) + 0.5)) AS p99, max(v) AS max FROM s GROUP BY 1, 2""",
)
def repo_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 89).alias("repo"), F.col("n_chars").alias("size"), "doc_id")
    below = F.expr("case doc_id % 7 when 0 then 'objects/pack/p.pack' when 1 then 'objects/pack/p.idx' when 2 then concat('objects/ab/', doc_id) when 3 then concat('worktrees/w', doc_id % 5, '/HEAD') end")
    metrics = census.repo_metrics(d.select("repo"), d.where("repo <> 5").select("repo", below.alias("below"), "size"))
    return census.distribution(metrics.withColumn("side", F.col("repo") % 2), ["side"], _METRICS)


@query(
    "sidecar_pairing",
    f"""WITH {_PATHS}, s AS (SELECT path, regexp_replace(path, '-(wal|shm|journal)$', '') AS base FROM files WHERE path LIKE '%-wal')
    SELECT s.path, f.path AS base FROM s LEFT JOIN files f ON f.path = s.base""",
)
def sidecar_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.sidecars(files(spark, sf_dir))


@query("directory_fan_out", f"WITH {_PATHS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS children FROM files GROUP BY 1")
def directory_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.fan_out(files(spark, sf_dir))


_SEG = """seg AS (SELECT doc_id, pos, md5(line) AS digest, length(line) AS size FROM
  (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query(
    "need_chunks",
    f"""WITH {_SEG}, held AS (SELECT DISTINCT digest, size FROM seg WHERE doc_id % 2 = 0),
    w AS (SELECT digest, size, doc_id, pos, row_number() OVER (PARTITION BY digest, size ORDER BY doc_id, pos) AS rn FROM seg WHERE doc_id % 2 = 1)
    SELECT digest, size, doc_id AS first_key, pos AS first_pos FROM w ANTI JOIN held USING (digest, size) WHERE rn = 1""",
)
def need_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = dedup.segments(table(spark, sf_dir, "documents"))
    return dedup.needed(seg.where("doc_id % 2 = 1"), seg.where("doc_id % 2 = 0"))


@query(
    "dedup_ratio",
    f"""WITH {_SEG} SELECT count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(*) FROM (SELECT DISTINCT digest, size FROM seg)) AS distinct_chunks,
    (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT digest, size FROM seg)) AS distinct_bytes FROM seg""",
)
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ratio(dedup.segments(table(spark, sf_dir, "documents")))


@query(
    "hint_topk",
    f"WITH {_SEG} SELECT digest, doc_id, pos, size, row_number() OVER (PARTITION BY digest ORDER BY doc_id DESC, pos) AS rank FROM seg QUALIFY rank <= 4",
)
def hint_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.newest(dedup.segments(table(spark, sf_dir, "documents")), ["digest"], [F.desc("doc_id"), "pos"], 4)


@query("chunk_offsets", f"WITH {_SEG} SELECT doc_id, pos, digest, size, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY pos) - size AS BIGINT) AS \"offset\" FROM seg")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.offsets(dedup.segments(table(spark, sf_dir, "documents")))


@query("cdc_chunks")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cdc(table(spark, sf_dir, "documents"))


@query("depth_refusals", "WITH f AS (SELECT doc_id, repeat('d/', CAST(doc_id % 300 AS INT)) || repeat('x', CAST(doc_id % 7 * 700 AS INT)) AS path FROM documents) SELECT doc_id, CASE WHEN doc_id % 300 + 1 > 256 THEN 'too-deep' WHEN strlen(path) > 4095 THEN 'too-long' END AS refusal FROM f")
def depth_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(repeat('d/', cast(doc_id % 300 as int)), repeat('x', cast(doc_id % 7 * 700 as int))) as path")
    return census.depth_refusals(f).select("doc_id", "refusal")
