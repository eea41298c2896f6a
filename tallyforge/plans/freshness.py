"""Queries on change detection and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.freshness import snapshot_diff
from .catalogue import query
from .tables import table

_SNAPSHOTS = """
  after_ AS (SELECT doc_id, n_chars, md5(text) AS digest FROM documents),
  before_ AS (
    SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 1 THEN md5('x') ELSE digest END AS digest FROM after_ WHERE doc_id % 10 <> 0
    UNION ALL SELECT -doc_id - 1, n_chars, digest FROM after_ WHERE doc_id % 50 = 2)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots derived from documents: an earlier one with rows missing, altered and since vanished."""
    after = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("digest"))
    before = (
        after.where("doc_id % 10 <> 0")
        .withColumn("digest", F.when(F.expr("doc_id % 10 = 1"), F.md5(F.lit("x"))).otherwise(F.col("digest")))
        .unionByName(after.where("doc_id % 50 = 2").withColumn("doc_id", -F.col("doc_id") - 1))
    )
    return before, after


@query(
    "freshness_diff",
    f"""WITH {_SNAPSHOTS}
SELECT CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'vanished'
            WHEN a.n_chars IS NOT DISTINCT FROM b.n_chars AND a.digest IS NOT DISTINCT FROM b.digest THEN 'fresh' ELSE 'changed' END AS kind,
       count(*) AS n, CAST(sum(coalesce(b.n_chars, a.n_chars)) AS BIGINT) AS bytes
FROM before_ a FULL JOIN after_ b ON a.doc_id = b.doc_id GROUP BY 1""",
)
def freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = snapshots(spark, sf_dir)
    return snapshot_diff(before, after, ["doc_id"], ["n_chars", "digest"], "n_chars")
