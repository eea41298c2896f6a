import pytest
from pyspark.sql import functions as F

from tallyforge.llm.exact import arrivals, bucket_of, dedup, halves, salted, screened, shares, snapshot, snapshot_filters


@pytest.mark.parametrize("n_old", [0, 1, 50, 4000])
def test_groups_of_the_batch_are_bounded(spark, n_old):
    n_new, keys = 4000, 100
    n_buckets, n_salts = shares(n_old, n_new, keys)
    all_ = spark.range(n_old + n_new).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    old, new = all_.where(F.col("id") < n_old).select("digest"), all_.where(F.col("id") >= n_old).select("digest")
    assert salted(new, n_buckets, n_salts).groupBy("bucket", "salt").count().agg(F.max("count")).first()[0] <= 2 * keys
    assert n_old == 0 or all_.limit(n_old).groupBy(bucket_of(n_buckets)).count().agg(F.max("count")).first()[0] <= 2 * keys
    # all that the snapshot holds pass, in whichever group they ask, and few others
    passed = screened(new.union(old), snapshot_filters(old, n_buckets), n_buckets, n_salts)
    assert passed.join(old, "digest", "left_semi").count() == n_old and passed.count() <= n_old + (0.03 * n_new if n_old else 0)


def test_small_snapshot_and_large_batch(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 1000).cast("string").alias("text"))
    for old in (F.lit(False), F.col("doc_id") < 3):
        got = dedup(docs, old, keys_a_bucket=100)
        assert got.where("keep_id = doc_id % 1000 and group_size = 3 and kept = (doc_id < 1000)").count() == 3000


def test_one_snapshot_serves_two_batches(spark):
    made = lambda ids: spark.createDataFrame([(i, t) for i, t in ids], "doc_id long, text string")
    snap = snapshot(made((i, f"text {i}") for i in range(500)), keys_a_bucket=50)
    files = set(snap.filters.inputFiles())
    first = {(r.doc_id, r.known, r.first, r.kept) for r in arrivals(made([(900, "text  7"), (901, "new"), (902, "new"), (903, None)]), snap, 50).collect()}
    assert first == {(900, True, 900, False), (901, False, 901, True), (902, False, 901, False), (903, False, 903, True)}
    second = arrivals(made([(None, "text 499"), (5, "other"), (5, "other"), (None, "")]), snap, 50).collect()
    assert sorted((r.doc_id or 0, r.known, r.first or 0, bool(r.kept)) for r in second) == [(0, False, 0, True), (0, True, 0, False), (5, False, 5, False), (5, False, 5, True)]
    assert set(snap.filters.inputFiles()) == files


def test_halves_are_of_rows(spark):
    docs = spark.range(1000).select(F.when(F.col("id") == 999, F.lit(10**15)).otherwise(F.col("id")).alias("doc_id"))
    assert 400 < docs.where(halves(docs)).count() < 600
