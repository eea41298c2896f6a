"""The registered queries on a table with nulls, empty and long texts, ties, clashing columns, and on an empty one."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, corpus, edited, prose, words
from pyspark.sql import functions as F
from test_bpe import library
from test_personal import base

from tallyforge.llm import personal, registry, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("tables")
    texts = corpus(3)[:90]
    long = prose(rng, 400, 10**6)
    texts += [long, long, edited(rng, long, 20), "a\nb\nc\nd\n" * 3, "mail a@b.org or +1 (212) 555-1234", None, "", "x" * 40_000, "é " * 3000]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "token", "rep", "pos", "key", "size", "row", "score", "part")})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.expr("cast(doc_id % 2 as int)").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    g = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in g.normal(size=8)], i % 4 if i % 13 else None) for i in range(320)] + [(600, None, 1), (700, [1.0, None] * 4, 1), (800, [float("nan")] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x")).write.parquet(f"{path}/embeddings.parquet")
    items = [(i, t) for i, t in enumerate([texts[3], long[:300], None, "", "mail a@b.org"])]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).write.parquet(f"{path}/benchmark.parquet")
    pages = [(i, f"http://x/{i}", None if i == 3 else f"<nav><a>m</a></nav><article><h1>T{i}</h1><p>words of page {i}</p></article>") for i in range(9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).write.parquet(f"{path}/pages.parquet")
    return str(path), {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, folder[0])
    want = con.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted((tuple(r[c] for c in at) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.fetchall()), key=str)


def run(spark, folder, name):
    rows = registry.queries()[name](spark, folder[0]).collect()
    return {r[0]: r for r in rows}


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op3_digest(spark, folder):
    got = run(spark, folder, "op3_personal_data")
    for i, t in folder[1].items():
        found = base(t)
        told = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert got[i].base_sha256 == sha(told.encode()) and [got[i][f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == n for x in found) for n in range(4)]
        assert set(told.split(",")) - {""} <= set(got[i].spans.split(","))


def test_op5_folds_and_thresholds(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, **k: (toxicity.Network(5), 1.5, -0.25))
    got = run(spark, folder, "op5_toxicity")
    assert set(got) == set(folder[1])
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op6_shares(spark, folder):
    got = run(spark, folder, "op6_source_mixing")
    size = {i: len(words(t)) for i, t in folder[1].items()}
    assert {i: r["size"] for i, r in got.items()} == size and all(r.taken <= 3 * size[i] for i, r in got.items())
    assert {i: r.taken for i, r in run(spark, folder, "op6_source_mixing").items()} == {i: r.taken for i, r in got.items()}


def test_op8_base(spark, folder):
    got = run(spark, folder, "op8_lattice_score")
    low = {i: words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in folder[1].items()}
    train = [i for i in low if zlib.crc32(str(i).encode()) % 10]
    count = {}
    for i in train:
        for w in [*low[i], None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, r in got.items():
        tokens = [*low[i], None]
        want = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(tokens), sum(w in count for w in tokens), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0


def test_op9_round_trip(spark, folder):
    enc = library()
    for i, r in run(spark, folder, "op9_byte_bpe").items():
        ids = enc.encode_ordinary(folder[1][i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((folder[1][i] or "").encode()))


def test_op10_asks_every_fiftieth(spark, folder):
    rows = registry.queries()["op10_nearest_neighbours"](spark, folder[0]).collect()
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in range(0, 320, 50) for k in range(1, 6)]


def test_op12_reads_every_page(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in registry.queries()["op12_html_extraction"](spark, folder[0]).collect()}
    want = {i: f"T{i}\nwords of page {i}" if i != 3 else "" for i in range(9)}
    assert got == {i: (f"http://x/{i}", t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "benchmark", "pages"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []
