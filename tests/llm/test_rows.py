"""Null ids, repeated ids and repeated rows, in every operator that joins on ids and in every stage."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from helpers import SCHEMA
from pyspark.sql import functions as F

from tallyforge.llm import exact, lattice, lines, mixing, personal
from tallyforge.llm.rows import keyed, restored

FAR = 10**12
A, B, C, D = ("\n".join(f"{x}{i} mail {x}{i}@example.org now" for i in range(4)) for x in "abcd")
ROWS = [(FAR, A), (FAR, A), (None, A), (None, B), (None, B), (FAR + 1, B), (FAR + 1, C), (None, D), (None, None), (FAR + 2, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"src{len(t or '') % 2}", len(t or "")) for i, t in ROWS], SCHEMA).repartition(3)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_keys_follow_the_rows(spark, docs):
    key, ids = keyed(docs)
    got = sorted((r.doc_id, r.text) for r in key.collect())
    assert [i for i, _ in got] == list(range(len(ROWS)))
    assert got == sorted((r.doc_id, r.text) for r in keyed(docs.repartition(7))[0].collect())
    assert bag(restored(key, ids), "doc_id", "text") == Counter(ROWS)
    assert [r.id is None for r in ids.orderBy("row").collect()] == [False] * 5 + [True] * 5
    fine = docs.where("text = '' or text like 'c%'")
    assert keyed(fine) == (fine, None)


def test_line_dedup(docs):
    assert bag(lines.line_dedup(docs), "doc_id", "n_lines", "n_removed") == Counter(
        [(FAR, 4, 0), (FAR, 4, 4), (None, 4, 4), (FAR + 1, 4, 0), (None, 4, 4), (None, 4, 4), (FAR + 1, 4, 0), (None, 4, 0), (None, 0, 0), (FAR + 2, 1, 0)]
    )


@pytest.mark.parametrize("old", ["doc_id <= 1000000000000", "doc_id is null", "false"])
def test_exact_dedup_as_its_sql(docs, old):
    got = bag(exact.dedup(docs, F.expr(old)), "doc_id", "keep_id", "group_size", "kept")
    want = [(FAR, FAR, 3, True)] * 2 + [(None, FAR, 3, None), (None, FAR + 1, 3, None), (None, FAR + 1, 3, None), (FAR + 1, FAR + 1, 3, True), (FAR + 1, FAR + 1, 1, True)]
    assert got == Counter([*want, (None, None, 1, None), (None, FAR + 2, 2, None), (FAR + 2, FAR + 2, 2, True)])


def test_personal_data(docs):
    got = personal.personal_data(docs).select("doc_id", F.size("spans").alias("n"))
    assert bag(got, "doc_id", "n") == Counter((i, 4 if t else 0) for i, t in ROWS)


def test_mix_plan(docs):
    rows, _ = mixing.mix_plan(docs)
    assert bag(rows, "doc_id", "size") == Counter((i, len((t or "").split())) for i, t in ROWS)
    assert sum(r.taken for r in rows.collect()) > 0


def test_lattice_scores(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    cut = lambda d: [(ROWS[r.doc_id][0] if d is plain else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lattice.score(d, F.lit(True), path, frequent=2).collect()]
    assert Counter(cut(docs)) == Counter(cut(plain))


def test_stages_keep_rows_apart(spark, docs):
    sf = "/root/testdata/sf0.001"
    stage = dict(corpus_pipeline.STAGES)
    assert bag(stage["toxicity"](spark, docs, sf), "doc_id", "text") == Counter(ROWS)
    first = Counter([(FAR, A), (FAR + 1, B), (FAR + 1, C), (None, D), (FAR + 2, "")])
    assert bag(stage["exact dedup"](spark, docs, sf), "doc_id", "text") == first
    # texts without words are components of their own
    assert bag(stage["near dedup"](spark, docs, sf), "doc_id", "text") == first + Counter([(None, None)])
    mixed = stage["mixing"](spark, docs, sf).collect()
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(re.findall(r"\S+", r.text))
    rows = Counter()
    for r in mixing.mix_plan(docs)[0].collect():
        rows[r.doc_id] += r.taken
    assert +taken == +rows and {i for i, t in ROWS if (t or "").split() and rows[i]} == set(taken)
    assert len(stage["tokens"](spark, docs, sf).collect()) == len(ROWS)


def test_labels_reach_rows_of_their_id(spark, docs, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline.toxic, "score", lambda d, labels, may: (seen.append(labels.join(d, "doc_id")), d.select("doc_id", F.lit(0.0).alias("score")))[1])
    ids = [i for i in range(FAR, FAR + 3)]
    spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()
    may = {r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").where(corpus_pipeline.registry.remainder(4) != 2).collect()}
    assert bag(seen[0], "text", "toxic") == Counter((t, i % 2) for i, t in ROWS if i in may)
