import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_bpe import library
from test_jaccard import brute

from tallyforge.llm import mixing, scratch

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.saved(stage(spark, kept[-1], SF), "stage")
        assert name == "tokens" or out.columns == columns
        kept.append(out)
    source, tox, exact, near, mixed, tokens = [k.collect() for k in kept]
    ids = [{r.doc_id for r in k} for k in (source, tox, exact, near)]
    assert ids[3] <= ids[2] <= ids[1] <= ids[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in ids[0] if labels.get(i) == 0]
    assert sum(i in ids[1] for i in clean) >= 0.9 * len(clean)
    first = {}
    for r in sorted(tox, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids[2] == set(first.values())
    rows = sorted(exact, key=lambda r: r.doc_id)
    heads = {rows[i].doc_id for i, _, c in brute([r.text for r in rows], 5, 80, 100) if i == c}
    assert ids[3] == heads
    plan = {r.doc_id: r for r in mixing.mix_plan(kept[3])[0].collect()}
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {i: r.taken for i, r in plan.items() if r.taken}
    enc = library()
    assert sorted((r.doc_id, bytes(r.ids)) for r in tokens) == sorted((r.doc_id, b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(r.text))) for r in mixed)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, ties, a very long text, clashing columns and an empty table through every stage."""
    rng = random.Random(3)
    prose_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    texts = [None, None, "", " ", prose_, prose_, prose_.replace(" ", "  "), prose_ + " tail", "one", "x" * 300_000, " ".join(f"v{i}" for i in range(60_000)), "ü é " * 200]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    more = {c: F.lit("z") for c in ("score", "key", "kept", "row", "id", "token", "rank", "digest", "part", "size", "taken", "toxic")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(more)
    spark.createDataFrame([(i, 0, 0) for i in (4, 8, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    want = {"toxicity": set(range(12)), "exact dedup": {0, 3, 4, 7, 8, 9, 10, 11}, "near dedup": {0, 3, 4, 8, 9, 10, 11}}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.saved(stage(spark, kept, str(tmp_path)), "stage")
        assert name == "tokens" or out.columns == docs.columns
        if name in want:
            assert {r.doc_id for r in out.collect()} == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        kept = out
    texts_of = {r.doc_id for r in kept.collect()}
    assert texts_of <= want["near dedup"] and {4, 10} <= texts_of
