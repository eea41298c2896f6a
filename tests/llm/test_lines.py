import random

from helpers import corpus, docs_of

from tallyforge.llm.exact import ask_filter, build_filter, dedup
from tallyforge.llm.lines import line_dedup


def brute(texts, size=3):
    seen, out = set(), []
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if w in seen:
                gone.update(range(p, p + size))
            seen.add(w)
        out.append((i, len(lines), len(gone), t if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abcd") * rng.randrange(3) for _ in range(rng.randrange(14))) for _ in range(200)]
    texts += [None, "", "\n", "\n\n\n\n", "x\nx\nx\nx\nx", "é\nü\n\U0001f600", "y" * 50_000 + "\nz\nw", "y" * 50_000 + "\nz\nw\nq"]
    assert sorted(tuple(r) for r in line_dedup(docs_of(spark, texts)).collect()) == brute(texts)
    assert line_dedup(docs_of(spark, texts).limit(0)).collect() == []


def test_exact_groups_equal_brute_force(spark):
    import re

    from pyspark.sql import functions as F

    texts = corpus(6) + ["a  b", "a\tb", "a b", " a b", None, "", " "]
    first, n = {}, {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        first.setdefault(t, i)
        n[t] = n.get(t, 0) + 1
    want = {(i, first[t], n[t], first[t] == i) for i, t in enumerate(norm)}
    for old in (F.col("doc_id") <= len(texts) // 2, F.col("doc_id") % 3 == 1, F.lit(False), F.lit(True)):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup(docs_of(spark, texts), old, keys_a_bucket=20).collect()}
        assert got == want
    assert dedup(docs_of(spark, texts).limit(0), F.lit(True)).collect() == []


def test_filters_hold_their_keys_and_few_others():
    import numpy as np

    g = np.random.default_rng(1)
    for n in (1, 2, 10, 1000, 30_000):
        keys = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        f = build_filter(keys)
        assert ask_filter(keys, *f).all()
        assert ask_filter(g.integers(0, 2**63, 20_000).astype(np.uint64), *f).mean() < 0.01
