import random

from tallyforge.llm import components as c


def test_hubs_chains_and_ties(spark, monkeypatch):
    monkeypatch.setattr(c, "LOT", 8)
    rng = random.Random(3)
    edges = [(5000, i) for i in range(100, 700)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3), (3, None), (1060, 5000), (2, 1), (1, 2), (1, 2)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []
