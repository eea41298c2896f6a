"""Fields of JSON lines, merged documents and byte prefixes against plain versions on random data."""

import json
import os
import random

import pyarrow as pa
import pytest

from tallyforge.operators import documents, fields, merging, prefixes

MISSING = object()


def value(rng, depth, deepest=4):
    kind = rng.randrange(9)
    if depth < deepest and kind < 3:
        return {rng.choice(["a", "b", "c", 'd"e', "ü", "~f/g", ""]): value(rng, depth + 1, deepest) for _ in range(rng.randrange(4))}
    if depth < deepest and kind < 5:
        return [value(rng, depth + 1, deepest) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5, True, None, "x", "a:b,{}[]", 'q"\\', "\\", "é\n", "", 12345678901234567890])


def written(rng, v):
    space = lambda: rng.choice(["", "", " ", "\t"])
    if isinstance(v, dict):
        return space() + "{" + ",".join(space() + json.dumps(k, ensure_ascii=False) + space() + ":" + written(rng, x) for k, x in v.items()) + space() + "}" + space()
    if isinstance(v, list):
        return space() + "[" + ",".join(written(rng, x) for x in v) + space() + "]" + space()
    return space() + json.dumps(v, ensure_ascii=rng.random() < 0.5) + space()


def at_path(v, path):
    for k in path:
        v = v.get(k, MISSING) if isinstance(v, dict) else MISSING
    return v


def test_fields_equal_a_parser():
    rng = random.Random(5)
    values = [value(rng, 0) for _ in range(4000)]
    texts = [written(rng, v) for v in values]
    s, n = fields.Structure(pa.array(texts)), len(texts)
    for path in (["a"], ["a", "b"], ["b", "c", "a"], ["ü"], [""]):
        raw, text = fields.raw_values(s, n, path), fields.string_values(s, n, path)
        for i, v in enumerate(values):
            want = at_path(v, path)
            assert (raw[i] is None) == (want is MISSING) and (raw[i] is None or json.loads(raw[i]) == want and raw[i] == raw[i].strip())
            assert text[i] == (want if isinstance(want, str) else None)
    for v, got in zip(values, fields.elements(s, n)):
        assert (got is None) == (not isinstance(v, list)) and (got is None or [json.loads(e) for e in got] == v)


@pytest.mark.parametrize("text", ["", "{", '{"a', '{"a":', '"a"', "[1,2", '{"a":{"b":"x}', "}{][", '{"a":"\\u12"}', "\\" * 99, '"' * 99, None])
def test_broken_lines_do_not_fail_or_reach_others(spark, text):
    rows = spark.createDataFrame([(1, '{"a":{"b":"v"}}'), (2, text), (3, '{"a":{"x":1},"a":{"b":"w"}}')], "id int, line string")
    got = {r.id: (r.b, r.a) for r in fields.with_fields(rows, "line", {"b": ["a", "b"]}, {"a": ["a"]}).collect()}
    assert got[1] == ("v", '{"b":"v"}') and got[3] == ("w", '{"x":1}') and 2 in got
    assert fields.with_fields(rows.limit(0), "line", {"b": ["a"]}).collect() == []


def test_nested_merge_equals_the_plain_merge(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        a = value(rng, 0, 3)
        b = value(rng, 0, 3) if rng.random() < 0.4 else {**a, "b": value(rng, 1, 3), "n": value(rng, 1, 3)} if isinstance(a, dict) else a
        rows.append((i, json.dumps(a), json.dumps(b), rng.random() < 0.5))
    merged, conflicts = merging.merge(spark.createDataFrame(rows, "id long, live string, source string, source_later boolean"), "id")
    got, lost = {r.id: r for r in merged.collect()}, {}
    for r in conflicts.collect():
        lost.setdefault(r.id, []).append((r.pointer, r.kept_side, json.dumps(json.loads(r.other))))
    for i, a, b, later in rows:
        want, gone = documents.merge(json.loads(a), json.loads(b), later)
        assert json.dumps(json.loads(got[i].text)) == json.dumps(want)
        assert sorted(lost.get(i, [])) == sorted((p, "source" if side == "live" else "live", json.dumps(v)) for p, side, v in gone)
        assert got[i].covered == (json.dumps(json.loads(a)) == json.dumps(want)) and got[i].replaced == sum(side == "live" for _, side, _ in gone)


def test_merge_without_a_side_and_numbers_by_value(spark):
    rows = [(1, None, '{"a":1}', True), (2, '{"a": 1}', None, True), (3, "no", None, True), (4, None, None, False), (5, "[1, 2.0]", "[1.0, 2, 3e0, 3]", True), (6, '{"n":10000000000000000000001}', '{"n":10000000000000000000002}', False)]
    got = {r.id: r.text for r in merging.merge(spark.createDataFrame(rows, "id long, live string, source string, source_later boolean"), "id")[0].collect()}
    assert got == {1: '{"a":1}', 2: '{"a":1}', 3: "no", 4: None, 5: "[1,2.0,3e0]", 6: '{"n":10000000000000000000001}'}


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_prefixes_byte_by_byte(spark, chunk):
    rng = random.Random(chunk)
    pairs = []
    for i in range(150):
        a = bytes(rng.choice(b"ab\n\xff") for _ in range(rng.randrange(12)))
        b = a[: rng.randrange(len(a) + 1)] + bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(4))) if rng.random() < 0.8 else bytes(rng.choice(b"ab") for _ in range(5))
        pairs.append((i, a, b))
    a, b = (spark.createDataFrame([(p[0], bytearray(p[k])) for p in pairs], "key int, content binary") for k in (1, 2))
    got = {r.key: (r.bytes, r.line_bytes) for r in prefixes.common(a, b, chunk).collect()}
    extended = {r.key: (r.state, None if r.tail is None else bytes(r.tail)) for r in prefixes.extensions(a, b, chunk).collect()}
    for i, x, y in pairs:
        n = len(os.path.commonprefix([x, y]))
        assert got[i] == (n, x[:n].rfind(b"\n") + 1)
        assert extended[i] == (("same", None) if x == y else ("extend", x[len(y) :]) if x.startswith(y) else ("not-prefix", None))
    held = {r.key for r in prefixes.begins(b, a, chunk).collect()}
    assert held == {i for i, x, y in pairs if x.startswith(y)}
    assert prefixes.extensions(a.limit(1), b.limit(0), chunk).first().state == "absent"


def test_merge_shuffles_nothing_and_keeps_odd_rows(spark):
    deep = '{"a":' * 1500 + "[]" + "}" * 1500
    rows = [(7, '{"a":1}', '{"a":2}', None), (7, '{"a":{"b":[]}}', '{"a":{"b":[1,1]},"c":{"d":{}}}', True), (None, '{"x":"\\ud800"}', '{"x":"\\ud801","\\ud802":0}', False), (9, deep, '{"a":1}', False), (10, "[" + "7" * 5000 + "]", "[" + "7" * 5000 + ",8]", True)]
    merged, conflicts = merging.merge(spark.createDataFrame(rows, "id long, live string, source string, source_later boolean"), "id")
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (merged, conflicts))
    got = {(r.id, r.text): (r.keys_added, r.elements_added, r.replaced) for r in merged.collect()}
    assert got == {(7, '{"a":1}'): (0, 0, 0), (7, '{"a":{"b":[1]},"c":{"d":{}}}'): (1, 1, 0), (None, '{"x":"\\ud800","\\ud802":0}'): (1, 0, 0), (9, deep): (0, 0, 0), (10, "[" + "7" * 5000 + ",8]"): (0, 1, 0)}
    assert sorted((str(r.id), r.kept, r.other) for r in conflicts.collect()) == [("7", "1", "2"), ("9", deep[5:-1], "1"), ("None", '"\\ud800"', '"\\ud801"')]


def test_escapes_of_all_bytes_and_of_long_texts(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators import marks

    rng = random.Random(3)
    texts = [b"", b"plain", b"\\", b"\\x4", b"\\x41\\", bytes(range(256)), bytes(range(255, -1, -1)) * 3, "añb\U0001f600\n".encode(), rng.randbytes(300_000), b"\\" * 50_000, b"a\n" * 50_000]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, t binary").withColumn("e", marks.escaped(F.col("t")))
    for r in df.withColumn("u", marks.unescaped(F.col("e"))).collect():
        want = "".join(chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02x}" for b in texts[r.i])
        assert r.e == want and bytes(r.u) == texts[r.i]
    odd = {r"\x4g\xAf\\x41": b"\\x4g\xaf\\A", "é\\x00": "é\0".encode(), None: None}
    got = spark.createDataFrame([(t,) for t in odd], "t string").withColumn("u", marks.unescaped(F.col("t"))).collect()
    assert {r.t: r.u and bytes(r.u) for r in got} == odd
    # runs are taken apart, not single bytes
    assert "(..), 1)" not in df._jdf.queryExecution().analyzed().toString()


def test_samples_are_joined_once(spark):
    from tallyforge.operators import listings

    lines = ["s a=1 b=x ms=5 ms=6", "m b=x\ta=1 rss=7", "m a=1 b=x rss=unknown", "m a=1 b=x rss=12", "r a=1\nb=x rss=3 z=4", "s a=2 ms=1", "m a=2 rss=9", "s a=3 b=q ams=4", "s\ta=1 b=x ms=1", "x a=1 b=x rss=99", None]
    df = listings.joined_samples(spark.createDataFrame([(t,) for t in lines], "line string"), "line", "s", ["m", "r"], ["a", "b"], {"s": ["ms"], "m": ["rss"], "r": ["z"]})
    assert df.columns == ["a", "b", "ms", "rss", "z"]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [("1", "x", "6", "7", "4"), ("2", None, "1", None, None), ("3", "q", None, None, None)]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
