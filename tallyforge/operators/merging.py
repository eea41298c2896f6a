"""Merging JSON documents: the nodes of both sides lined up, a row's array of them for each document.

A helper reads both texts and walks them together, down to the first node that is not an object on both sides; columns settle what each node
becomes, count it and write the text again. What loses goes into a ledger. Nothing is shuffled or written between.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import pointer

NODE = "struct<depth:int,name:string,pointer:string,kind:string,live:string,source:string,more:array<string>>"
_TYPES = {"depth": pa.int32(), "name": pa.string(), "pointer": pa.string(), "kind": pa.string(), "live": pa.string(), "source": pa.string(), "more": pa.list_(pa.string())}

class ABSENT:
    """Stands for a side or member that is not there; a class, so that workers have the same one."""


class Number(str):
    """A number's token; a whole one has no point or exponent."""


class Whole(Number):
    pass


class _Piece(str):
    """Text between values."""


def _whole(s: str) -> str:
    """A text without halves of surrogate pairs, which UTF-8 cannot hold: they become escapes."""
    return s if s.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", s)


def _quoted(s: str) -> str:
    return _whole(encode_basestring(s))


def _spelled(v, scalar: Callable, members: Callable) -> str:
    """A value's text, of any depth."""
    if not isinstance(v, (dict, list)):
        return scalar(v)
    if not v:
        return "{}" if isinstance(v, dict) else "[]"
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            parts = [x for i, k in enumerate(members(v)) for x in (_Piece(("," if i else "") + _quoted(k) + ":"), v[k])]
            todo += [_Piece("}"), *reversed(parts), _Piece("{")]
        elif isinstance(v, list):
            parts = [x for i, y in enumerate(v) for x in ((_Piece(","), y) if i else (y,))]
            todo += [_Piece("]"), *reversed(parts), _Piece("[")]
        else:
            out.append(v if isinstance(v, _Piece) else scalar(v))
    return "".join(out)


def _scalar(v) -> str:
    return str.__str__(v) if isinstance(v, Number) else _quoted(v) if isinstance(v, str) else "null" if v is None else "true" if v else "false"


def _written(v) -> str:
    return _spelled(v, _scalar, list)


def _number(v) -> str:
    """Equal for equal values: whole numbers by value, others as doubles. A whole number that a double holds is that double."""
    if isinstance(v, Whole):
        # beyond any double, a token without leading zeros is the value
        n = int(v) if len(v) < 400 else None
        try:
            return f"i{v}" if n is None else repr(float(n)) if int(float(n)) == n else f"i{n}"
        except OverflowError:
            return f"i{n}"
    if isinstance(v, Number):
        f = float(v)
        return "nan" if math.isnan(f) else repr(f)
    return _scalar(v)


def _canonical(v) -> str:
    """Equal for equal values, whatever the order of members."""
    return _spelled(v, _number, sorted)


def load(text: str | None):
    """The value of a JSON text, else ABSENT: numbers keep their tokens, members their order; of repeated names the last counts, at the first's place."""
    if text is None:
        return ABSENT
    try:
        return json.loads(text, parse_int=Whole, parse_float=Number, parse_constant=Number)
    except (ValueError, RecursionError):
        return ABSENT


def _lined_up(live, source) -> Iterator[tuple]:
    """The fields of NODE for each node of both sides, in the order of the result; kind: object or array (on both sides), same, clash, live or source."""
    todo = [(0, None, "", live, source)]
    while todo:
        depth, name, at, l, s = todo.pop()
        head = (depth, None if name is None else _quoted(name), _whole(at))
        if l is ABSENT or s is ABSENT:
            yield *head, *(("source", None, _written(s)) if l is ABSENT else ("live", _written(l), None)), None
        elif isinstance(l, dict) and isinstance(s, dict):
            yield *head, "object", None, None, None
            members = [(k, x, s.get(k, ABSENT)) for k, x in l.items()] + [(k, ABSENT, x) for k, x in s.items() if k not in l]
            todo += [(depth + 1, k, at + pointer(k), x, y) for k, x, y in reversed(members)]
        elif isinstance(l, list) and isinstance(s, list):
            # of each value that the live array lacks, the first
            fresh = {_canonical(x): x for x in reversed(s)}
            held = {_canonical(x) for x in l}
            yield *head, "array", _written(l), None, [_written(x) for c, x in reversed(fresh.items()) if c not in held]
        elif _canonical(l) == _canonical(s):
            yield *head, "same", _written(l), None, None
        else:
            yield *head, "clash", _written(l), _written(s), None


def lined_up(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, live, source, source_later) with nodes: an array of NODE, in the order of the result; null where neither side is JSON.

    Texts nested deeper than the parser goes count as no JSON.
    """
    columns = [key, "live", "source", "source_later"]
    schema = ", ".join(f"`{c}` {dict(pairs.dtypes)[c]}" for c in columns) + f", nodes array<{NODE}>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, ends = [], [0]
                for l, s in zip(part.column("live").to_pylist(), part.column("source").to_pylist()):
                    l, s = load(l), load(s)
                    if l is ABSENT and s is ABSENT:
                        ends[-1:] = [None, ends[-1]]  # a null
                    else:
                        rows += _lined_up(l, s)
                        ends.append(len(rows))
                fields = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES.values())]
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(_TYPES)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], nodes], [*columns, "nodes"])

    return pairs.select(*columns).mapInArrow(read, schema).withColumn("source_later", F.coalesce("source_later", F.lit(False)))


def _token(n: Column) -> Column:
    """What a node has in the result, behind its name."""
    united = F.concat(F.substring(n["live"], F.lit(1), F.length(n["live"]) - 1), F.when(n["live"] == "[]", "").otherwise(","), F.array_join(n["more"], ","), F.lit("]"))
    source = (n["kind"] == "source") | ((n["kind"] == "clash") & F.col("source_later"))
    return F.when(n["kind"] == "object", "{").when((n["kind"] == "array") & (F.size(n["more"]) > 0), united).when(source, n["source"]).otherwise(n["live"])


def _text() -> Column:
    """The JSON text of `nodes`."""
    r = F.col("nodes")

    def inside(n: Column) -> Column:
        return n["depth"] + (n["kind"] == "object").cast("int")

    def piece(n: Column, i: Column) -> Column:
        before = F.get(r, i - 1)
        left = F.when(i == 0, 0).otherwise(inside(before) - n["depth"])
        comma = F.when((i > 0) & ((left > 0) | (before["kind"] != "object")), ",").otherwise("")
        return F.concat(F.repeat(F.lit("}"), left), comma, F.coalesce(F.concat(n["name"], F.lit(":")), F.lit("")), _token(n))

    return F.concat(F.array_join(F.transform(r, piece), ""), F.repeat(F.lit("}"), inside(F.element_at(r, -1))))


def merge(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of pairs(key, live, source, source_later): JSON texts united key by key.

    merged: (key, text, keys_added, elements_added, replaced, covered): the live members in their order, then the source's new ones; arrays
    united by value; of a difference the later side's value. A new member counts once, whatever is under it. covered: the result is the live
    document. A side that is null or no JSON leaves the other as it is, and two such give the live text. conflicts: (key, pointer, kept_side,
    kept, other) for every difference, each side's whole value.
    """
    x = lined_up(pairs, key)
    later = F.col("source_later")

    def count(of: Callable) -> Column:
        return F.coalesce(F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + of(n)), F.lit(0).cast("long"))

    clash = F.filter("nodes", lambda n: n["kind"] == "clash")
    merged = x.select(
        key, F.coalesce(_text(), "live", "source").alias("text"), count(lambda n: (n["kind"] == "source").cast("long")).alias("keys_added"),
        count(lambda n: F.when(n["more"].isNotNull(), F.size(n["more"])).otherwise(0).cast("long")).alias("elements_added"), F.when(later, count(lambda n: (n["kind"] == "clash").cast("long"))).otherwise(0).alias("replaced"),
    )
    merged = merged.withColumn("covered", (F.col("keys_added") == 0) & (F.col("elements_added") == 0) & (F.col("replaced") == 0))
    n = F.col("n")
    conflicts = x.select(key, "source_later", F.explode(clash).alias("n")).select(
        key, n["pointer"].alias("pointer"), F.when(later, "source").otherwise("live").alias("kept_side"), F.when(later, n["source"]).otherwise(n["live"]).alias("kept"), F.when(later, n["live"]).otherwise(n["source"]).alias("other")
    )
    return merged, conflicts
