"""Merging JSON documents key by key, with a ledger of every value not kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_union_by_value(live: Column, source: Column) -> Column:
    """The live elements as they are, then each source element equal to none before it."""
    fresh = F.filter(source, lambda x: ~F.coalesce(F.exists(live, lambda y: y.eqNullSafe(x)), F.lit(False)))
    return F.concat(live, F.array_distinct(fresh))


def top_level_conflicts(pairs: DataFrame, key: str) -> DataFrame:
    """(key, name, kept_side, kept, lost) for flat objects: pairs(key, live, source maps of strings, later 'live' or 'source').

    Names of one side only are kept; a name with different values keeps the later side's.
    """
    names = F.explode(F.array_union(F.map_keys("live"), F.map_keys("source"))).alias("name")
    rows = pairs.select(key, "live", "source", "later", names)
    l, s = F.col("live")[F.col("name")], F.col("source")[F.col("name")]
    rows = rows.select(key, "name", "later", l.alias("l"), s.alias("s"), F.array_contains(F.map_keys("live"), F.col("name")).alias("in_l"), F.array_contains(F.map_keys("source"), F.col("name")).alias("in_s"))
    side = (
        F.when(~F.col("in_s"), "live").when(~F.col("in_l"), "source").when(F.col("l").eqNullSafe(F.col("s")), "same").otherwise(F.col("later"))
    )
    differs = F.col("in_l") & F.col("in_s") & ~F.col("l").eqNullSafe(F.col("s"))
    return rows.withColumn("kept_side", side).select(
        key, "name", "kept_side",
        F.when(F.col("kept_side").isin("source"), F.col("s")).otherwise(F.col("l")).alias("kept"),
        F.when(differs, F.when(F.col("later") == "source", F.col("l")).otherwise(F.col("s"))).alias("lost"),
    )


def pointer(*names: str) -> str:
    """A JSON pointer."""
    return "".join("/" + n.replace("~", "~0").replace("/", "~1") for n in names)


def same(a, b) -> bool:
    """Equality of values: objects without regard to order, numbers by value, true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b or (a != a and b != b)
    return type(a) is type(b) and a == b


def merge(live, source, source_later: bool, at: str = "", lost: list | None = None):
    """(merged, lost): lost has (pointer, side, value) for each value of a conflict that is not kept."""
    lost = [] if lost is None else lost
    if isinstance(live, dict) and isinstance(source, dict):
        out = {}
        for k, v in live.items():
            out[k] = merge(v, source[k], source_later, at + pointer(k), lost)[0] if k in source else v
        return out | {k: v for k, v in source.items() if k not in live}, lost
    if isinstance(live, list) and isinstance(source, list):
        out = list(live)
        for v in source:
            if not any(same(v, x) for x in out):
                out.append(v)
        return out, lost
    if same(live, source):
        return live, lost
    lost.append((at, "live" if source_later else "source", live if source_later else source))
    return (source if source_later else live), lost


def merge_documents(pairs: DataFrame, key: str) -> DataFrame:
    """(key, merged, lost): nested JSON texts live and source merged; source_later says which side wins a conflict.

    lost is a JSON list of [pointer, side, value]. A side that is null or no JSON leaves the other as it is.
    """

    def load(x):
        try:
            return True, json.loads(x)
        except (TypeError, ValueError):
            return False, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            merged, lost = [], []
            for live, source, later in zip(b["live"], b["source"], b["source_later"], strict=True):
                (l_ok, l), (s_ok, s) = load(live), load(source)
                if l_ok and s_ok:
                    m, gone = merge(l, s, bool(later))
                    merged.append(json.dumps(m, ensure_ascii=False))
                    lost.append(json.dumps(gone, ensure_ascii=False))
                else:
                    merged.append(live if l_ok or not s_ok else source)
                    lost.append("[]")
            yield pd.DataFrame({key: b[key], "merged": merged, "lost": lost})

    return pairs.select(key, "live", "source", "source_later").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, merged string, lost string")


def canonical(text: Column) -> Column:
    """A JSON text with the members of all objects sorted by name, without the top one's `ordinal`: equal for texts that differ in order only.

    Types stay apart: 1 is not "1". What is no JSON stays as it is, behind a mark of its own; null is null.
    """

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                v = json.loads(t)
            except ValueError:
                return "raw:" + t
            if isinstance(v, dict):
                v.pop("ordinal", None)
            return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

        return texts.map(one, na_action=None)

    return made(text)
