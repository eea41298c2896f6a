"""A key of its own for each row, where the id is none: null ids, repeated ids, repeated rows. Sums over a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import saved


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, sorted and written once, with _part and _at: the sort's task and the row's place in it. The two order all rows."""
    rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return saved(rows.select(*df.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of ordered() with their place in the whole order, from 0, in place of _part and _at."""
    starts, at = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("_part").agg(F.count("*")).collect())):  # one row for each task of the sort
        starts.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    rows = rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at"))
    return rows.drop("_part", "_at", "_start")


def prefixed(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with, for each name of sums, the sum of that column over all rows before, in a global order without ties.

    Sums of whole slices of 4,096 rows are added up first, so that no task sees all rows.
    """
    rows = ordered(df, *order).withColumn("_slice", F.shiftright("_at", 12))
    held = rows.groupBy("_part", "_slice").agg(*[F.sum(c).alias(f"_held_{n}") for n, c in sums.items()])
    whole = held.groupBy("_part").agg(*[F.sum(f"_held_{n}").alias(f"_all_{n}") for n in sums])
    parts = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task of the sort
    whole = whole.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(parts), F.lit(0)).alias(f"_all_{n}") for n in sums])
    slices = W.partitionBy("_part").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("_part", "_slice", *[F.coalesce(F.sum(f"_held_{n}").over(slices), F.lit(0)).alias(f"_held_{n}") for n in sums])
    inside = W.partitionBy("_part", "_slice").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()])
    out = out.join(held, ["_part", "_slice"]).join(whole, "_part")
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_held_{n}") + F.col(f"_all_{n}")).alias(n) for n in sums])


def running(df: DataFrame, by: list[str], place: str, value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same by at smaller places, whole numbers that differ within by.

    Sums of whole slices of 4,096 places come first: a task sees one slice, or one row for each slice of its by.
    """
    rows = df.withColumn("_slice", F.shiftright(F.col(place).cast("long"), 12))
    held = rows.groupBy(*by, "_slice").agg(F.sum(value).alias("_held"))
    ahead = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(*by, "_slice", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_slice").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(held, [*by, "_slice"]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))


def keyed(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(docs with a distinct key that is not null, ids(row, id) of what stood there before).

    Ids that are distinct and not null stay, and ids is None. Otherwise rows are numbered from 0 in
    the order of their ids, null last, and of their content; equal rows get numbers in any order. The
    numbers depend on the rows only, and are written to a table once.
    """
    found = docs.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").limit(1)
    if not found.count():
        return docs, None
    rest = [c for c in docs.columns if c != key]
    # the digest bounds what is compared, the last key lets a row repeated very often be split
    rows = docs.withColumns({"_null": F.col(key).isNull(), "_digest": F.sha2(F.to_json(F.struct(*rest)), 256) if rest else F.lit(""), "_tie": F.monotonically_increasing_id()})
    rows = ordered(rows, "_null", key, "_digest", "_tie").select(*docs.columns, "_part", "_at")
    rows = numbered(rows, "_row")
    ids = rows.select(F.col("_row").alias("row"), F.col(key).alias("id"))
    return rows.withColumn(key, F.col("_row")).select(*docs.columns), ids


def restored(out: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """out with the numbers of keyed() in these columns (doc_id if none is named) turned back into ids."""
    names = out.columns
    if ids is None:
        return out
    for c in columns or ("doc_id",):
        out = out.withColumnRenamed(c, "_row").join(ids.select(F.col("row").alias("_row"), F.col("id").alias(c)), "_row").select(*names)
    return out
