"""Unions of keyed tables with a ledger of every value that is not kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def version_order(source: Column, dest: Column) -> Column:
    """newer, older, same-version or unversioned (a side is null)."""
    return F.when(source.isNull() | dest.isNull(), "unversioned").when(source > dest, "newer").when(source < dest, "older").otherwise("same-version")


def union_natural(source: DataFrame, dest: DataFrame, key: list[str], version: str | None) -> DataFrame:
    """One row per key of either side: key..., action, reason, kept and lost (the values as structs).

    Keys meet null-safe. insert: only the source has it; keep: only the destination; adopt: equal; replace: the
    source's version is later; hold: it is not. What is not kept is in lost. A key that one side has
    twice is decided for its first row by all columns.
    """
    values = [c for c in dest.columns if c not in key]

    def one(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy(*key).agg(F.min(F.struct(*values)).alias(name)).withColumn(f"in_{name}", F.lit(True))

    s, d = one(source, "s"), one(dest, "d")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = s.alias("a").join(d.alias("b"), on, "full_outer").select(
        *[F.when(F.col("in_s"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key], "s", "d", "in_s", "in_d"
    )
    order = version_order(F.col(f"s.{version}"), F.col(f"d.{version}")) if version else F.lit("unversioned")
    action = (
        F.when(F.col("in_d").isNull(), "insert")
        .when(F.col("in_s").isNull(), "keep")
        .when(F.col("s").eqNullSafe(F.col("d")), "adopt")
        .when(order == "newer", "replace")
        .otherwise("hold")
    )
    both = both.withColumn("action", action).withColumn("reason", F.when(F.col("action").isin("replace", "hold"), order))
    from_source = F.col("action").isin("insert", "replace")
    return both.select(
        *key, "action", "reason",
        F.when(from_source, F.col("s")).otherwise(F.col("d")).alias("kept"),
        F.when(F.col("action") == "replace", F.col("d")).when(F.col("action") == "hold", F.col("s")).alias("lost"),
    )


def union_surrogate(source: DataFrame, dest: DataFrame, unique: list[str], order: str) -> DataFrame:
    """source with action: adopt (equal content there), keep-dest (its unique key is there with other content), repeat
    (an earlier source row has that unique key) or insert."""
    values = [c for c in source.columns if c != order]
    held = dest.groupBy(*unique).agg(F.min(F.struct(*values)).alias("_there"))
    rn = F.row_number().over(W.partitionBy(*unique).orderBy(order))
    same = F.struct(*[F.col(c) for c in values]).eqNullSafe(F.col("_there"))
    return (
        source.withColumn("_rn", rn)
        .join(held, unique, "left")
        .withColumn("action", F.when(F.col("_there").isNotNull() & same, "adopt").when(F.col("_there").isNotNull(), "keep-dest").when(F.col("_rn") > 1, "repeat").otherwise("insert"))
        .drop("_rn", "_there")
    )


def unique_probe(source: DataFrame, dest: DataFrame, uniques: list[list[str]], order: str) -> DataFrame:
    """source with action and key_no: the first of several unique keys that names a destination row decides: adopt (equal content) or keep-dest (key_no: the key's number
    from 1). A source row that shares a unique key with an earlier one that is inserted is a repeat; else insert. A null in a key names nothing."""
    values = [c for c in source.columns if c != order]
    x, hits = source, []
    for n, unique in enumerate(uniques, 1):
        held = dest.where(F.col(unique[0]).isNotNull()).groupBy(*unique).agg(F.min(F.struct(*values)).alias(f"_there{n}"))
        x = x.join(held, unique, "left")
        hits.append(F.when(F.col(f"_there{n}").isNotNull(), F.struct(F.col(f"_there{n}").alias("there"), F.lit(n).alias("key_no"))))
    x = x.withColumn("_hit", F.coalesce(*hits)).select(*source.columns, "_hit")
    free = x.where("_hit is null")
    first = free
    for n, unique in enumerate(uniques, 1):
        whole = F.lit(True)
        for c in unique:
            whole = whole & F.col(c).isNotNull()
        earliest = free.where(whole).groupBy(*unique).agg(F.min(order).alias(f"_first{n}"))
        first = first.join(earliest, unique, "left")
    earlier = F.least(*[F.col(f"_first{n}") for n in range(1, len(uniques) + 1)], F.col(order))
    new = first.select(*source.columns, F.when(earlier < F.col(order), "repeat").otherwise("insert").alias("action"), F.lit(None).cast("int").alias("key_no"))
    same = F.struct(*values).eqNullSafe(F.col("_hit.there"))
    met = x.where("_hit is not null").select(*source.columns, F.when(same, "adopt").otherwise("keep-dest").alias("action"), F.col("_hit.key_no").alias("key_no"))
    return new.unionByName(met)


def union_threads(threads: DataFrame, rows: DataFrame, dest_rows: DataFrame, thread: str, key: list[str], ordinal: str, row_order: str) -> DataFrame:
    """rows of the source with outcome: held, insert, adopt, replace or hold, under their thread's winner.

    threads(thread, winner: source, dest or same). A source row that the destination lacks collides if its
    ordinal is taken: by an earlier source row that was inserted, or, where the source wins, matched; or by
    a destination row not yet overwritten. From a thread's first collision on all its rows are held.
    """
    d = dest_rows.select(thread, *key, ordinal, F.struct(*[c for c in dest_rows.columns if c not in key]).alias("_d"))
    w = threads.select(F.col(thread), "winner")
    s = rows.withColumn("_s", F.struct(*[c for c in dest_rows.columns if c not in key])).alias("s")
    on = [F.col(f"s.{k}") == F.col(f"d.{k}") for k in (thread, *key)]
    both = s.join(d.alias("d"), on, "left").select(*[F.col(f"s.{c}").alias(c) for c in rows.columns], F.col("s._s").alias("_s"), F.col("d._d").alias("_d"))
    both = both.join(w, thread, "left")
    # the first earlier source row that occupies the ordinal
    takes = F.col("_d").isNull() | (F.col("winner") == "source")
    first_taker = both.where(takes & F.col(ordinal).isNotNull()).groupBy(thread, ordinal).agg(F.min(row_order).alias("_taken_at"))
    # destination rows on the ordinal, and when each is overwritten
    matched = both.where(F.col("_d").isNotNull()).select(thread, *key, F.col(row_order).alias("_at"))
    at = F.when(F.col("winner") == "source", F.coalesce("_at", F.lit(2**62))).otherwise(F.lit(2**62))
    there = (
        dest_rows.select(thread, *key, ordinal)
        .join(matched, [thread, *key], "left")
        .join(w, thread, "left")
        .where(F.col(ordinal).isNotNull())
        .groupBy(thread, ordinal)
        .agg(F.max(at).alias("_until"))
    )
    seen = both.join(first_taker, [thread, ordinal], "left").join(there, [thread, ordinal], "left")
    clash = F.col("winner").isin("source", "dest") & F.col("_d").isNull() & F.col(ordinal).isNotNull() & (
        F.coalesce(F.col("_taken_at") < F.col(row_order), F.lit(False)) | F.coalesce(F.col("_until") > F.col(row_order), F.lit(False))
    )
    start = F.min(F.when(clash, F.col(row_order))).over(W.partitionBy(thread))
    outcome = (
        F.when(F.col(row_order) >= F.col("_start"), "held")
        .when(F.col("_d").isNull(), "insert")
        .when(F.col("_s").eqNullSafe(F.col("_d")), "adopt")
        .when(F.col("winner") == "source", "replace")
        .otherwise("hold")
    )
    return seen.withColumn("_start", start).withColumn("outcome", outcome).select(*rows.columns, "outcome")


def since_marks(rows: DataFrame, marks: DataFrame, by: str, time: str) -> DataFrame:
    """Rows at or after their group's mark, or in a group without one."""
    m = marks.select(by, F.col("mark"))
    return rows.join(m, by, "left").where(F.col("mark").isNull() | (F.col(time) >= F.col("mark"))).drop("mark")


def marks_of(rows: DataFrame, by: str, time: str) -> DataFrame:
    """(by, mark): the highest time of each group."""
    return rows.groupBy(by).agg(F.max(time).alias("mark"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of a key, the one with the highest order: an upsert into a ledger."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dependency_order(tables: list[str], references: list[tuple[str, str]]) -> list[str]:
    """Tables so that what a table references comes first; ties and cycles by name. Metadata of the driver."""
    out: list[str] = []
    left = sorted(tables)
    while left:
        free = [t for t in left if all(b in out or b == t or b not in left for a, b in references if a == t)]
        out.append(free[0] if free else left[0])
        left.remove(out[-1])
    return out


# Columns that tell a row's version, and those that are a clock, in the order of preference.
VERSIONS, CLOCKS = ("updated_at_ms", "updated_at", "updated_at_ordinal"), ("updated_at_ms", "updated_at")


def key_plans(columns: DataFrame) -> DataFrame:
    """(table, kind, key, version, time, paths, thread, ordinals, threads) of each table of columns, the frame of sqlitestream.schema_of: how its rows are united.

    kind: natural (its primary key), surrogate (one INTEGER key that the table numbers by AUTOINCREMENT), rowid (no key), or unsupported (a hidden column, or no key and no rowid). Only a natural
    key has a clock; thread is thread_id where rows belong to threads, and ordinals are their columns of order then. threads: it is the table of the threads themselves.
    """
    one = F.array_sort(F.collect_list(F.struct("place", "column", "declared", "pk")))
    x = columns.groupBy("table").agg(F.max("rowid").alias("rowid"), F.max("sql").alias("sql"), F.bool_or(F.col("hidden") != 0).alias("hidden"), one.alias("c"))
    names = F.transform("c", lambda c: c["column"])
    keys = F.transform(F.array_sort(F.transform(F.filter("c", lambda c: c["pk"] > 0), lambda c: F.struct(c["pk"].alias("pk"), c["column"].alias("column"), c["declared"].alias("declared")))), lambda k: k)
    x = x.withColumns({"names": names, "k": keys})
    alone = (F.size("k") == 1) & F.col("rowid") & F.upper("sql").contains("AUTOINCREMENT") & (F.upper(F.get("k", F.lit(0))["declared"]) == "INTEGER")
    kind = F.when(F.col("hidden") | ((F.size("k") == 0) & ~F.col("rowid")), "unsupported").when(F.size("k") == 0, "rowid").when(F.coalesce(alone, F.lit(False)), "surrogate").otherwise("natural")
    x = x.withColumn("kind", kind).withColumn("key", F.transform("k", lambda k: k["column"]))

    def first(wanted: tuple[str, ...]) -> Column:
        return F.get(F.filter(F.array(*map(F.lit, wanted)), lambda w: F.array_contains("names", w)), F.lit(0))

    natural = F.col("kind") == "natural"
    threads = natural & (F.col("table") == "threads") & (F.col("key") == F.array(F.lit("id")))
    thread = F.when(natural & (F.col("table") != "threads") & F.array_contains("names", "thread_id"), "thread_id")
    paths = F.filter("names", lambda n: n.isin("cwd", "path") | n.endswith("_path"))
    ordinals = F.when(thread.isNotNull(), F.filter("names", lambda n: n.endswith("ordinal") & (n != "updated_at_ordinal"))).otherwise(F.array().cast("array<string>"))
    return x.select("table", "kind", "key", first(VERSIONS).alias("version"), F.when(natural, first(CLOCKS)).alias("time"), paths.alias("paths"), thread.alias("thread"), ordinals.alias("ordinals"), threads.alias("threads"))


def insert_guard(plans: DataFrame, extras: DataFrame, known: list[str]) -> DataFrame:
    """(table, safe): whether rows may be inserted as they are: no trigger of extras(kind, name, table) on the table is unknown, and a table of logs has the key of its rows' numbers."""
    odd = extras.where(F.col("kind") == "trigger").where(~F.col("name").isin(*known) if known else F.lit(True)).select("table", F.lit(True).alias("_odd")).distinct()
    numbered = F.col("kind").isin("rowid", "surrogate") | (F.lower(F.col("table")) != "logs")
    return plans.join(odd, "table", "left").select("table", (F.col("_odd").isNull() & numbered).alias("safe"))


def within(rows: DataFrame, most: int) -> DataFrame:
    """rows, if there are no more than `most`; else an error, before any is worked on."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows
