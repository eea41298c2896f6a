"""Unions of record logs: counted, keyed, by prefix; coverage of one bag by another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a slice of positions, about.
SLICE = 4096


def counted_extras(live: DataFrame, seat: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Live rows beyond the number of equal seat rows, first occurrences used up first. Null equals null; pos is a whole number, distinct.

    A row's rank among equal ones is its rank in a slice of positions, plus what slices before hold: a line that makes up
    a third of a log is no task's alone. Slices depend on positions only, so every reading of the log cuts the same.
    """
    have = seat.groupBy(*by).agg(F.count("*").alias("_have"))
    low, high, n = live.agg(F.min(pos), F.max(pos), F.count("*")).first()
    width = max(1, (high - low + 1) * SLICE // n) if n else 1
    sliced = live.withColumn("_slice", F.floor((F.col(pos) - F.lit(low or 0)) / width))
    held = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(*by, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    # per line and slice: how many of its rows there are used up
    left = held.alias("a").join(have.alias("h"), [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by], "left")
    left = left.select(*[F.col(f"a.{c}").alias(c) for c in by], "_slice", (F.coalesce("_have", F.lit(0)) - F.col("_ahead")).alias("_used"))
    ranked = sliced.withColumn("_in", F.row_number().over(W.partitionBy(*by, "_slice").orderBy(pos)))
    met = [F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}")) for c in (*by, "_slice")]
    return ranked.alias("r").join(left.alias("u"), met).where("_in > _used").select(*[F.col(f"r.{c}") for c in live.columns])


def keyed_extras(live: DataFrame, seat: DataFrame, key: str, pos: str) -> DataFrame:
    """Live rows whose key the seat lacks, each key once, at its first place."""
    first = live.groupBy(key).agg(F.min(pos).alias(pos))
    return live.join(first, [key, pos]).join(seat.select(key).distinct(), key, "left_anti").select(*live.columns)


def union_log(seat: DataFrame, extras: DataFrame) -> DataFrame:
    """The seat whole, then the extras, with their side: 0 or 1; the order is (side, position)."""
    return seat.withColumn("side", F.lit(0)).unionByName(extras.withColumn("side", F.lit(1)))


def union_actions(rows: DataFrame, key: str) -> DataFrame:
    """(key, action, extras) for rows(key, side 's' or 'l', pos, line, uid): what a union of source into live does.

    adopt: equal; covered: the live log starts with the source or has nothing of its own beyond it; extend:
    the source starts with the live log; else consolidate. Positions count from 0 in each log. A uid
    makes a line the same line; lines without are counted from the end of the common prefix.
    """
    s = rows.where("side = 's'").select(F.col(key).alias("k"), "pos", F.col("line").alias("sl"), F.lit(1).alias("in_s"))
    l = rows.where("side = 'l'").select(F.col(key).alias("k"), "pos", F.col("line").alias("ll"), F.lit(1).alias("in_l"))
    cut = (
        s.join(l, ["k", "pos"], "full_outer")
        .groupBy("k")
        .agg(
            F.min(F.when(~(F.col("sl").eqNullSafe(F.col("ll")) & F.col("in_s").isNotNull() & F.col("in_l").isNotNull()), F.col("pos"))).alias("cut"),
            F.count("in_s").alias("n_s"),
            F.count("in_l").alias("n_l"),
        )
        .withColumn("same", F.least(F.coalesce("cut", F.greatest("n_s", "n_l")), F.greatest("n_s", "n_l")))
    )
    after = rows.withColumnRenamed(key, "k").join(cut, "k")
    seat_ids = after.where("side = 's' and uid is not null").select("k", "uid").distinct().withColumn("known", F.lit(True))
    seat_lines = after.where("side = 's' and uid is null and pos >= same").groupBy("k", "line").agg(F.count("*").alias("have"))
    live = after.where("side = 'l' and pos >= same").withColumn("rn", F.row_number().over(W.partitionBy("k", F.col("uid").isNull(), F.coalesce("uid", "line")).orderBy("pos")))
    kept = (
        live.join(seat_ids, ["k", "uid"], "left")
        .join(seat_lines, ["k", "line"], "left")
        .where((F.col("uid").isNull() & (F.col("rn") > F.coalesce("have", F.lit(0)))) | (F.col("uid").isNotNull() & (F.col("rn") == 1) & F.col("known").isNull()))
        .groupBy("k")
        .agg(F.count("*").alias("extras"))
    )
    extras = F.coalesce("extras", F.lit(0))
    action = (
        F.when(F.col("cut").isNull() & (F.col("n_s") == F.col("n_l")), "adopt")
        .when(F.col("same") >= F.col("n_s"), "covered")
        .when(F.col("same") >= F.col("n_l"), "extend")
        .when(extras == 0, "covered")
        .otherwise("consolidate")
    )
    return cut.join(kept, "k", "left").select(F.col("k").alias(key), action.alias("action"), extras.alias("extras"))


def coverage(source: DataFrame, target: DataFrame, key: str, event: str, pos: str) -> DataFrame:
    """(key, verdict, lacking): covered if the target has every event as often as the source; extends if the
    target's events are the source's first; else lacks."""
    s, t = (x.groupBy(key, event).agg(F.count("*").alias(n)) for x, n in ((source, "s"), (target, "t")))
    lack = s.join(t, [key, event], "left").groupBy(key).agg(F.sum(F.greatest(F.col("s") - F.coalesce("t", F.lit(0)), F.lit(0))).alias("lacking"))

    def numbered(x: DataFrame, name: str) -> DataFrame:
        return x.select(key, F.row_number().over(W.partitionBy(key).orderBy(pos)).alias("_i"), F.col(event).alias(name), F.lit(1).alias(f"in_{name}"))

    order = numbered(source, "a").join(numbered(target, "b"), [key, "_i"], "full_outer").groupBy(key).agg(
        F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.bool_and(F.col("in_b").isNull() | (F.col("in_a").isNotNull() & F.col("a").eqNullSafe(F.col("b")))).alias("prefix")
    )
    verdict = F.when(F.col("lacking") == 0, "covered").when(F.coalesce("prefix", F.lit(True)) & (F.col("n_b") < F.col("n_a")), "extends").otherwise("lacks")
    return lack.join(order, key).select(key, verdict.alias("verdict"), "lacking")


def coverage_of_logs(source: DataFrame, target: DataFrame, key: str, limit: int = 1 << 30) -> DataFrame:
    """(key, verdict, lacking, events, missing_ids, ids) of source and target(key, pos, event, ordinal, ids, size): what a target log holds of a source's events.

    event is an event's identity without its ordinal, ordinal whether it had one, ids its turn and call ids (array), size its bytes.
    over-limit: a side has more than `limit` bytes; covered: every event is there as often; extends: the target's events are the source's first, in
    order; rewrite-covered: every source event has an ordinal and no target event, and the target holds all ids, of which there are some; lacks: else. missing_ids is null unless
    the source is such a rewrite. A source without events is covered.
    """
    s = source.groupBy(key).agg(F.count("*").alias("events"), F.count_if("ordinal").alias("ordinals"), F.sum(F.col("size") + 1).alias("s_bytes"))
    t = target.groupBy(key).agg(F.bool_or("ordinal").alias("t_ordinal"), F.sum(F.col("size") + 1).alias("t_bytes"))
    plain = coverage(source, target, key, "event", "pos")

    def each(x: DataFrame) -> DataFrame:
        return x.select(key, F.explode("ids").alias("_id")).distinct()

    met = each(source).join(each(target).withColumn("_h", F.lit(True)), [key, "_id"], "left").groupBy(key).agg(F.count("*").alias("ids"), F.count_if(F.col("_h").isNull()).alias("missing"))
    x = s.join(plain, key, "left").join(t, key, "left").join(met, key, "left")
    ids = F.coalesce("ids", F.lit(0).cast("long"))
    rewrite = (F.col("events") == F.col("ordinals")) & ~F.coalesce("t_ordinal", F.lit(False))
    over = F.coalesce(F.col("s_bytes") > limit, F.lit(False)) | F.coalesce(F.col("t_bytes") > limit, F.lit(False))
    missing = F.when(rewrite & (F.col("verdict") == "lacks"), F.coalesce("missing", F.lit(0).cast("long")))
    verdict = F.when(over, "over-limit").when((F.col("verdict") == "lacks") & rewrite & (ids > 0) & (missing == 0), "rewrite-covered").otherwise(F.col("verdict"))
    return x.select(key, verdict.alias("verdict"), "lacking", "events", missing.alias("missing_ids"), ids.alias("ids"))


def ordered_difference(captured: DataFrame, existing: DataFrame, line: str, pos: str) -> DataFrame:
    """(pos, line): captured lines that are not among the existing, once each, at their first place.

    Lines are compared without one carriage return at the end and without trailing spaces that no backslash
    escapes; blank ones are skipped.
    """

    def key(c: str) -> F.Column:
        bare = F.regexp_replace(F.col(c), "\r$", "")
        return F.regexp_replace(bare, r"(?<!\\) +$", "")

    a = captured.withColumn("_k", key(line)).where("_k <> ''")
    b = existing.select(key(line).alias("_k")).distinct()
    first = a.groupBy("_k").agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(line).alias("line"))).alias("f"))
    return first.join(b, "_k", "left_anti").select("f.pos", "f.line")
