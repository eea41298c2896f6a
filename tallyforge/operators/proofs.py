"""Proofs from ledgers: what may be retired, what was carried, what stands for an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .census import path_class

# Outcomes that the destination's content proves, and such that the ledger's record does.
BY_CONTENT = ("adopt", "extend", "covered", "rollout-extended")
BY_RECORD = ("rollout-covered", "rollout-rewrite-covered")


def transfer_entries(records: DataFrame) -> DataFrame:
    """(session, path, outcome) of records(session, entries: array of (path, outcome)), each once, in the order of paths."""
    e = records.select("session", F.explode("entries").alias("e"))
    return e.select("session", "e.path", "e.outcome").distinct().orderBy("session", "path", "outcome")


def ledger_entries(plan: DataFrame, outcomes: DataFrame, journals: DataFrame, captures: DataFrame, beside: DataFrame, carried: DataFrame) -> DataFrame:
    """The rows that closure.classified reads, of plan(item, source, has_workspace) and the records of several states.

    Each record has seq, the order of the states; of an item's records of a kind the last counts. outcomes(item, seq, record, record_source, outcome, refusal), journals(item, seq, body),
    captures(item, seq, readable), beside(item, seq, verdict), carried(item, seq, verdict, source, via).
    """

    def last(x: DataFrame, *columns: str) -> DataFrame:
        return x.groupBy("item").agg(F.max_by(F.struct(*columns), "seq").alias("_r")).select("item", *[F.col(f"_r.{c}").alias(c) for c in columns])

    sides = [
        last(outcomes, "record", "record_source", "outcome", "refusal"), last(journals, "body"), last(captures, "readable"), last(beside.withColumnRenamed("verdict", "beside"), "beside"),
        last(carried.select("item", "seq", F.col("verdict").alias("carried"), F.col("source").alias("carried_source"), F.col("via").alias("carried_via")), "carried", "carried_source", "carried_via"),
    ]
    x = reduce(lambda a, s: a.join(s, "item", "left"), sides, plan.select("item", "source", "has_workspace"))
    journal = F.when(F.col("readable").isNull(), "no-capture").when(~F.col("readable"), "unreadable").otherwise(F.coalesce("body", F.lit("absent")))
    return x.withColumn("journal", journal).drop("body", "readable")


def retire_plan(rows: DataFrame, actions: DataFrame, proofs: DataFrame) -> DataFrame:
    """(path, verdict, allowed, why): the files of a source that may go, and those of which no row proves a copy.

    rows(path, seq, kind, key, output): what the store recorded, in order; output whether it wrote the file. actions(path, action) of the transfer records: one that is
    there stands for all rows of a path, else a written row is adopted and any other says nothing. proofs(path, key, reason): reason null where the proof holds; key null
    for the content's own, which holds for all rows of a path.
    retire: allowed rows prove it; skipped: none does, why is the last row's reason. Paths out of the root, databases and files that are not regular have no row here.
    """
    inside = ~F.col("path").startswith("/") & ~F.exists(F.split("path", "/"), lambda p: p.isin("", ".", ".."))
    x = rows.where(inside & (path_class(F.col("path")) != "sqlite") & (F.col("kind") == "regular"))
    x = x.join(actions.groupBy("path").agg(F.max("action").alias("action")), "path", "left")
    x = x.withColumn("action", F.coalesce("action", F.when(F.col("output"), "adopt"))).where("action is not null")
    content = proofs.where("key is null").groupBy("path").agg(F.max(F.struct(F.lit(True).alias("there"), "reason")).alias("content"))
    record = proofs.where("key is not null").groupBy("path", "key").agg(F.max(F.struct(F.lit(True).alias("there"), "reason")).alias("record"))
    x = x.join(content, "path", "left").join(record, ["path", "key"], "left")
    by = F.when(F.col("action").isin(*BY_RECORD), F.col("record")).otherwise(F.col("content"))
    useless = ~F.col("action").isin(*BY_CONTENT, *BY_RECORD)
    why = F.when(useless, F.concat(F.lit("its outcome ("), F.col("action"), F.lit(") proves no copy"))).when(by.isNull(), "no proof").otherwise(by["reason"])
    each = x.withColumn("why", why).groupBy("path").agg(F.count_if(F.col("why").isNull()).alias("allowed"), F.max_by("why", F.when(F.col("why").isNotNull(), F.col("seq"))).alias("why"))
    return each.select("path", F.when(F.col("allowed") > 0, "retire").otherwise("skipped").alias("verdict"), "allowed", F.when(F.col("allowed") == 0, F.col("why")).alias("why"))


def carry_proof(items: DataFrame, records: DataFrame, transfers: DataFrame, refused: DataFrame, attached: DataFrame, version: int) -> DataFrame:
    """(item, reason) for each of items that has a carry record; reason is null where it proves the carry.

    items(item, source, workspace, planned): planned is the destination of a workspace under the record's suffix. records(item, seq, readable, version, record_item, source, via, destination, transfer_item,
    transfer_digest, transfer_source): the one of the latest state counts. transfers(transfer_item, digest, readable, session, session_item, destination, source); refused(transfer_item): a path was
    refused in it; attached(item): a recorded pointer resolves outside of the destination.
    """
    r = records.withColumn("_n", F.row_number().over(W.partitionBy("item").orderBy(F.desc("seq")))).where("_n = 1").alias("r")
    t = transfers.select("transfer_item", F.struct("digest", "readable", "session", "session_item", "destination", "source").alias("t")).dropDuplicates(["transfer_item"])
    x = items.select("item", F.col("source").alias("i_source"), "workspace", "planned").join(r, "item").join(t, "transfer_item", "left")
    x = x.join(refused.select("transfer_item", F.lit(True).alias("_refused")).distinct(), "transfer_item", "left").join(attached.select("item", F.lit(True).alias("_attached")).distinct(), "item", "left")
    tr = F.col("t")
    # the record may stand with a host in front
    same_source = (tr["source"] == F.col("i_source")) | (tr["source"].endswith(F.concat(F.lit(":"), F.col("i_source"))) & (F.length(tr["source"]) > F.length("i_source") + 1))
    fits = (tr["session"] == "completed") & (tr["session_item"] == F.col("transfer_item")) & (tr["destination"] == F.col("destination")) & (tr["source"] == F.col("transfer_source")) & same_source
    reason = (
        F.when(~F.col("readable"), "carried-record-unreadable")
        .when((F.col("version") != version) | (F.col("record_item") != F.col("item")), "carried-record-mismatch")
        .when(F.col("source") != F.col("i_source"), "carried-source-mismatch")
        .when(F.col("workspace") & F.col("via").isNull(), F.when(~F.col("planned").eqNullSafe(F.col("destination")), "carried-destination-mismatch"))
        .when(~(~F.col("workspace") & F.col("via").isNotNull()), "carried-shape-mismatch")
    )
    later = (
        F.when(tr.isNull(), "carried-transfer-missing").when(tr["digest"] != F.col("transfer_digest"), "carried-transfer-changed").when(~tr["readable"], "carried-transfer-unreadable")
        .when(~F.coalesce(fits, F.lit(False)), "carried-transfer-mismatch").when(F.col("_refused"), "carried-transfer-refused-paths").when(F.col("_attached"), "carried-pointer-attached")
    )
    return x.select("item", F.coalesce(reason, later).alias("reason"))
