"""Accountability: plan, outcomes and reviews joined into a report with a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import rerun_only

# Outcomes that end in a capture and apply nothing.
CAPTURES = ("captured", "captured-with-drift", "capture-extended-from-drift", "capture-reused-after-census", "deferred-with-drift")
# What an attestation may claim.
CLAIMS = ("applied", "refused", "referenced-only", "present", "source-absent")


def latest_review(refusals: DataFrame, reviews: DataFrame) -> DataFrame:
    """refusals(item, instance, code) with decision: the latest review of the very item, else the latest policy for the code.

    reviews(scope 'item' or 'policy', item, instance, code, decision, seq).
    """
    item = reviews.where("scope = 'item'").groupBy("item", "instance", "code").agg(F.max_by("decision", "seq").alias("_i"))
    policy = reviews.where("scope = 'policy'").groupBy("code").agg(F.max_by("decision", "seq").alias("_p"))
    return (
        refusals.join(item, ["item", "instance", "code"], "left").join(policy, "code", "left").withColumn("decision", F.coalesce("_i", "_p")).drop("_i", "_p")
    )


def refusal_reason(code: Column, known: Column) -> Column:
    """Why a recorded refusal leaves its item unaccounted; null where it is typed and waits for a review. known: the code is in use now."""
    return (
        F.when(code == "IO", "refusal-untyped-io").when(code == "FRAME_CODEC", "refusal-untyped-frame-codec").when(rerun_only(code).isNotNull(), rerun_only(code)).when(~F.coalesce(known, F.lit(False)), "refusal-code-retired")
    )


def classified(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """entries with disposition, reason and code, by the first rule that holds.

    entries: item, source, has_workspace; record (null: there is none, 'ok', or why it is unreadable), record_source, outcome, refusal;
    journal ('absent', 'no-capture', 'unreadable' or the outcome it carries); beside and carried (null: no record, 'ok' or why it proves
    nothing); carried_source, carried_via. codes(code) are the refusals in use. A typed refusal is refused-pending-review.
    """
    x = entries.join(codes.select(F.col("code").alias("refusal"), F.lit(True).alias("_known")).distinct(), "refusal", "left")
    workspace, outcome = F.col("has_workspace"), F.col("outcome")

    def bad(reason: str | Column) -> Column:
        return F.struct(F.lit("unaccounted").alias("d"), (F.lit(reason) if isinstance(reason, str) else reason).alias("r"))

    def good(disposition: str) -> Column:
        return F.struct(F.lit(disposition).alias("d"), F.lit(None).cast("string").alias("r"))

    def journal(body: str, closed: str) -> Column:
        # the journal of the current capture has to carry this very outcome
        j = F.col("journal")
        return F.when(j == body, good(closed)).when(j == "absent", bad("journal-missing")).when(j == "no-capture", bad("capture-record-missing")).when(j == "unreadable", bad("capture-record-unreadable")).otherwise(bad("journal-outcome-mismatch"))

    why = refusal_reason(F.col("refusal"), F.col("_known"))
    beside, carried = F.col("beside"), F.col("carried")
    verdict = (
        F.when(F.col("record").isNull(), bad("no-outcome-record"))
        .when(F.col("record") != "ok", bad(F.col("record")))
        .when(~F.col("record_source").eqNullSafe(F.col("source")), bad("record-source-mismatch"))
        .when(outcome == "refused", F.when(why.isNotNull(), bad(why)).otherwise(good("refused-pending-review")))
        .when(
            outcome.isin("workspace-beside", "previous-workspace-beside-not-revalidated"),
            F.when(~workspace, bad("outcome-workspace-mismatch")).when(beside.isNull(), bad("beside-record-missing")).when(beside != "ok", bad(beside)).otherwise(journal("workspace-beside", "applied-beside")),
        )
        .when(outcome.isin("workspace-restored", "previous-workspace-restoration-not-revalidated"), F.when(workspace, journal("workspace-restored", "applied")).otherwise(bad("outcome-workspace-mismatch")))
        .when(outcome == "index-repaired", F.when(workspace, bad("index-repaired-for-workspace-item")).otherwise(journal("refs-imported", "referenced-only")))
        .when(outcome.isin("refs-imported", "previous-ref-custody-not-workspace-parity"), F.when(workspace, bad("refs-only-for-workspace-item")).otherwise(journal("refs-imported", "referenced-only")))
        .when(outcome.isin(*CAPTURES), bad("not-an-apply-outcome"))
        .when(
            outcome == "carried-as-files",
            F.when(carried.isNull(), bad("carried-record-missing")).when(carried != "ok", bad(carried)).when(~F.col("carried_source").eqNullSafe(F.col("source")), bad("carried-source-mismatch"))
            .when(F.col("carried_via").isNotNull() == workspace, bad("carried-shape-mismatch")).otherwise(good("carried")),
        )
        .otherwise(bad("outcome-unknown"))
    )
    return x.withColumn("_v", verdict).select(*entries.columns, F.col("_v.d").alias("disposition"), F.col("_v.r").alias("reason"), F.when(F.col("_v.d") == "refused-pending-review", F.col("refusal")).alias("code"))


def dispositions(plan: DataFrame, outcomes: DataFrame, reviews: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """plan(item) with instance, code, decision and disposition.

    outcomes(item, instance, state 'done', 'held' or 'refused', code); outcomes of one item that differ count as
    refused with the code DUPLICATE_OUTCOME. Without an outcome, or with a refusal that names no cause, that only a rerun settles or whose
    code is none of codes(code) any more: unaccounted; a refusal that a review accepts or abandons: refused; any other:
    refused-pending-review; else the state.
    """
    # an item has one outcome: several that differ are refused as a whole
    many = F.struct("instance", "state", "code")
    one = outcomes.groupBy("item").agg(F.min(many).alias("_a"), F.max(many).alias("_b"))
    clash = ~F.col("_a").eqNullSafe(F.col("_b"))
    one = one.select("item", "_a.instance", F.when(clash, "refused").otherwise(F.col("_a.state")).alias("state"), F.when(clash, "DUPLICATE_OUTCOME").otherwise(F.col("_a.code")).alias("code"))
    x = plan.select("item").distinct().join(one, "item", "left")
    x = latest_review(x, reviews)
    x = x.withColumn("_known", F.lit(True)) if codes is None else x.join(codes.select("code", F.lit(True).alias("_known")).distinct(), "code", "left")
    refused = F.col("state") == "refused"
    untyped = refused & refusal_reason(F.col("code"), F.col("_known") | (F.col("code") == "DUPLICATE_OUTCOME")).isNotNull()
    closed = F.col("decision").isin("accept", "abandon")
    kind = F.when(F.col("state").isNull() | untyped, "unaccounted").when(refused, F.when(F.coalesce(closed, F.lit(False)), "refused").otherwise("refused-pending-review")).otherwise(F.col("state"))
    return x.select("item", "instance", "code", "decision", kind.alias("disposition"))


def report(rows: DataFrame) -> DataFrame:
    """(disposition, code, n): totals; code only for refusals."""
    return rows.groupBy("disposition", F.when(F.col("disposition").startswith("refused"), F.col("code")).alias("code")).agg(F.count("*").alias("n"))


def gate(rows: DataFrame) -> DataFrame:
    """One row: unaccounted, pending, passed."""
    out = rows.agg(F.count_if(F.col("disposition") == "unaccounted").alias("unaccounted"), F.count_if(F.col("disposition") == "refused-pending-review").alias("pending"))
    return out.withColumn("passed", (F.col("unaccounted") == 0) & (F.col("pending") == 0))


def attested(rows: DataFrame, attestations: DataFrame) -> DataFrame:
    """(bucket, n): accepted (of an unaccounted item), superseded (the item is accounted for), disagreement
    (it is, with another state), rejected (not valid) or foreign (no such item)."""
    x = attestations.join(rows.select("item", "disposition"), "item", "left")
    bucket = (
        F.when(F.col("disposition").isNull(), "foreign")
        .when(~F.col("valid"), "rejected")
        .when(F.col("disposition") == "unaccounted", "accepted")
        .when(F.col("disposition") == F.col("claims"), "superseded")
        .otherwise("disagreement")
    )
    return x.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def attestations(rows: DataFrame, ledger: DataFrame, codes: DataFrame) -> DataFrame:
    """(item, bucket, reason) for each row of the ledger; an item listed twice is an error of the whole ledger.

    rows: item, source, capture (the digest now, null without a capture), capture_readable, disposition, refusal (of the item's own record, null if
    it is none), refusal_untyped (the record holds a refusal without a code). ledger: item, source, capture, capture_named ('digest', 'null' or
    'missing'), disposition, basis, refusal, evidence (null or empty: none). codes(code) are the refusals in use.

    foreign: no planned item; superseded or disagreement: the item is accounted for, the same or otherwise; rejected, with the first reason that
    holds; else accepted.
    """
    if not ledger.groupBy("item").count().where("count > 1").isEmpty():
        raise ValueError("an attestation ledger lists an item twice")
    known = codes.select("code").distinct()
    a = ledger.select("item", *[F.col(c).alias(f"a_{c}") for c in ("source", "capture", "capture_named", "disposition", "basis", "refusal", "evidence")])
    x = a.join(rows.select("item", "source", "capture", "capture_readable", "disposition", "refusal", "refusal_untyped", F.lit(True).alias("_there")), "item", "left")
    x = x.join(known.select(F.col("code").alias("refusal"), F.lit(True).alias("_typed")), "refusal", "left").join(known.select(F.col("code").alias("a_refusal"), F.lit(True).alias("_named")), "a_refusal", "left")
    own = F.col("refusal")
    same_capture = F.when(F.col("a_capture_named") == "null", F.col("capture").isNull()).otherwise(F.coalesce(F.col("a_capture") == F.col("capture"), F.lit(False)))
    reason = (
        F.when(own.isNotNull() & F.col("_typed").isNull() & ~own.isin("IO", "FRAME_CODEC"), "native-refusal-code-retired")
        .when(own.isin("IO", "FRAME_CODEC") | F.coalesce("refusal_untyped", F.lit(False)), "native-refusal-untyped")
        .when(own == "GIT_CONVERGE_INTERRUPTED", "native-converge-interrupted")
        .when(own == "TRANSPORT_LOST", "native-transport-lost")
        .when(rerun_only(own).isNotNull(), "native-run-level-refusal")
        .when(~F.coalesce(F.col("a_source") == F.col("source"), F.lit(False)), "source-mismatch")
        .when(F.col("a_capture_named") == "missing", "capture-missing")
        .when(~F.col("capture_readable"), "capture-record-unreadable")
        .when(~same_capture, "capture-mismatch")
        .when(~F.coalesce(F.col("a_disposition").isin(*CLAIMS), F.lit(False)), "disposition-unknown")
        .when(F.coalesce("a_basis", F.lit("")) == "", "basis-missing")
        .when(F.col("a_basis") == "native-closure-report", "basis-claims-native")
        .when(F.coalesce("a_evidence", F.lit("")) == "", "evidence-missing")
        .when((F.col("a_disposition") == "refused") & (F.col("a_refusal").isin("IO", "FRAME_CODEC") | F.col("_named").isNull()), "refusal-untyped")
    )
    agrees = (F.col("a_disposition") == F.col("disposition")) | ((F.col("a_disposition") == "refused") & F.col("disposition").isin("refused", "refused-pending-review"))
    accounted = F.col("disposition") != "unaccounted"
    bucket = F.when(F.col("_there").isNull(), "foreign").when(accounted, F.when(F.coalesce(agrees, F.lit(False)), "superseded").otherwise("disagreement")).when(reason.isNotNull(), "rejected").otherwise("accepted")
    return x.withColumn("bucket", bucket).select("item", "bucket", F.when(F.col("bucket") == "rejected", reason).alias("reason"))


def unmatched(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes that no planned item owns."""
    return outcomes.join(plan.select("item").distinct(), "item", "left_anti")
