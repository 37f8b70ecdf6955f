"""Past claims explained, corrections checked, and the record after them."""

from pyspark.sql import DataFrame, functions as F

from corrobora import rules
from corrobora.operators.envelopes import PARTY, party_windows, support_windows
from corrobora.operators.spread import totals_as_of

CAUSES = ["MISSING_EXIT", "EXIT_TOO_EARLY", "CONTRIBUTION_GAP"]


def diagnose_rejections(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """For each rejected claim, the blocking findings already provable when it was filed.

    Findings are counted per day and read as running totals at the filing
    dates, so a member with many claims and many findings is never multiplied
    out. Overlaps cite no dated evidence and are never named.
    """
    rejected = claims.filter(F.lower("status").contains("reject")).withColumnRenamed("filed", "day")
    dated = findings.filter(
        (F.col("severity") == rules.BLOCKING) & F.col("first_evidence").isNotNull()
    ).select("member_key", F.col("first_evidence").alias("day"), *[
        (F.col("kind") == kind).cast("bigint").alias(kind) for kind in CAUSES])
    counts = totals_as_of(dated, rejected, ["member_key"], "day", CAUSES)
    causes = F.array_compact(F.array([F.when(F.col(k) > 0, F.lit(k)) for k in CAUSES]))
    return rejected.join(counts, ["member_key", "day"]).select(
        "member_key", "tracking_id", "form", F.col("day").alias("filed"), "status",
        causes.alias("causes"),
        sum(F.col(k) for k in CAUSES).alias("n_causes"),
        ((F.col("MISSING_EXIT") > 0) | (F.col("EXIT_TOO_EARLY") > 0)).alias("confident"))


def check_proposals(proposals: DataFrame, asserted: DataFrame, days: DataFrame) -> DataFrame:
    """The tests a proposed date must pass, one row per proposal and test.

    ``proposals``: member_key, proposal_id, account_id, proposed, evidence, started. ``days`` is the evidence, by day or as
    ``party_rows``.
    Whether another record covers a date is read from running counts of starts
    minus ends, once for the member and once for the account itself.
    """
    account = ["member_key", "account_id"]
    record = asserted.groupBy(*account).agg(
        F.max_by(F.struct("party_key", "doj"), F.struct("ord", "party_key", "doj")).alias("r")
    ).select(*account, "r.party_key", "r.doj")
    windows = party_windows if "days" in days.columns else support_windows
    reach = windows(days, asserted_source=None).select(*PARTY, "latest")

    spans = asserted.filter(F.col("doj").isNotNull() & (
        F.col("doe").isNull() | (F.col("doe") >= F.col("doj"))))
    edges = spans.select(*account, F.explode(F.array_compact(F.array(
        F.struct(F.col("doj").alias("day"), F.lit(1).alias("covering")),
        F.when(F.col("doe").isNotNull(), F.struct(
            F.date_add("doe", 1).alias("day"), F.lit(-1).alias("covering"))),
    ))).alias("e")).select(*account, "e.*")
    asks = proposals.select(*account, F.col("proposed").alias("day"))
    by_member = totals_as_of(edges, asks, ["member_key"], "day", ["covering"]).withColumnRenamed(
        "covering", "by_all")
    by_account = totals_as_of(edges, asks, account, "day", ["covering"]).withColumnRenamed(
        "covering", "by_own")

    joined = (
        proposals.withColumn("day", F.col("proposed"))
        .join(record, account, "left").join(reach, PARTY, "left")
        .join(by_member, ["member_key", "day"], "left")
        .join(by_account, [*account, "day"], "left")
    )

    def check(name, ok):
        return F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"))

    checks = F.array_compact(F.array(
        check("supported by evidence", F.col("proposed") >= F.col("latest")),
        F.when(F.col("doj").isNotNull(), check("after joining", F.col("proposed") >= F.col("doj"))),
        check("no overlapping service",
              F.coalesce("by_all", F.lit(0)) <= F.coalesce("by_own", F.lit(0))),
        check("accepted document", F.col("evidence").isin(rules.ACCEPTED_EVIDENCE)),
    ))
    return joined.select(*account, "proposal_id", F.explode(checks).alias("c")).select(
        *account, "proposal_id", "c.*")


def proposal_state(proposals: DataFrame, checks: DataFrame) -> DataFrame:
    """Submitted, returned or ready. Nothing is ever refused."""
    outcome = checks.groupBy("member_key", "proposal_id").agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("outstanding"))
    return proposals.join(outcome, ["member_key", "proposal_id"], "left").select(
        "member_key", "proposal_id", "account_id", "proposed",
        F.when(F.col("passed").isNull(), "submitted")
        .when(F.col("outstanding") > 0, "returned").otherwise("ready").alias("state"),
        F.coalesce("passed", F.lit(0)).alias("passed"),
        F.coalesce("outstanding", F.lit(0)).alias("outstanding"),
        F.date_add("started", rules.CORRECTION_DAYS).alias("due"))


def overlay(asserted: DataFrame, ready: DataFrame) -> DataFrame:
    """The record with ready dates in place; the last ready proposal of an account counts.

    ``ready``: member_key, account_id, proposal_id, proposed and optionally
    field ("doe" unless given, or "doj").
    """
    if "field" not in ready.columns:
        ready = ready.withColumn("field", F.lit("doe"))
    account = ["member_key", "account_id"]
    new_dates = ready.groupBy(*account).agg(
        F.max_by(F.when(F.col("field") == "doe", F.col("proposed")),
                 F.when(F.col("field") == "doe", F.col("proposal_id"))).alias("new_doe"),
        F.max_by(F.when(F.col("field") == "doj", F.col("proposed")),
                 F.when(F.col("field") == "doj", F.col("proposal_id"))).alias("new_doj"))
    return asserted.join(new_dates, account, "left").select(
        "member_key", "party_key", "account_id",
        F.coalesce("new_doj", "doj").alias("doj"), F.coalesce("new_doe", "doe").alias("doe"), "ord")


def gates_cleared(before: DataFrame, after: DataFrame, ready: DataFrame) -> DataFrame:
    """Blocking gates that fail now and no longer fail with the corrections in place."""
    touched = ready.select("member_key").distinct()
    failing = (F.col("status") == "fail") & ~F.col("advisory")
    return (
        before.filter(failing).join(touched, "member_key", "left_semi")
        .join(after.filter(failing), ["member_key", "gate"], "left_anti")
        .select("member_key", "gate")
    )
