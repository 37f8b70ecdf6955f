"""Order, status and audit of findings."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules
from corrobora.operators.spread import position_in_order


def severity_rank(severity="severity"):
    column = F.col(severity)
    ranked = F.lit(None).cast("int")
    for name, rank in rules.SEVERITY_RANK.items():
        ranked = F.when(column == name, rank).otherwise(ranked)
    return ranked


def order_findings(findings: DataFrame) -> DataFrame:
    """Position of each finding within its member, worst severity first."""
    return position_in_order(
        findings.withColumn("severity_rank", severity_rank()), ["member_key"],
        ["severity_rank", "phase", "ord", "party_key", "kind"], "finding_no")


def claim_status(findings: DataFrame, members: DataFrame, history: DataFrame = None) -> DataFrame:
    """Outcome per member; members without findings are kept.

    ``history`` (one row or more per member whose record was supplied) turns
    "nothing found" into "not checked" for everybody else.
    """
    counts = findings.groupBy("member_key").agg(
        F.count_if(F.col("severity") == rules.BLOCKING).alias("blocking_count"),
        F.count(F.lit(1)).alias("finding_count"))
    out = members.join(counts, "member_key", "left").select(
        "member_key",
        F.coalesce("blocking_count", F.lit(0)).alias("blocking_count"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"))
    clean = F.lit("LIKELY_TO_SETTLE")
    if history is not None:
        known = history.select("member_key").distinct().withColumn("_known", F.lit(True))
        out = out.join(known, "member_key", "left")
        clean = F.when(F.col("_known"), clean).otherwise("NOT_CHECKED")
    return out.select(
        "member_key", "blocking_count", "finding_count",
        F.when(F.col("blocking_count") > 0, "WILL_BE_REJECTED").otherwise(clean).alias("claim_status"))


def suppress_without_history(findings: DataFrame, history: DataFrame) -> DataFrame:
    """An unlinked account is no finding for a member whose record was never supplied."""
    known = history.select("member_key").distinct()
    return findings.filter(F.col("kind") != "ORPHAN_ACCOUNT").unionByName(
        findings.filter(F.col("kind") == "ORPHAN_ACCOUNT").join(known, "member_key", "left_semi"))


def audit(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows that break the promise that every finding can be put right. Must be empty."""
    lacking = findings.select(
        "member_key", "kind",
        F.array_compact(F.array(
            F.when(F.coalesce(F.col("fix"), F.lit("")) == "", "no fix"),
            F.when(F.coalesce(F.col("route"), F.lit("")) == "", "no route"),
            F.when(~F.coalesce(F.col("severity").isin(*rules.SEVERITY_RANK), F.lit(False)),
                   "unknown severity"),
        )).alias("broken"))
    odd_status = statuses.select(
        "member_key", F.lit(None).cast("string").alias("kind"),
        F.array_compact(F.array(F.when(
            ~F.coalesce(F.col("claim_status").isin(
                "WILL_BE_REJECTED", "LIKELY_TO_SETTLE", "NOT_CHECKED"), F.lit(False)),
            "unknown status"))).alias("broken"))
    return lacking.unionByName(odd_status).select("member_key", "kind", F.explode("broken").alias("broken"))


def blocking_per_party(findings: DataFrame, parties: DataFrame) -> DataFrame:
    """Blocking findings charged to every party they name; parties with none are kept."""
    charged = (
        findings.filter(F.col("severity") == rules.BLOCKING)
        .select("member_key", F.explode(F.array_compact(
            F.array("party_key", "party_key_2"))).alias("party_key"))
        .groupBy("member_key", "party_key").agg(F.count(F.lit(1)).alias("blocking"))
    )
    return parties.join(charged, ["member_key", "party_key"], "left").select(
        "member_key", "party_key", F.coalesce("blocking", F.lit(0)).alias("blocking"))


def checked_flags(days: DataFrame, history: DataFrame, members: DataFrame) -> DataFrame:
    """Which questions the evidence can answer, per member.

    ``days`` is a row per day of evidence with its ``source``, or a row per party with its ``sources``.
    """
    if "sources" in days.columns:
        parties = days.select("member_key", *[
            F.coalesce(F.array_contains("sources", source), F.lit(False)).alias(name)
            for name, source in (("fund", rules.FUND_SOURCE), ("tax", rules.TAX_SOURCE))])
    else:
        parties = days.groupBy("member_key", "party_key").agg(
            F.bool_or(F.col("source") == rules.FUND_SOURCE).alias("fund"),
            F.bool_or(F.col("source") == rules.TAX_SOURCE).alias("tax"))
    both = parties.groupBy("member_key").agg(F.bool_or(F.col("fund") & F.col("tax")).alias("both"))
    return (
        members.join(both, "member_key", "left")
        .join(history.select("member_key").distinct().withColumn("_known", F.lit(True)),
              "member_key", "left")
        .select("member_key",
                F.coalesce("_known", F.lit(False)).alias("dates_checked"),
                F.coalesce("both", F.lit(False)).alias("contributions_checked"))
    )


def timeline_only(members: DataFrame, passbooks: DataFrame, history: DataFrame,
                  deductors: DataFrame) -> DataFrame:
    """Members with a tax statement and nothing to test it against."""
    def holds(df, name):
        return df.select("member_key").distinct().withColumn(name, F.lit(True))

    def held(name):
        return F.coalesce(name, F.lit(False))

    return (
        members.select("member_key")
        .join(holds(passbooks, "passbook"), "member_key", "left")
        .join(holds(history, "history"), "member_key", "left")
        .join(holds(deductors, "statement"), "member_key", "left")
        .select("member_key", (held("statement") & ~held("passbook") & ~held("history"))
                .alias("timeline_only"))
    )
