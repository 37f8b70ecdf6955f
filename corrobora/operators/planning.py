"""Gates, correction plans, next steps and notifications."""

from pyspark.sql import DataFrame, functions as F

from corrobora import rules
from corrobora.operators.spread import position_in_order
from corrobora.operators.verdicts import severity_rank


def plan_steps(findings: DataFrame, closed: DataFrame = None) -> DataFrame:
    """Steps in filing order. Transfers wait for every date correction of the member.

    ``closed`` lists (member_key, party_key) whose establishment has closed.
    """
    actions = findings.filter(F.col("severity").isin(rules.BLOCKING, rules.OPPORTUNITY))
    late = F.col("kind").isin(rules.SECOND_WAVE_KINDS)
    attested = ~late & F.col("is_closed") & (F.col("route") == rules.JOINT_DECLARATION)
    numbered = position_in_order(
        actions.withColumn("severity_rank", severity_rank()).withColumn("late", late), ["member_key"],
        ["late", "severity_rank", "phase", "ord", "party_key", "kind"], "step_no", totals={"n_first": ~F.col("late")})
    # numbering reads its rows more than once, so what it does not need joins after it
    if closed is None:
        numbered = numbered.withColumn("is_closed", F.lit(False))
    else:
        closed = closed.select("member_key", "party_key").distinct().withColumn(
            "_closed", F.lit(True))
        numbered = numbered.join(closed, ["member_key", "party_key"], "left").withColumn(
            "is_closed", F.coalesce("_closed", F.lit(False)))
    waits = late & (F.col("n_first") > 0)
    return numbered.filter(F.col("member_key").isNotNull()).select(
        "member_key", "step_no", "kind", "party_key", "party_key_2", "route",
        F.when(attested, rules.ATTESTED_DAYS).otherwise(F.col("days")).alias("days"),
        F.when(waits, 2).otherwise(1).alias("wave"),
        F.when(waits, F.col("n_first")).otherwise(0).alias("n_deps"))


def plan_summary(steps: DataFrame, members: DataFrame) -> DataFrame:
    """Serial against parallel time; the second wave starts when all of the first is done."""
    first, second = F.col("wave") == 1, F.col("wave") == 2
    sums = steps.groupBy("member_key").agg(
        F.count(F.lit(1)).alias("steps"), F.max("wave").alias("waves"),
        F.sum("days").alias("serial_days"),
        (F.coalesce(F.max(F.when(first, F.col("days"))), F.lit(0))
         + F.coalesce(F.max(F.when(second, F.col("days"))), F.lit(0))).alias("critical_days"),
        F.coalesce(F.sum(F.when(second, F.col("days"))), F.lit(0)).alias("wasted_days"),
    ).withColumn("saved_days", F.col("serial_days") - F.col("critical_days"))
    return members.select("member_key").join(sums, "member_key", "left").fillna(0)


def next_step(steps: DataFrame, flags: DataFrame, gates: DataFrame) -> DataFrame:
    """The one thing to do now; members with nothing to do keep a null action."""
    own = F.when(F.col("route") == rules.SELF_SERVICE, 0).otherwise(1)
    first_open = steps.filter(F.col("n_deps") == 0).groupBy("member_key").agg(
        F.min_by(F.struct("kind", "party_key", "route"), F.struct(own, "step_no")).alias("s"))
    advisory = advisory_failures(gates).select("member_key").distinct().withColumn(
        "_advisory", F.lit(True))
    checked = F.col("dates_checked")
    return (
        flags.join(first_open, "member_key", "left").join(advisory, "member_key", "left")
        .select(
            "member_key",
            F.when(~checked, "ADD_HISTORY").when(F.col("s").isNotNull(), F.col("s.kind"))
            .when(F.col("_advisory"), "BRING_ACCOUNT_ACROSS").alias("action"),
            F.when(checked, F.col("s.party_key")).alias("party_key"),
            F.when(checked, F.col("s.route")).alias("route"))
    )


def gates(members: DataFrame, findings: DataFrame) -> DataFrame:
    """The pre-settlement checks, one row per member and gate.

    ``members`` needs uan, pan, dob, n_dobs, name_status, dates_checked,
    contributions_checked, likely_orphans and balance. What cannot be seen is
    "unknown" and never counts as a pass.
    """
    blocking = findings.filter(F.col("severity") == rules.BLOCKING).groupBy("member_key").agg(*[
        F.bool_or(F.col("kind") == kind).alias(kind)
        for kind in ("MISSING_EXIT", "EXIT_TOO_EARLY", "SERVICE_OVERLAP", "CONTRIBUTION_GAP")])
    joined = members.join(blocking, "member_key", "left")

    def present(column):
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", "pass").otherwise("unknown")

    def tested(checked, failed):
        return (F.when(~F.col(checked), "unknown")
                .when(F.coalesce(failed, F.lit(False)), "fail").otherwise("pass"))

    unseen = F.lit("unknown")
    status = {
        "G01": present("uan"),
        "G02": unseen,
        "G03": present("pan"),
        "G04": unseen,
        "G05": unseen,
        "G06": F.coalesce("name_status", unseen),
        "G07": F.when(F.col("n_dobs") > 1, "fail").when(F.col("dob").isNotNull(), "pass")
                .otherwise("unknown"),
        "G08": tested("dates_checked", F.col("MISSING_EXIT")),
        "G09": tested("dates_checked", F.col("EXIT_TOO_EARLY")),
        "G10": tested("dates_checked", F.col("SERVICE_OVERLAP")),
        "G11": tested("dates_checked", F.col("likely_orphans") > 0),
        "G12": tested("contributions_checked", F.col("CONTRIBUTION_GAP")),
        "G13": F.when(F.col("dates_checked"), "pass").otherwise("unknown"),
        "G14": F.when(
            F.coalesce("balance", F.lit(0)) <= F.lit(rules.AUTO_SETTLE_CEILING).cast("decimal(18,2)"),
            "pass").otherwise("fail"),
    }
    rows = F.array([
        F.struct(F.lit(code).alias("gate"), value.alias("status"),
                 F.lit(code == "G11").alias("advisory"))
        for code, value in status.items()])
    return joined.select("member_key", F.explode(rows).alias("g")).select("member_key", "g.*")


def gate_summary(gate_rows: DataFrame) -> DataFrame:
    """Outcomes per member."""
    def n(condition):
        return F.count_if(condition)

    failed = F.col("status") == "fail"
    return gate_rows.groupBy("member_key").agg(
        n(F.col("status") == "pass").alias("passed"), n(failed).alias("failed"),
        n(F.col("status") == "unknown").alias("unknown"),
        n(failed & ~F.col("advisory")).alias("blocking_gates"),
        n(failed & F.col("advisory")).alias("advisory_gates"))


def blocking_failures(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.filter((F.col("status") == "fail") & ~F.col("advisory"))


def advisory_failures(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.filter((F.col("status") == "fail") & F.col("advisory"))


def notification_events(summary, plans, exits, claims, as_of) -> DataFrame:
    """What each member would be told, and when."""
    blocking = (
        summary.filter(F.col("blocking_gates") > 0)
        .join(plans.select("member_key", "critical_days"), "member_key")
        .select("member_key", F.lit(as_of).alias("on_date"), F.lit("Action needed").alias("event"),
                F.lit(None).cast("string").alias("subject"),
                F.col("blocking_gates").alias("figure"),
                F.col("critical_days").cast("bigint").alias("days"),
                F.lit(None).cast("date").alias("opens_on"))
    )
    exits_open = exits.select(
        "member_key", F.lit(as_of).alias("on_date"),
        F.when(F.col("ready"), "You can fix this").otherwise("Wait").alias("event"),
        F.col("party_key").alias("subject"), F.lit(0).cast("bigint").alias("figure"),
        F.lit(0).cast("bigint").alias("days"), F.col("wait_until").alias("opens_on"))
    refused = claims.filter(F.lower("status").contains("reject")).select(
        "member_key", F.col("filed").alias("on_date"), F.lit("Rejected").alias("event"),
        F.col("form").alias("subject"), F.lit(0).cast("bigint").alias("figure"),
        F.lit(0).cast("bigint").alias("days"), F.lit(None).cast("date").alias("opens_on"))
    return blocking.unionByName(exits_open).unionByName(refused)
