"""Accounts that evidence implies but no record mentions."""

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import rules
from corrobora.operators.envelopes import PARTY


def orphan_candidates(observations: DataFrame, orphans: DataFrame) -> DataFrame:
    """Unlinked parties with salary rows: first and last seen, rows, mean salary.

    ``months`` counts salary rows, not distinct months.
    """
    salary = (
        observations.filter(F.col("source") == rules.TAX_SOURCE)
        .groupBy(*PARTY)
        .agg(F.count(F.lit(1)).alias("months"), F.avg("amount").cast("double").alias("gross_monthly"))
    )
    return orphans.select(
        *PARTY, F.col("earliest").alias("first_seen"), F.col("latest").alias("last_seen")
    ).join(salary, PARTY)


def balance_bands(gross: Column, months: Column, years: Column) -> Column:
    """Low and high estimate of an account's balance, with and without interest."""
    def principal(ratio):
        basic = gross * F.lit(ratio)
        employee = basic * F.lit(rules.FUND_RATE)
        pension = F.least(basic, F.lit(rules.PENSION_WAGE_CAP)) * F.lit(rules.PENSION_RATE)
        employer = F.greatest(F.lit(0.0), employee - pension)
        return (employee + employer) * months

    growth = F.pow(F.lit(1.0 + rules.ANNUAL_INTEREST), F.greatest(F.lit(0.0), years))

    def hundreds(value):
        return F.bround(value, -2).cast("bigint")

    low, high = principal(rules.BASIC_RATIO_LOW), principal(rules.BASIC_RATIO_HIGH)
    return F.struct(
        hundreds(low * growth).alias("low"), hundreds(high * growth).alias("high"),
        hundreds(low).alias("principal_low"), hundreds(high).alias("principal_high"),
        F.bround(F.greatest(F.lit(0.0), years), 1).alias("years"))


def assess_orphans(candidates: DataFrame, as_of) -> DataFrame:
    """Is an account likely to exist? ``candidates`` carries the resolved establishment
    (est_name, est_code, covered, coverage_from), null when none was found."""
    years = F.datediff(F.lit(as_of), F.col("last_seen")) / F.lit(rules.DAYS_PER_YEAR)
    unresolved, covered = F.col("est_name").isNull(), F.col("covered")
    verdict = (
        F.when(unresolved, "UNCERTAIN").when(~covered, "UNLIKELY")
        .when(F.col("months") < rules.ORPHAN_MIN_MONTHS, "UNLIKELY").otherwise("LIKELY"))
    reason = (
        F.when(unresolved, "not in the register").when(~covered, "not covered")
        .when(F.col("months") < rules.ORPHAN_MIN_MONTHS, "too short").otherwise("covered, unlinked"))
    likely = F.col("verdict") == "LIKELY"
    bands = balance_bands(F.col("gross_monthly"), F.col("months"), years)
    return (
        candidates.withColumn("verdict", verdict)
        .withColumn("reason", reason)
        .withColumn("b", F.when(likely, bands))
        .select(*PARTY, "first_seen", "last_seen", "months", "gross_monthly", "est_name", "est_code",
                "verdict", "reason",
                F.coalesce((F.col("verdict") != "UNCERTAIN") & covered
                           & (F.col("first_seen") < F.col("coverage_from")),
                           F.lit(False)).alias("before_coverage"),
                (likely & (years > rules.INOPERATIVE_YEARS)).alias("inoperative"), "b.*")
    )


def recovery_steps(assessed: DataFrame) -> DataFrame:
    """Ordered steps for an account worth tracing."""
    def step(action, blocked_by=None):
        return F.struct(F.lit(action).alias("action"),
                        F.lit(blocked_by).cast("string").alias("blocked_by"))

    common = [
        step("TRACE_ID"),
        step("CHECK_OWN_PAPERS"),
        step("FILE_TRANSFER", "ID_FOUND"),
        step("ESCALATE", "TRACE_FAILED"),
    ]
    confirm = step("CONFIRM_NAME")
    likely = F.array(*common)
    uncertain = F.array(confirm, *common)
    numbered = (
        F.when(F.col("verdict") == "LIKELY", F.transform(
            likely, lambda s, i: F.struct((i + 1).alias("step_no"), s["action"].alias("action"),
                                          s["blocked_by"].alias("blocked_by"))))
        .when(F.col("verdict") == "UNCERTAIN", F.transform(
            uncertain, lambda s, i: F.struct(i.alias("step_no"), s["action"].alias("action"),
                                             s["blocked_by"].alias("blocked_by"))))
    )
    return assessed.select(*PARTY, "verdict", F.explode(numbered).alias("s")).select(
        *PARTY, "verdict", "s.*")
