"""Withdrawal, pension and settlement rules as ordered conditions on a member table."""

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import rules


def _amount(text):
    return F.lit(text).cast("decimal(18,2)")


def withdrawal_estimates(members: DataFrame) -> DataFrame:
    """Tax on withdrawing now. Needs balance, service_months, has_pan."""
    balance, months = F.col("balance"), F.col("service_months")
    rule = (
        F.when(balance <= 0, "no balance")
        .when(months >= rules.TAX_FREE_MONTHS, "five years")
        .when(balance <= _amount(rules.TAX_THRESHOLD), "under threshold")
        .otherwise("taxed")
    )
    rate = F.when(
        F.col("rule") == "taxed",
        F.when(F.col("has_pan"), F.lit(rules.TAX_WITH_PAN)).otherwise(rules.TAX_WITHOUT_PAN)
    ).otherwise("0").cast("decimal(3,2)")
    return (
        members.withColumn("rule", rule)
        .withColumn("tax_rate", rate)
        .withColumn("balance", F.greatest("balance", _amount("0")))
        .withColumn("tax", F.round(F.col("balance") * F.col("tax_rate"), 2).cast("decimal(18,2)"))
        .select("member_key", "rule", "balance", "tax_rate", "tax",
                (F.col("balance") - F.col("tax")).cast("decimal(18,2)").alias("net"),
                F.when(F.col("rule") == "taxed", rules.TAX_FREE_MONTHS - months)
                .otherwise(0).alias("months_to_free"))
    )


def withdrawal_portfolio(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("rule").agg(
        F.count(F.lit(1)).alias("members"), F.sum("balance").alias("balance"),
        F.sum("tax").alias("tax"), F.sum("net").alias("net"))


def pension_estimates(members: DataFrame) -> DataFrame:
    """Monthly pension. Needs service_months; pensionable_salary is capped."""
    months = F.col("service_months")
    salary = F.least(F.col("pensionable_salary"), _amount(rules.PENSION_SALARY_CAP))
    bonus = F.when(months >= rules.LONG_SERVICE_MONTHS,
                   12 * rules.LONG_SERVICE_BONUS_YEARS).otherwise(0)

    def monthly(n_months):
        return F.round(salary * n_months / (12 * rules.PENSION_DIVISOR), 2).cast("decimal(18,2)")

    eligible = months >= rules.PENSION_MIN_MONTHS
    earned = F.greatest(monthly(months + bonus), _amount(rules.PENSION_FLOOR))
    return members.select(
        "member_key", eligible.alias("eligible"),
        F.greatest(rules.PENSION_MIN_MONTHS - months, F.lit(0)).alias("months_short"),
        F.when(eligible, earned).alias("monthly"),
        F.when(eligible, earned).otherwise(
            monthly(F.lit(rules.PENSION_MIN_MONTHS))).alias("at_full_service"))


def settlement_mode(checked: Column, blocking: Column, kyc_risk: Column, want: Column) -> Column:
    return (
        F.when(~checked, "unknown")
        .when(blocking > 0, "blocked")
        .when(kyc_risk | (want > _amount(rules.AUTO_SETTLE_CEILING)), "manual")
        .otherwise("auto")
    )


def settlement_verdicts(members: DataFrame) -> DataFrame:
    """Needs balance, amount (null = all of it), blocking_count, kyc_risk, checked."""
    want = F.coalesce(F.least("amount", "balance"), F.col("balance"))
    mode = settlement_mode(F.col("checked"), F.col("blocking_count"), F.col("kyc_risk"), want)

    def share(part):
        return F.when(F.col("mode") == "auto", F.round(
            F.col("balance") * F.lit(part).cast("decimal(3,2)"), 2)).otherwise(0).cast("decimal(18,2)")

    over = want > _amount(rules.AUTO_SETTLE_CEILING)
    return members.withColumn("mode", mode).select(
        "member_key", "mode",
        ((F.col("mode") == "manual") & ~F.col("kyc_risk") & over).alias("ceiling_applies"),
        share(rules.UPI_SHARE).alias("upi_limit"), share(rules.ATM_SHARE).alias("atm_limit"))


def kyc_items(members: DataFrame) -> DataFrame:
    """P5: what the documents show, one row per item. Needs n_spellings, uan, pan."""
    spellings = F.col("n_spellings")

    def item(name, status):
        return F.struct(F.lit(name).alias("item"), status.alias("status"))

    def seen(column):
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", "ok").otherwise("unknown")

    items = F.array(
        item("Name", F.when(spellings > 1, "risk").when(spellings == 1, "ok").otherwise("unknown")),
        item("UAN", seen("uan")),
        item("PAN", seen("pan")),
        item("Bank account", F.lit("unknown")),
        item("Aadhaar", F.lit("unknown")),
    )
    return members.select("member_key", F.explode(items).alias("i")).select("member_key", "i.*")


def kyc_summary(items: DataFrame) -> DataFrame:
    """No visible risk, and whether anything lies beyond our sight."""
    return items.groupBy("member_key").agg(
        (~F.bool_or(F.col("status") == "risk")).alias("kyc_ready"),
        F.bool_or(F.col("status") == "unknown").alias("kyc_unverified"))


def declaration_route(closed) -> Column:
    """A closed establishment leaves the attested paper route."""
    closed = F.col(closed) if isinstance(closed, str) else closed
    return F.when(closed, "attested").otherwise("online")


def claim_form_status(members: DataFrame) -> DataFrame:
    """P10: needs dates_checked and blocking_gates (blocking gate failures)."""
    blocked = F.col("blocking_gates") > 0
    form_status = (
        F.when(~F.col("dates_checked"), "Not yet known").when(blocked, "Blocked").otherwise("Open"))
    page = (
        F.when(blocked, "rejected").when(~F.col("dates_checked"), "not yet known")
        .otherwise("eligible"))
    return members.select(
        "member_key", F.explode(F.array([F.lit(f) for f in rules.CLAIM_FORMS])).alias("form"),
        form_status.alias("form_status"), page.alias("claim_verdict"))
