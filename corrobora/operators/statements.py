"""Header against detail, and files of several years merged into one account."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules

BLOCK = ["member_key", "doc_id", "block_no"]


def is_salary(section="section"):
    """Salary sections; a document without sections counts as salary."""
    column = F.col(section)
    return column.isNull() | F.upper(F.trim(column)).isin(rules.SALARY_SECTIONS)


def salary_only(transactions: DataFrame) -> DataFrame:
    return transactions.filter(is_salary())


def verify_statements(deductors: DataFrame, transactions: DataFrame,
                      tolerance=rules.STATEMENT_TOLERANCE) -> DataFrame:
    """A1: blocks whose detail rows do not add up to the header, per measure.

    Run on the blocks as read, before years are merged.
    """
    detail = transactions.groupBy(*BLOCK).agg(
        F.sum("amount_paid").alias("paid"), F.sum("tax_deducted").alias("tax"))
    zero = F.lit(0).cast("decimal(18,2)")
    measures = F.array(*[
        F.struct(F.lit(name).alias("measure"),
                 F.coalesce(detail_column, zero).cast("decimal(18,2)").alias("detail_sum"),
                 header.alias("header_total"))
        for name, detail_column, header in [
            ("paid", F.col("paid"), F.col("total_paid")), ("tax", F.col("tax"), F.col("total_tds"))]])
    return (
        deductors.join(detail, BLOCK, "left")
        .select(*BLOCK, "tan", F.explode(measures).alias("m")).select(*BLOCK, "tan", "m.*")
        .filter(F.abs(F.col("detail_sum") - F.col("header_total"))
                > F.lit(tolerance).cast("decimal(18,2)"))
        .withColumn("difference", (F.col("detail_sum") - F.col("header_total")).cast("decimal(18,2)"))
    )


def merge_deductors(deductors: DataFrame) -> DataFrame:
    """A2: one row per member and TAN; the longest name wins, the first one on ties."""
    order = F.struct("doc_id", "block_no")
    by_name = deductors.groupBy("member_key", "tan", "name").agg(
        F.min(order).alias("_at"), F.sum("total_paid").alias("total_paid"),
        F.sum("total_tds").alias("total_tds"), F.count(F.lit(1)).alias("blocks"))
    best = by_name.groupBy("member_key", "tan").agg(
        F.min("_at").alias("first_block"),
        F.sum("total_paid").cast("decimal(18,2)").alias("total_paid"),
        F.sum("total_tds").cast("decimal(18,2)").alias("total_tds"),
        F.sum("blocks").alias("blocks"),
        F.min_by("name", F.struct(-F.length("name"), F.col("_at"))).alias("name"))
    return best.select("member_key", "tan", "name", "total_paid", "total_tds", "blocks",
                       F.col("first_block.doc_id").alias("first_doc"),
                       F.col("first_block.block_no").alias("first_block"))


def merged_transactions(deductors: DataFrame, transactions: DataFrame) -> DataFrame:
    """A2: every year's rows under their TAN."""
    return transactions.drop("tan").join(deductors.select(*BLOCK, "tan"), BLOCK)


def merge_passbooks(heads: DataFrame, contributions: DataFrame) -> DataFrame:
    """A3: one row per account from files of several years.

    The file with the latest month speaks for the account: its closing balance
    already contains the earlier years. Without one the rows are summed. Files
    without an account id stay apart.
    """
    account = ["member_key", "account_key"]
    per_file = contributions.groupBy("member_key", "doc_id").agg(F.max("month").alias("_last_month"))
    files = (
        heads.join(per_file, ["member_key", "doc_id"], "left")
        .withColumn("account_key", F.coalesce("account_id", F.concat(F.lit("doc:"), "doc_id")))
        .withColumn("_rank", F.struct(
            F.coalesce("_last_month", F.lit("0001-01-01").cast("date")).alias("month"), "file_ord"))
    )

    def first_known(column):
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_rank"))).alias(column)

    header = files.groupBy(*account).agg(
        F.max_by(F.struct("account_id", "name", "uan", "dob", "est_code", "closing"),
                 "_rank").alias("latest"),
        first_known("establishment"), first_known("doj"),
        F.count(F.lit(1)).alias("files"), F.min("file_ord").alias("first_file"))
    owned = contributions.join(
        files.select("member_key", "doc_id", "account_key"), ["member_key", "doc_id"])
    by_month = owned.groupBy(*account, "month").agg(
        F.sum(F.col("employee") + F.col("employer")).alias("fund"),
        F.sum("pension").alias("pension"), F.count("employee").alias("rows"))
    sums = by_month.groupBy(*account).agg(
        F.count(F.lit(1)).alias("months"), F.min("month").alias("first_month"),
        F.max("month").alias("last_month"), F.sum("fund").alias("fund"),
        F.sum("pension").alias("row_pension"), F.sum("rows").alias("rows"))
    closing = F.col("latest.closing")
    zero = F.lit(0).cast("decimal(18,2)")
    return header.join(sums, account, "left").select(
        *account, "latest.account_id", "establishment", "latest.est_code", "latest.name",
        "latest.uan", "latest.dob", "doj", "files", "first_file",
        F.coalesce("months", F.lit(0)).alias("months"), F.coalesce("rows", F.lit(0)).alias("rows"),
        "first_month", "last_month",
        F.when(closing.isNotNull(), closing["employee"] + closing["employer"])
        .otherwise(F.coalesce("fund", zero)).cast("decimal(18,2)").alias("balance"),
        F.when(closing.isNotNull(), closing["pension"])
        .otherwise(F.coalesce("row_pension", zero)).cast("decimal(18,2)").alias("pension"),
    )


def related_ids(heads: DataFrame) -> DataFrame:
    """Account ids printed in a file that are not one of the member's own accounts."""
    printed = heads.select("member_key", F.explode("other_ids").alias("related_id")).distinct()
    own = heads.filter(F.col("account_id").isNotNull()).select(
        "member_key", F.col("account_id").alias("related_id")).distinct()
    return printed.join(own, ["member_key", "related_id"], "left_anti")


def account_list(accounts: DataFrame, assessed: DataFrame) -> DataFrame:
    """U4: accounts as a member would know them: those on file and those likely to exist."""
    on_file = accounts.select(
        "member_key", F.col("account_key").alias("account"), F.lit(False).alias("orphan"),
        F.col("months").cast("bigint").alias("months"), "balance", "pension")
    implied = assessed.filter(F.col("verdict") == "LIKELY").select(
        "member_key", F.col("party_key").alias("account"), F.lit(True).alias("orphan"),
        F.col("months").cast("bigint").alias("months"),
        F.lit(0).cast("decimal(18,2)").alias("balance"),
        F.lit(0).cast("decimal(18,2)").alias("pension"))
    return on_file.unionByName(implied)


def member_totals(members: DataFrame, accounts: DataFrame, assessed: DataFrame) -> DataFrame:
    """A10: what a member holds on file, and the least an unlinked account may hold."""
    held = accounts.groupBy("member_key").agg(
        F.sum("balance").cast("decimal(18,2)").alias("balance"),
        F.sum("pension").cast("decimal(18,2)").alias("pension"),
        F.sum("months").alias("service_months"))
    forgotten = assessed.groupBy("member_key").agg(F.sum("low").alias("forgotten_low"))
    return (
        members.select("member_key").join(held, "member_key", "left")
        .join(forgotten, "member_key", "left")
        .fillna(0, ["service_months", "forgotten_low"])
        .select("member_key",
                F.coalesce("balance", F.lit(0)).cast("decimal(18,2)").alias("balance"),
                F.coalesce("pension", F.lit(0)).cast("decimal(18,2)").alias("pension"),
                "service_months",
                (F.col("service_months") >= rules.PENSION_MIN_MONTHS).alias("pension_eligible"),
                "forgotten_low")
    )


def worklist(deductors: DataFrame, transactions: DataFrame, history: DataFrame) -> DataFrame:
    """Where and when a member was paid, for members whose record was not supplied."""
    names = merge_deductors(deductors).select("member_key", "tan", "name")
    unchecked = merged_transactions(deductors, salary_only(transactions)).join(
        history.select("member_key").distinct(), "member_key", "left_anti")
    return (
        unchecked.groupBy("member_key", "tan")
        .agg(F.min("txn_date").alias("first_paid"), F.max("txn_date").alias("last_paid"),
             F.count(F.lit(1)).alias("salary_rows"))
        .join(names, ["member_key", "tan"])
    )


def ingest_summary(members, deductors, transactions, problems, accounts, history, bank) -> DataFrame:
    """What was read for each member.

    ``accounts`` holds one row per file read (member_key, months);
    ``bank`` one row per transaction with is_salary.
    """
    per_block = transactions.groupBy(*BLOCK).agg(
        F.count_if(is_salary()).alias("salary"), F.count_if(~is_salary()).alias("other"))
    statements = (
        deductors.select(*BLOCK, "tan").join(per_block, BLOCK, "left")
        .groupBy("member_key", "tan").agg(F.sum("salary").alias("salary"), F.sum("other").alias("other"))
        .groupBy("member_key").agg(
            F.count_if(F.col("salary") > 0).alias("employers"),
            F.sum("salary").alias("salary_rows"), F.sum("other").alias("ignored_rows"))
    )
    parts = [
        statements,
        problems.groupBy("member_key").agg(F.count(F.lit(1)).alias("problems")),
        accounts.groupBy("member_key").agg(
            F.count(F.lit(1)).alias("files"), F.sum("months").alias("months")),
        history.groupBy("member_key").agg(F.count(F.lit(1)).alias("history_rows")),
        bank.groupBy("member_key").agg(
            F.count(F.lit(1)).alias("bank_rows"), F.count_if("is_salary").alias("salary_credits")),
    ]
    out = members.select("member_key")
    for part in parts:
        out = out.join(part, "member_key", "left")
    return out.fillna(0)


def last_contributions(contributions: DataFrame, n=5) -> DataFrame:
    """The n latest contributions of each member over all accounts."""
    latest = Window.partitionBy("member_key").orderBy(
        F.desc("month"), F.asc("account_id"), F.asc("doc_id"), F.asc("line_no"))
    # filtering on the rank lets Spark cut each task to n rows per member before the shuffle
    return (
        contributions.filter(F.col("employee").isNotNull())
        .withColumn("position", F.row_number().over(latest))
        .filter(F.col("position") <= n)
    )


def passbook_flags(accounts: DataFrame, asserted: DataFrame) -> DataFrame:
    """Contributions after the recorded exit, or no exit recorded."""
    record = asserted.groupBy("member_key", "account_id").agg(F.min_by("doe", F.struct("ord", "doe")).alias("doe"))
    flag = (
        F.when(F.col("last_month") > F.col("doe"), "contributions after exit")
        .when(F.col("last_month").isNotNull() & F.col("doe").isNull(), "no exit recorded")
    )
    return accounts.join(record, ["member_key", "account_id"], "left").select(
        "member_key", "account_id", "last_month", "doe", flag.alias("flag"))


def to_parties(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows carried to the party their id belongs to; unmatched rows are dropped.

    ``links``: member_key, id, party_key.
    """
    return rows.join(
        links.select("member_key", F.col("id").alias(key), "party_key"), ["member_key", key])


def observations_of(transactions: DataFrame, months: DataFrame, credits: DataFrame) -> DataFrame:
    """Salary rows, contribution months and attributed credits as one table of observations.

    ``transactions`` and ``credits`` carry party_key and ord; ``months`` is one
    row per account and month. A row without a date is no observation; it stays
    in the table it was read into.
    """
    tax = salary_only(transactions).select(
        "member_key", "party_key", F.col("txn_date").alias("obs_date"),
        F.lit(rules.TAX_SOURCE).alias("source"), F.col("amount_paid").alias("amount"),
        F.lit("salary TDS").alias("note"), "ord")
    fund = months.select(
        "member_key", "party_key", F.col("month").alias("obs_date"),
        F.lit(rules.FUND_SOURCE).alias("source"), F.lit(None).cast("decimal(18,2)").alias("amount"),
        F.lit("").alias("note"), "ord")
    bank = credits.select(
        "member_key", "party_key", F.col("txn_date").alias("obs_date"),
        F.lit(rules.BANK_SOURCE).alias("source"), "amount",
        F.lit("salary credit").alias("note"), "ord")
    return tax.unionByName(fund).unionByName(bank).filter(F.col("obs_date").isNotNull())
