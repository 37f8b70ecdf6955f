"""Passbooks as tables."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules
from corrobora.functions.dates import dmy, wage_month
from corrobora.functions.text import amounts, blank_out, first_match, from_end, strip
from corrobora.session import cut_lineage
from corrobora.sources.corpus import DOC, lines_and_markers


# any of these makes a line worth reading; everything else never leaves the scan
WORTH_READING = (
    r"(?i)member\s+(id|name)|establishment|\buan\b|date\s+of\s+(birth|joining)|closing\s+balance"
    r"|[A-Z]{5}\d{12}|^\s*(uan|[A-Z]{3}-\d{4}\b)")


def _read_lines(documents: DataFrame) -> DataFrame:
    """What each line could contribute, before any rule claims it."""
    line, low = F.col("line"), F.lower("line")
    name = F.regexp_replace(F.regexp_extract("line", rules.ESTABLISHMENT, 2), r"^[ \-/]+|[ \-/]+$", "")
    live = F.regexp_extract("line", rules.PASSBOOK_LIVE_ROW, 4)
    worth = lines_and_markers(documents).filter((F.col("line_no") < 0) | line.rlike(WORTH_READING)).select(
        *DOC, "line_no", strip("line").alias("line"))
    read = worth.select(
        *DOC, "line_no", "line",
        F.regexp_extract_all("line", F.lit(rules.ACCOUNT_ID), F.lit(1)).alias("ids"),
        F.element_at(F.split("line", r"\s+"), -1).alias("last_word"),
        dmy(first_match(line, rules.DMY)).alias("day"),
        low.startswith("member id").alias("id_line"), low.startswith("uan").alias("uan_line"),
        low.startswith("member name").alias("name_line"),
        low.startswith("date of joining").alias("doj_line"),
        low.contains("establishment").alias("est_line"),
        F.when(low.contains("establishment"), F.nullif(name, F.lit(""))).alias("est_name"),
        F.when(low.contains("establishment"), first_match(line, rules.ESTABLISHMENT)).alias("est_code"),
        F.when(low.contains("uan"), first_match(line, rules.UAN_ANYWHERE)).alias("uan_found"),
        low.rlike(r"date\s+of\s+birth").alias("dob_mentioned"),
        low.rlike(r"date\s+of\s+joining").alias("doj_mentioned"),
        F.when(low.rlike(r"closing\s+balance"), amounts(blank_out(line, rules.DMY))).alias("closing_sums"),
        line.rlike(rules.PASSBOOK_SIMPLE_ROW).alias("row_line"),
        F.when(line.rlike(rules.PASSBOOK_SIMPLE_ROW), live).alias("live"))
    named = (F.length("est_name") >= 3) & ~F.lower("est_name").startswith("id")
    sums = F.when(F.col("live") != "", amounts("live")).when(
        F.col("row_line"),
        amounts(F.regexp_replace("line", rules.PASSBOOK_SIMPLE_ROW, ""), rules.PLAIN_NUMBER))
    return read.withColumn("est_name", F.when(named, F.col("est_name"))).withColumn("sums", sums).drop("live")


def _claimed(lines: DataFrame) -> DataFrame:
    """Give each line to the first rule that claims it; what is left is ``free``.

    A member-id line with an id, and every establishment line up to the one
    that yields a name, are read for nothing else. The account id of a document
    is the last one stated on a member-id line, else the first one printed.
    """
    doc = Window.partitionBy(*DOC)
    so_far = doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_id = F.col("id_line") & (F.size("ids") > 0)
    est_open = F.col("est_line") & ~by_id
    by_est = est_open & (F.col("found_at").isNull() | (F.col("line_no") <= F.col("found_at")))
    first_id = F.get("ids", F.lit(0))
    return (
        lines.withColumn("found_at", F.min(
            F.when(est_open & F.col("est_name").isNotNull(), F.col("line_no"))).over(whole))
        .withColumn("claim", F.when(by_id, "id").when(by_est, "est").when(F.col("uan_line"), "uan")
                    .when(F.col("name_line"), "name").when(F.col("doj_line"), "doj").otherwise("free"))
        .withColumn("stated_id", F.when(F.col("id_line"), F.coalesce(first_id, F.col("last_word"))))
        .withColumn("stated_so_far", F.last("stated_id", ignorenulls=True).over(so_far))
        .withColumn("free_id", F.first(
            F.when(F.col("claim") == "free", first_id), ignorenulls=True).over(whole))
        .withColumn("account_id", F.coalesce(
            F.last("stated_id", ignorenulls=True).over(whole), "free_id"))
    )


def passbook_tables(documents: DataFrame):
    """(passbook_heads, contributions) of all passbook documents.

    The read lines are checkpointed: both tables come from them, and they are
    far smaller than the text. Among them is a row for each document, so the
    documents themselves are read once.
    """
    lines = cut_lineage(_claimed(_read_lines(documents)))

    def said(value, claim, when=None):
        condition = F.col("claim") == claim
        return F.when(condition if when is None else condition & when, value)

    def first(column):
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias(column)

    def last(column):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias(column)

    closing = F.struct(*[from_end(F.col("closing_sums"), n).alias(part) for n, part in (
        (3, "employee"), (2, "employer"), (1, "pension"))])
    facts = lines.select(
        *DOC, "line_no", "account_id",
        said(F.col("est_name"), "est").alias("establishment"),
        said(F.col("est_code"), "est").alias("est_code"),
        said(F.col("last_word"), "uan", F.col("last_word").rlike(r"^\d+$")).alias("uan_stated"),
        said(F.col("uan_found"), "free").alias("uan_free"),
        said(F.nullif(F.regexp_extract("line", r"^\S+\s+\S+\s+(.*)$", 1), F.lit("")), "name").alias("name"),
        said(F.col("day"), "doj").alias("doj_stated"),
        said(F.col("day"), "free", F.col("doj_mentioned")).alias("doj_free"),
        said(F.col("day"), "free", F.col("dob_mentioned")).alias("dob"),
        said(closing, "free", F.size("closing_sums") >= 3).alias("closing"),
        said(F.array_remove("ids", F.coalesce("stated_so_far", "free_id")), "free").alias("others"))
    heads = facts.groupBy(*DOC).agg(
        F.first("account_id").alias("account_id"), first("establishment"), first("est_code"),
        last("uan_stated"), first("uan_free"), last("name"), last("doj_stated"), first("doj_free"),
        first("dob"), last("closing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("other_ids"))
    heads = heads.select(
        *DOC, "account_id", "establishment", "est_code",
        F.coalesce("doj_stated", "doj_free").alias("doj"), "dob",
        F.coalesce("uan_stated", "uan_free").alias("uan"), "name", "closing", "other_ids")

    has_row = F.size("sums") >= 2
    contributions = lines.filter((F.col("claim") == "free") & F.col("row_line")).select(
        *DOC, "account_id",
        wage_month(F.regexp_extract("line", rules.PASSBOOK_SIMPLE_ROW, 1)).alias("month"),
        F.when(has_row, F.get("sums", F.lit(0))).alias("employee"),
        F.when(has_row, F.get("sums", F.lit(1))).alias("employer"),
        F.when(has_row, F.coalesce(F.get("sums", F.lit(2)), F.lit(0).cast("decimal(18,2)"))).alias("pension"),
        "line_no").filter(F.col("month").isNotNull())
    return heads, contributions
