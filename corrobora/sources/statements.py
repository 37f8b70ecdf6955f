"""Tax statements as tables: a header line opens a block, detail lines belong to the last one."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules
from corrobora.functions.dates import dmony, dmy
from corrobora.functions.text import amounts, blank_out, from_end, money, strip
from corrobora.session import cut_lineage
from corrobora.sources.corpus import DOC, explode_lines


def _read_lines(lines: DataFrame) -> DataFrame:
    """S4 and S5 in one pass: each line is read by the layout of its document.

    Tabular: blanks between columns, dates as dd-Mon-yyyy, a detail line needs
    five numbers besides its dates. Caret: fields between carets, and only tax
    sections count as detail.
    """
    caret, line, low = F.col("is_caret"), F.col("line"), F.lower("line")
    heading = F.ltrim(low).startswith("sr. no.") | low.startswith("part ")
    has_tan = line.rlike(rules.TAN_INSIDE) & line.rlike(rules.TAN)
    tabular = ~heading & ((line.rlike(r"^\s*\d+\s") & line.rlike(rules.DMONY)) | has_tan)
    zero = F.lit(0).cast("decimal(18,2)")
    zeroth, third = F.lit(0), F.lit(2)

    def first(pattern):
        return F.get(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), zeroth)

    def fields_like(pattern, shaped):
        return F.filter("fields", lambda x: shaped(x) & x.rlike(pattern))

    def long(*lengths):
        return lambda x: F.length(x).isin(*lengths)

    split = lines.filter(F.when(caret, line.contains("^")).otherwise(tabular)).select(
        *DOC, "line_no", "line", "is_caret",
        F.when(caret, F.transform(F.split("line", r"\^", -1), strip)).alias("fields"),
        F.when(~caret & line.rlike(rules.TAN_INSIDE), first(rules.TAN)).alias("line_tan"))
    read = split.select(
        *DOC, "line_no", "line", "is_caret", "fields",
        F.when(caret, F.get(fields_like(r"^[A-Z]{4}\d{5}[A-Z]$", long(10)), zeroth)).otherwise(
            F.col("line_tan")).alias("tan"),
        F.when(caret, F.transform(fields_like(
            rules.CARET_MONEY, lambda x: F.substring(x, -3, 1) == "."), money))
        # a header is read after its TAN, a detail line without its dates
        .when(F.col("line_tan").isNotNull(),
              amounts(F.regexp_extract("line", rules.TAN + r"(.*)$", 2), rules.PLAIN_NUMBER))
        .otherwise(amounts(blank_out(line, rules.DMONY), rules.PLAIN_NUMBER)).alias("sums"),
        F.when(caret, F.get(F.filter(F.transform(
            fields_like(rules.CARET_DATE, long(10, 11)), lambda x: F.coalesce(dmy(x), dmony(x))),
            lambda d: d.isNotNull()), zeroth))
        .when(F.col("line_tan").isNull(), dmony(first(rules.DMONY))).alias("txn_date"))

    sums, n = F.col("sums"), F.size("sums")
    is_header = F.col("tan").isNotNull() & (~caret | (n >= 2))
    at = F.array_position("fields", F.col("tan"))
    before = strip(F.regexp_extract("line", r"^(.*?)" + rules.TAN, 1))
    section = F.when(caret, F.get("fields", third)).otherwise(
        F.floor(F.get("sums", F.lit(1))).cast("bigint").cast("string"))
    detail = F.when(caret, F.col("txn_date").isNotNull() & (n >= 3)
                    & F.get("fields", third).rlike(rules.CARET_SECTION)).otherwise(n >= 5)

    def total(position, from_right):
        plain = F.get("sums", F.lit(position))
        return F.when(caret & (n >= 3), from_end(sums, from_right)).otherwise(F.coalesce(plain, zero))

    return read.select(
        *DOC, "line_no", is_header.alias("is_header"),
        F.when(~is_header, None).when(caret, F.when(at > 1, F.get("fields", (at - 2).cast("int"))).otherwise(""))
        .otherwise(strip(F.regexp_replace(before, r"^\d+\s+", ""))).alias("name"),
        "tan", total(0, 3).alias("total_paid"), total(1, 2).alias("total_tds"),
        section.alias("section"), "txn_date", from_end(sums, 3).alias("amount_paid"),
        from_end(sums, 2).alias("tax_deducted"), (is_header | detail).alias("complete"))


def statement_tables(documents: DataFrame):
    """(deductors, transactions) of all statement documents.

    The read lines are checkpointed: both tables come from them, and they are
    far smaller than the text.
    """
    lines = explode_lines(documents.withColumn("is_caret", F.col("text").contains("^")))
    so_far = (
        Window.partitionBy(*DOC).orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = cut_lineage(_read_lines(lines).withColumn(
        "block_no", F.sum(F.col("is_header").cast("bigint")).over(so_far)
    ).filter("block_no > 0 and complete"))
    deductors = carried.filter("is_header").select(
        *DOC, "block_no", "name", "tan", "total_paid", "total_tds")
    transactions = carried.filter(~F.col("is_header")).select(
        *DOC, "block_no", "line_no", "section", "txn_date", "amount_paid", "tax_deducted")
    return deductors, transactions
