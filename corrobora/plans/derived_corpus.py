"""Documents rendered from the order tables, in every layout the sources read.

One document per order and layout, so a document holds at most the order's
lines. Reading them back must give the tables they were rendered from.
"""

from pyspark.sql import DataFrame, functions as F

from corrobora.plans import adapters


def _lines(spark, folder, status=None) -> DataFrame:
    """Order lines; with ``status``, of the orders in that status only, before anything is rendered."""
    lines = adapters._lines(spark, folder)
    return (lines if status is None else lines.filter(F.col("o_orderstatus") == status)).select(
        F.col("o_custkey").cast("string").alias("member_key"), "l_orderkey", "l_linenumber",
        "l_returnflag", "o_orderstatus", "r_name", "r_regionkey", "o_orderdate", "l_shipdate",
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("paid"), adapters._tax().alias("tax"),
        adapters.tan().alias("tan"))


def _document(df, suffix, head, body, tail=None) -> DataFrame:
    parts = [head, F.array_join(body, "\n")] + ([tail] if tail is not None else [])
    return df.select(
        "member_key", F.concat(F.col("l_orderkey").cast("string"), F.lit(suffix)).alias("doc_id"),
        F.concat_ws("\n", *parts).alias("text"))


def _in_order(text):
    return F.sort_array(F.collect_list(F.struct("l_linenumber", text.alias("t"))))["t"]


def day(column, pattern="dd-MM-yyyy"):
    return F.date_format(column, pattern)


def _statement_blocks(spark, folder, header, detail, status=None):
    blocks = _lines(spark, folder, status).groupBy(
        "member_key", "l_orderkey", "r_regionkey", "r_name", "tan", "total").agg(
        F.sum("paid").cast("decimal(18,2)").alias("block_paid"),
        F.sum("tax").cast("decimal(18,2)").alias("block_tax"), _in_order(detail).alias("rows"))
    return blocks.withColumn("block", F.concat(F.array(header), F.col("rows"))).groupBy(
        "member_key", "l_orderkey", "total").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("r_regionkey", "block")))["block"]).alias("body"))


def statements(spark, folder, status=None) -> DataFrame:
    section = F.when(F.col("l_returnflag") == "A", "194").otherwise("192")
    detail = F.concat_ws(
        "  ", F.col("l_linenumber").cast("string"), section, day("l_shipdate", "dd-MMM-yyyy"), F.lit("F"),
        F.lit("15-Jun-2002"), F.col("paid").cast("string"), F.col("tax").cast("string"),
        F.col("tax").cast("string"))
    header = F.concat_ws(
        "  ", (F.col("r_regionkey") + 1).cast("string"), F.concat("r_name", F.lit(" TRADERS LIMITED")),
        "tan", F.col("block_paid").cast("string"), F.col("block_tax").cast("string"),
        F.col("block_tax").cast("string"))
    head = F.lit("Form 26AS\nPART A - Details of Tax Deducted at Source\nSr. No.  Name of Deductor  TAN")
    return _document(_statement_blocks(spark, folder, header, detail, status), "-st", head, F.col("body"))


def caret_section():
    return (F.when(F.col("l_returnflag") == "R", "192").when(F.col("l_returnflag") == "N", "192A")
            .otherwise("194A"))


def caret_statements(spark, folder, status=None) -> DataFrame:
    detail = F.concat_ws(
        "^", F.lit(""), F.col("l_linenumber").cast("string"), caret_section(), day("l_shipdate"),
        F.lit("F"), F.lit("15-06-2002"), F.lit("-"), F.col("paid").cast("string"),
        F.col("tax").cast("string"), F.col("tax").cast("string"))
    header = F.concat_ws(
        "^", F.lit("1"), F.concat("r_name", F.lit(" TRADERS LIMITED")), F.col("tan"),
        *[F.lit("")] * 4, F.col("block_paid").cast("string"), F.col("block_tax").cast("string"),
        F.col("block_tax").cast("string"))
    total = F.col("total").cast("string")
    challan = F.concat_ws("^", F.lit("1^100^0"), total, F.lit("0.00^0.00^0.00"), total,
                          F.lit("1234^30-07-2001^567^N"))
    return _document(_statement_blocks(spark, folder, header, detail, status), "-ca", F.lit("Details"),
                     F.col("body"), challan)


def passbooks(spark, folder, status=None) -> DataFrame:
    """Filled orders in the simple layout, the others in the live one with a closing line."""
    lines = _lines(spark, folder, status)
    money = lambda c: F.format_number(c, 2)
    plain = lambda c: F.col(c).cast("string")
    simple_row = F.concat_ws("      ", day("l_shipdate", "MMM-yyyy"), plain("paid"), plain("tax"), F.lit("1250"))
    live_row = F.concat_ws(
        " ", day("l_shipdate", "MMM-yyyy"), day("l_shipdate"), F.lit("CR Contribution (#ECR)"),
        money("paid"), money("tax"), F.lit("1,250 10,000 5,000 3,000"))
    simple = F.col("o_orderstatus") == "F"
    files = lines.groupBy("member_key", "l_orderkey", "o_orderstatus", "o_orderdate", "total").agg(
        _in_order(F.when(simple, simple_row).otherwise(live_row)).alias("rows"))
    account = F.concat(F.lit("MHBAN"), F.lpad(F.col("l_orderkey").cast("string"), 17, "0"))
    uan = F.lpad(F.col("member_key"), 12, "1")
    joined = day("o_orderdate")
    simple_head = F.concat(
        F.lit("EPF Member Passbook\nEstablishment ID / Name   MHBAN0012345000 / HIGH STREET TRADERS LTD\nMember ID   "),
        account, F.lit("\nMember Name   MEMBER "), F.col("member_key"),
        F.lit("\nDate of Birth   25-12-1960\nDate of Joining (EPF)   "), joined, F.lit("\nUAN   "), uan,
        F.lit("\nWage Month    Employee Share    Employer Share    Pension"))
    live_head = F.concat(
        F.lit("EPF Passbook - Financial Year\nMember ID "), account,
        F.lit("   Establishment Name  HIGH STREET TRADERS LTD\nAccount Number "), uan, F.lit("  UAN "), uan,
        F.lit("\nDate of Birth 24-11-1961\nTransferred in from MHBAN99999999999999999\nWage Month"))
    closing = F.concat(F.lit("Closing Balance as on 31-03-2001 "), F.format_number("total", 2),
                       F.lit(" 90,000 45,000"))
    return _document(files, "-pb", F.when(simple, simple_head).otherwise(live_head), F.col("rows"),
                     F.when(~simple, closing))


def histories(spark, folder, status=None) -> DataFrame:
    """A filled line has left by its ship date if that follows the order date."""
    gone = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.col("o_orderdate"))
    row = F.concat_ws(
        "   ", F.concat(F.lit("MHBAN"), F.lpad(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), 17, "0")),
        F.col("r_name"), day("o_orderdate"), F.when(gone, day("l_shipdate")).otherwise("-"))
    files = _lines(spark, folder, status).groupBy("member_key", "l_orderkey").agg(_in_order(row).alias("rows"))
    return _document(files, "-sh", F.lit("Service History\n\nMember ID   Establishment"), F.col("rows"))


def bank_statements(spark, folder, status=None) -> DataFrame:
    narration = (
        F.when(F.col("l_returnflag") == "R",
               F.concat(F.lit("NEFT CR-HDFC0000060-"), F.col("r_name"), F.lit(" TRADERS-SALARY")))
        .when(F.col("l_returnflag") == "N", "INT.CR QUARTERLY INTEREST CREDIT SALARY")
        .otherwise("TRANSFER TO HOUSEKEEPING"))
    direction = F.when(F.col("l_returnflag") == "A", "DR").otherwise("CR")
    row = F.concat_ws("  ", day("l_shipdate"), narration, F.format_number("paid", 2), direction)
    files = _lines(spark, folder, status).groupBy("member_key", "l_orderkey").agg(_in_order(row).alias("rows"))
    return _document(files, "-bk", F.lit("Statement of Account"), F.col("rows"))


def prose(spark, folder) -> DataFrame:
    return adapters.table(spark, folder, "documents").select(
        F.col("source").alias("member_key"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def mixed(spark, folder) -> DataFrame:
    """Each order hands in what its status suggests; the prose documents come on top."""
    return (
        passbooks(spark, folder, "F").unionByName(histories(spark, folder, "F"))
        .unionByName(caret_statements(spark, folder, "O"))
        .unionByName(statements(spark, folder, "O"))
        .unionByName(bank_statements(spark, folder, "P")).unionByName(prose(spark, folder)))
