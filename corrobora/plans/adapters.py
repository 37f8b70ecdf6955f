"""Thin adapters from the star-schema test tables to the column contracts."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrobora.functions.dates import month_no

AS_OF = date(2001, 12, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark, folder):
    """Order lines with the supplier's region, which stands for the party.

    Joined one table at a time: each right side is then a plain scan whose size
    Spark knows, so small dimensions broadcast and large ones do not.
    """
    orders = table(spark, folder, "orders")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def party_lines(spark, folder) -> DataFrame:
    """All that evidence, record, proposals and closed parties say of an order line: for plans that need several."""
    return _lines(spark, folder).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "r_name", "r_regionkey",
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice",
        (F.col("s_acctbal") < 0).alias("in_debt"))


def observations(spark, folder, lines=None) -> DataFrame:
    source = (
        F.when(F.col("l_returnflag") == "R", "EPF_CONTRIB")
        .when(F.col("l_returnflag") == "N", "TDS_26AS")
        .otherwise("BANK_SALARY")
    )
    return (party_lines(spark, folder) if lines is None else lines).select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("r_name").alias("party_key"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        source.alias("source"),
        F.when(F.col("l_returnflag") != "R",
               F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
        F.lit("").alias("note"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )


def asserted(spark, folder, lines=None) -> DataFrame:
    """What the record claims: filled orders open it, and a later open order keeps it open."""
    lines = (party_lines(spark, folder) if lines is None else lines).select(
        "o_custkey", "r_name", "r_regionkey", "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    filled = F.col("o_orderstatus") == "F"
    # the last order and whether it closes the record as one number, so that lines are hashed and never sorted
    place = (F.unix_date("day").cast("decimal(10,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")
             + F.col("o_orderkey").cast("decimal(19,0)"))
    closes = F.coalesce(F.col("o_orderstatus") != "O", F.lit(False))
    last = (place * F.lit(2).cast("decimal(1,0)") + closes.cast("int").cast("decimal(1,0)")).cast("decimal(38,0)")
    return (
        lines.groupBy("o_custkey", "r_name", "r_regionkey").agg(
            F.min(F.when(filled, F.col("day"))).alias("doj"),
            F.max(F.when(filled, F.col("day"))).alias("last_filled"),
            F.max(last).alias("last"),
        )
        .filter(F.col("doj").isNotNull())
        .select(
            F.col("o_custkey").cast("string").alias("member_key"),
            F.col("r_name").alias("party_key"),
            F.concat_ws("-", "r_regionkey", "o_custkey").alias("account_id"),
            "doj",
            F.when(F.pmod("last", F.lit(2).cast("decimal(38,0)")) == 1, F.col("last_filled")).alias("doe"),
            F.col("r_regionkey").cast("bigint").alias("ord"),
        )
    )


def members(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("member_key"))


def member_facts(spark, folder, evidence=None) -> DataFrame:
    """Customers as members: identity from their attributes, months of evidence as service.

    ``evidence`` is any table with a member's dates of evidence, if it is there already.
    """
    customer = table(spark, folder, "customer")
    # months as the bits of a number, 60 to a row; an unknown month is one more
    month = month_no("obs_date")
    months = (
        (observations(spark, folder) if evidence is None else evidence)
        .groupBy("member_key", F.floor(month / 60).alias("span"))
        .agg(F.bit_or(F.coalesce(F.expr("shiftleft(1L, cast(pmod(year(obs_date) * 12 + month(obs_date) - 1, 60) as int))"),
                                 F.lit(1).cast("bigint"))).alias("bits"))
        .groupBy("member_key").agg(F.sum(F.bit_count("bits")).alias("service_months"))
    )
    segment = F.col("c_mktsegment")
    key = F.col("c_custkey").cast("string")
    return (
        customer.select(
            key.alias("member_key"), F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"),
            F.when(segment != "HOUSEHOLD", F.lpad(key, 12, "0")).alias("uan"),
            F.when(segment != "BUILDING", F.concat(F.lit("PAN"), key)).alias("pan"),
            F.when(F.col("c_nationkey") > 0,
                   F.make_date(F.col("c_nationkey") + 1960, F.lit(1), F.lit(1))).alias("dob"),
            F.when(F.col("c_acctbal") < 0, 2).otherwise(1).alias("n_dobs"),
            F.when(segment == "MACHINERY", "fail").otherwise("pass").alias("name_status"),
            F.when(segment == "MACHINERY", 2).when(segment == "FURNITURE", 0).otherwise(1)
            .alias("n_spellings"),
            (segment != "BUILDING").alias("has_pan"),
            F.abs("c_acctbal").cast("decimal(18,2)").alias("pensionable_salary"),
        )
        .join(months, "member_key", "left").fillna(0, ["service_months"])
        .withColumn("balance",
                    (F.col("c_acctbal") * F.col("service_months")).cast("decimal(18,2)"))
    )


def claims(spark, folder) -> DataFrame:
    """Orders as claims: the order status stands for the outcome."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "Claim Rejected")
        .when(F.col("o_orderstatus") == "P", "Claim Settled").otherwise("Under Process"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("o_orderkey").cast("string").alias("tracking_id"),
        F.col("o_orderpriority").alias("form"),
        F.col("o_orderdate").cast("date").alias("filed"), status.alias("status"))


def proposals(spark, folder, lines=None) -> DataFrame:
    """One proposed exit per record: the last order of any status, on the paper it came with."""
    paper = (
        F.when(F.col("priority") == "1-URGENT", "Appointment letter")
        .when(F.col("priority") == "2-HIGH", "Attendance register extract")
        .when(F.col("priority") == "3-MEDIUM", "Relieving letter or final payslip")
        .otherwise("Form 26AS"))
    last = (party_lines(spark, folder) if lines is None else lines).groupBy("o_custkey", "r_name", "r_regionkey").agg(
        F.max(F.col("o_orderdate").cast("date")).alias("proposed"),
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))
    return last.select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("r_regionkey").cast("bigint").alias("proposal_id"),
        F.concat_ws("-", "r_regionkey", "o_custkey").alias("account_id"),
        "proposed", paper.alias("evidence"), F.lit(AS_OF).alias("started"))


def deductors(spark, folder) -> DataFrame:
    """Order lines by region as statement blocks, with their own totals as the header."""
    return _lines(spark, folder).groupBy(
        "o_custkey", "l_orderkey", "r_regionkey", "r_name", "o_orderpriority").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total_paid"),
        F.sum(_tax()).cast("decimal(18,2)").alias("total_tds"),
    ).select(
        F.col("o_custkey").cast("string").alias("member_key"), F.col("l_orderkey").alias("doc_id"),
        (F.col("r_regionkey") + 1).cast("bigint").alias("block_no"),
        F.concat_ws(" ", "r_name", "o_orderpriority").alias("name"), tan().alias("tan"),
        "total_paid", "total_tds")


def tan():
    return F.concat(F.lit("MUM"), F.substring("r_name", 1, 1),
                    F.lpad(F.col("r_regionkey").cast("string"), 5, "0"), F.lit("B"))


def _tax():
    return F.round(F.col("l_extendedprice").cast("decimal(18,2)")
                   * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)")


def order_headers(spark, folder) -> DataFrame:
    """Orders as statement headers: the printed total, and the tax as the lines have it."""
    tax = _lines(spark, folder).groupBy("l_orderkey").agg(
        F.sum(_tax()).cast("decimal(18,2)").alias("total_tds"))
    return table(spark, folder, "orders").join(
        tax, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").cast("string").alias("member_key"), F.col("o_orderkey").alias("doc_id"),
        F.lit(1).cast("bigint").alias("block_no"), F.col("o_orderpriority").alias("tan"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_paid"),
        F.coalesce("total_tds", F.lit(0)).cast("decimal(18,2)").alias("total_tds"))


def transactions(spark, folder, whole_orders=False) -> DataFrame:
    section = (
        F.when(F.col("l_linestatus") == "O", None).when(F.col("l_returnflag") == "R", "192")
        .when(F.col("l_returnflag") == "N", "192A").otherwise("194A"))
    block = F.lit(1) if whole_orders else F.col("r_regionkey") + 1
    return _lines(spark, folder).select(
        F.col("o_custkey").cast("string").alias("member_key"), F.col("l_orderkey").alias("doc_id"),
        block.cast("bigint").alias("block_no"), F.col("l_linenumber").alias("line_no"),
        section.alias("section"), F.col("l_shipdate").cast("date").alias("txn_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_paid"),
        _tax().alias("tax_deducted"), tan().alias("tan"))


def contributions(spark, folder) -> DataFrame:
    """Orders as contributions: an account per customer and status, a file per year."""
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.concat_ws("-", "o_custkey", "o_orderstatus", F.year("o_orderdate")).alias("doc_id"),
        F.concat_ws("-", "o_custkey", "o_orderstatus").alias("account_id"),
        F.trunc("o_orderdate", "MM").alias("month"), total.alias("employee"),
        F.round(total * F.lit("0.25").cast("decimal(3,2)"), 2).cast("decimal(18,2)").alias("employer"),
        F.lit("1250").cast("decimal(18,2)").alias("pension"),
        F.col("o_orderkey").alias("line_no"), "o_orderpriority", "o_orderdate")


def passbook_heads(spark, folder) -> DataFrame:
    """File headers: the last order of the year prints the closing balance, unless urgent."""
    last = contributions(spark, folder).groupBy("member_key", "doc_id", "account_id").agg(
        F.max_by(F.struct("o_orderpriority", "employee", "employer", "pension"),
                 F.struct("o_orderdate", "line_no")).alias("z"),
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"))
    priority = F.col("z.o_orderpriority")
    return last.select(
        "member_key", "doc_id", "account_id",
        F.year("first_day").cast("bigint").alias("file_ord"),
        F.when(priority != "5-LOW", priority).alias("establishment"),
        F.lit(None).cast("string").alias("est_code"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("uan"), F.lit(None).cast("date").alias("dob"),
        F.when(priority != "4-NOT SPECIFIED", F.col("first_day")).alias("doj"),
        F.when(priority != "1-URGENT",
               F.struct("z.employee", "z.employer", "z.pension")).alias("closing"),
        F.array(F.concat_ws("-", F.substring_index("account_id", "-", 1), F.lit("F")))
        .alias("other_ids"))
