"""Service histories, bank statements, names and identity as tables."""

from pyspark.sql import DataFrame, functions as F

from corrobora import rules
from corrobora.functions.dates import dmy
from corrobora.functions.text import first_match, money, strip
from corrobora.operators.spread import position_in_order
from corrobora.session import cut_lineage
from corrobora.sources.corpus import DOC, explode_lines


def service_history_table(documents: DataFrame) -> DataFrame:
    """Account id with one or two dates; a single date leaves the exit open."""
    line = strip("line")
    days = F.regexp_extract_all("line", F.lit(rules.DMY), F.lit(1))
    return (
        explode_lines(documents).withColumn("line", line)
        .filter(F.col("line").rlike(rules.HISTORY_ROW) & (F.size(days) > 0))
        .select(*DOC, "line_no", F.get(F.split("line", r"\s+"), F.lit(0)).alias("account_id"),
                dmy(F.get(days, 0)).alias("doj"), dmy(F.get(days, 1)).alias("doe"))
    )


def validate_history_rows(raw: DataFrame):
    """(accepted, rejected) typed records. Refuses rather than guesses.

    ``raw``: member_key, account_id, doj_raw, doe_raw. A member whose rows are
    all blank is told so.
    """
    def typed(column):
        text = F.coalesce(F.trim(column), F.lit(""))
        parts = [F.lpad(F.regexp_extract(text, rules.TYPED_DATE, n), w, "0")
                 for n, w in ((1, 2), (2, 2), (3, 4))]
        return text, text.rlike(rules.TYPED_DATE), F.try_to_date(
            F.concat_ws("-", *parts), "dd-MM-yyyy")

    doj_text, doj_shape, doj = typed("doj_raw")
    doe_text, doe_shape, doe = typed("doe_raw")
    blank = (doj_text == "") & (doe_text == "")
    reason = (
        F.when(doj_text == "", "a joining date is needed")
        .when(~doj_shape, "joining date is not D-M-YYYY")
        .when(doj.isNull(), "joining date is not a real date")
        .when((doe_text != "") & ~doe_shape, "exit date is not D-M-YYYY")
        .when((doe_text != "") & doe.isNull(), "exit date is not a real date")
        .when(doe < doj, "exit before joining")
    )
    judged = raw.select("member_key", "account_id", blank.alias("blank"), doj.alias("doj"),
                        doe.alias("doe"), reason.alias("reason"))
    filled = judged.filter(~F.col("blank"))
    accepted = filled.filter(F.col("reason").isNull()).select(
        "member_key", "account_id", "doj", "doe")
    nothing = (
        judged.groupBy("member_key").agg(F.every("blank").alias("empty")).filter("empty")
        .select("member_key", F.lit(None).cast("string").alias("account_id"),
                F.lit("nothing was entered").alias("reason")))
    rejected = filled.filter(F.col("reason").isNotNull()).select(
        "member_key", "account_id", "reason").unionByName(nothing)
    return accepted, rejected


def bank_table(documents: DataFrame) -> DataFrame:
    """Date, narration, amount, CR or DR."""
    line = strip("line")
    part = lambda n: F.regexp_extract("line", rules.BANK_ROW, n)
    return (
        explode_lines(documents).withColumn("line", line)
        .filter(F.col("line").rlike(rules.BANK_ROW))
        .select(*DOC, "line_no", dmy(part(1)).alias("txn_date"), F.trim(part(2)).alias("narration"),
                money(part(3)).alias("amount"), part(4).alias("direction"))
    )


def classify_credits(bank_rows: DataFrame) -> DataFrame:
    """Salary or not, and the longest word that may name the payer (the first on ties)."""
    text = F.col("narration")
    words = F.filter(
        F.split(text, r"[^A-Za-z&]+"),
        lambda w: (F.length(w) > 3) & ~F.upper(w).isin(rules.HINT_NOISE))
    longest = F.aggregate(
        words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    is_salary = text.rlike(rules.SALARY_WORDS) & ~text.rlike(rules.NON_SALARY_WORDS)
    return bank_rows.filter(F.col("direction") == "CR").select(
        "*", is_salary.alias("is_salary"), F.nullif(longest, F.lit("")).alias("hint"),
        F.when(is_salary, 0.75).otherwise(0.6).alias("confidence"))


def extract_names(classified: DataFrame) -> DataFrame:
    """The name as each document spells it; further files of a kind are numbered."""
    found = F.coalesce(*[first_match(F.col("text"), p) for p in rules.NAME_FIELDS])
    label = F.lit(None).cast("string")
    for kind, text in rules.NAME_LABELS.items():
        label = F.when(F.col("kind") == kind, text).otherwise(label)
    # numbering reads this three times, so the text is read for it once
    named = cut_lineage(classified.filter(F.col("kind").isin(list(rules.NAME_LABELS))).select(
        *DOC, "kind", label.alias("label"), strip(found).alias("name")))
    numbered = position_in_order(named, ["member_key", "kind"], ["doc_id"], "n")
    kind_order = F.array_position(F.array([F.lit(k) for k in rules.NAME_LABELS]), F.col("kind"))
    return numbered.filter(F.col("name").isNotNull()).select(
        "member_key", "doc_id", "kind",
        (F.shiftleft(kind_order.cast("bigint"), 40) + F.col("n")).alias("ord"),
        F.when(F.col("n") == 1, F.col("label"))
        .otherwise(F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("label"),
        "name")


def read_for_identity(classified: DataFrame) -> DataFrame:
    """What S11 needs of each document, written once: kind, a statement's tax number, a passbook's text."""
    kind = F.col("kind")
    return cut_lineage(classified.select(
        *DOC, "kind", F.when(kind == "26as", first_match(F.col("text"), rules.PAN)).alias("pan"),
        F.when(kind == "passbook", F.col("text")).alias("text")))


def extract_identity(classified: DataFrame, heads: DataFrame) -> DataFrame:
    """First tax number, account number and birth date, and every birth date if they differ.

    ``classified`` may carry the tax numbers already, as ``pan``.
    """
    pan = F.col("pan") if "pan" in classified.columns else first_match(F.col("text"), rules.PAN)
    from_statements = (
        classified.filter(F.col("kind") == "26as").select(*DOC, pan.alias("pan"))
        .groupBy("member_key")
        .agg(F.min_by("pan", F.when(F.col("pan").isNotNull(), F.col("doc_id"))).alias("pan")))
    from_passbooks = heads.groupBy("member_key").agg(
        F.min_by("uan", F.when(F.col("uan").isNotNull(), F.col("doc_id"))).alias("uan"),
        F.min_by("dob", F.when(F.col("dob").isNotNull(), F.col("doc_id"))).alias("dob"),
        F.array_sort(F.collect_set("dob")).alias("dobs"))
    return (
        classified.select("member_key").distinct()
        .join(from_statements, "member_key", "left").join(from_passbooks, "member_key", "left")
        .select("member_key", "pan", "uan", "dob",
                F.coalesce(F.size("dobs"), F.lit(0)).alias("n_dobs"),
                F.when(F.size("dobs") > 1, F.transform("dobs", lambda d: d.cast("string")))
                .otherwise(F.array().cast("array<string>")).alias("dob_conflict"))
    )
