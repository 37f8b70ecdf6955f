"""Document corpora: loading, kinds, lines and coverage.

Text work is split in two steps everywhere: narrow per-row expressions pick
the few lines that matter, and only those lines are shuffled by document. A
document came in as one cell, so the lines of one document fit one task.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora import rules
from corrobora.functions.text import holds

DOC = ["member_key", "doc_id"]


def load_corpus(spark: SparkSession, path: str, layout="text") -> DataFrame:
    """documents(member_key, doc_id, text).

    "text": one file per document below ``<path>/<member_key>/``; "parquet" or
    "json": tables with the three columns.
    """
    if layout == "text":
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        # the path is a URI: escapes stand for other characters, a plus sign for itself
        parts = F.transform(F.split("_metadata.file_path", "/"),
                            lambda part: F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))))
        return files.select(
            F.element_at(parts, -2).alias("member_key"), F.element_at(parts, -1).alias("doc_id"),
            F.col("value").alias("text"))
    return spark.read.format(layout).schema(
        "member_key string, doc_id string, text string").load(path)


def write_tables(tables: dict, path: str, as_of) -> None:
    """Every result table as parquet, partitioned by the date it was computed for."""
    for name, df in tables.items():
        df.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(f"{path}/{name}")


def kind_of(text):
    """Document kind by content; the first rule that holds decides."""
    low = F.lower(text)
    caret_statement = (
        (F.regexp_count(text, F.lit(r"\^")) > rules.CARETS_OVER)
        & text.rlike(rules.TAN) & text.rlike(rules.CARET_ROW))
    return (
        F.when(caret_statement | holds(low, rules.STATEMENT_WORDS), "26as")
        .when(holds(low, rules.HISTORY_WORDS) & ~low.contains("wage month"), "service_history")
        .when(holds(low, rules.PASSBOOK_WORDS), "passbook")
        .when(holds(low, rules.BANK_WORDS), "bank")
        .otherwise("unknown")
    )


def classify_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn("kind", kind_of(F.col("text")))


def _pieces():
    """The text cut at line breaks. Most texts know one kind of break, which needs no pattern."""
    single = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    rare = F.col("text").rlike(rules.RARE_CONTROL)
    for mark in rules.RARE_BREAKS:
        rare = rare | F.col("text").contains(mark)
    return F.when(rare, F.split(single, rules.SINGLE_BREAK, -1)).otherwise(
        F.split("text", "\n", -1))


def _closed(pieces):
    """Without the empty piece behind a final line break; an empty text has no lines."""
    n = F.size(pieces)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), n - 1)).otherwise(F.col(pieces))


def explode_lines(documents: DataFrame) -> DataFrame:
    """S3: one row per line, numbered from 0; a final line break opens no further line."""
    rest = [c for c in documents.columns if c != "text"]
    split = documents.select(*rest, _pieces().alias("_pieces"))
    return split.select(*rest, F.posexplode(_closed("_pieces")).alias("line_no", "line"))


def lines_and_markers(documents: DataFrame) -> DataFrame:
    """``explode_lines`` and, for each document, a row numbered -1 without a line: empty ones stay known."""
    marker = F.array(F.lit(None).cast("string"))
    rest = [c for c in documents.columns if c != "text"]
    split = documents.select(*rest, _pieces().alias("_pieces"))
    pieces = F.when(F.col("_pieces").isNotNull(), F.concat(marker, _closed("_pieces"))).otherwise(marker)
    return split.select(*rest, F.posexplode(pieces).alias("_at", "line")).select(
        *rest, (F.col("_at") - 1).alias("line_no"), "line")


def evidence_coverage(classified: DataFrame) -> DataFrame:
    """Which questions a member's set of documents can answer."""
    def has(kind):
        return F.bool_or(F.col("kind") == kind)

    held = classified.groupBy("member_key").agg(
        has("passbook").alias("passbook"), has("26as").alias("statement"),
        has("service_history").alias("history"), has("bank").alias("bank"))
    reduced = F.array_compact(F.array(
        F.when(~F.col("history"), "no dates can be checked"),
        F.when(~F.col("passbook"), "no balances or contributions"),
        F.when(~F.col("statement"), "no independent corroboration"),
        F.when(~F.col("bank"), "no exact pay days")))
    return held.select(
        "member_key", (~F.col("passbook") & ~F.col("statement")).alias("missing"),
        reduced.alias("reduced"))


def corpus_profile(documents: DataFrame) -> DataFrame:
    """Structure of each document, without repeating anything it says."""
    low = F.col("low")
    kind = (
        F.when(holds(low, rules.STATEMENT_WORDS), "26as")
        .when(holds(low, rules.PROBE_PASSBOOK_WORDS), "passbook")
        .when(holds(low, rules.PROBE_AIS_WORDS), "ais").otherwise("unknown"))

    def found(anchors):
        return F.array_compact(F.array(
            [F.when(holds(low, pattern), label) for label, pattern in anchors.items()]))

    def distinct_tokens(pattern):
        return F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))

    def as_year(digits):
        # "0" in front keeps the cast total on the empty match
        value = F.concat(F.lit("0"), digits).cast("int")
        return F.when(value < 100, value + 2000).otherwise(value)

    named = F.transform(
        F.regexp_extract_all("text", F.lit(rules.PROBE_MONTH), F.lit(1)),
        lambda token: as_year(F.regexp_extract(token, r"(\d{2,4})$", 1)) * 12
        + F.array_position(F.array([F.lit(m) for m in rules.MONTH_NAMES]),
                           F.lower(F.substring(token, 1, 3))) - 1)
    dated = F.transform(
        F.filter(F.regexp_extract_all("text", F.lit(rules.PROBE_DATE), F.lit(1)),
                 lambda token: F.substring(token, 4, 2).cast("int").between(1, 12)),
        lambda token: F.substring(token, 7, 4).cast("int") * 12
        + F.substring(token, 4, 2).cast("int") - 1)
    months = F.array_distinct(F.filter(
        F.concat(named, dated), lambda m: m.between(1990 * 12, 2100 * 12 + 11)))

    # kind, anchors and months are each computed once, in a step of their own
    profiled = documents.select(*DOC, "text", F.lower("text").alias("low")).select(
        *DOC, kind.alias("kind"), found(rules.STATEMENT_ANCHORS).alias("statement"),
        found(rules.PASSBOOK_ANCHORS).alias("passbook"),
        F.size(distinct_tokens(rules.TAN)).alias("tans"),
        F.size(distinct_tokens(rules.PROBE_ACCOUNT)).alias("account_ids"),
        F.regexp_count("text", F.lit(rules.PROBE_MONEY)).alias("amounts"), months.alias("m")
    ).withColumn("anchors", F.when(F.col("kind") == "26as", F.col("statement"))
                 .when(F.col("kind") == "passbook", F.col("passbook"))
                 .otherwise(F.concat("statement", "passbook"))).drop("statement", "passbook")
    has = lambda label: F.array_contains("anchors", label)
    statement_ok = (F.col("tans") >= 1) & (F.col("months") >= 2) & (F.col("amounts") >= 4)
    passbook_ok = (
        (has("member ID") | (F.col("account_ids") >= 1))
        & (has("wage month column") | (F.col("months") >= 2)) & has("date of joining"))
    return (
        profiled
        .withColumn("months", F.size("m"))
        .withColumn("span_months", F.coalesce(
            F.array_max("m") - F.array_min("m") + 1, F.lit(0)))
        .drop("m")
        .withColumn("usable", F.when(F.col("kind") == "26as", statement_ok)
                    .when(F.col("kind") == "passbook", passbook_ok).otherwise(True))
    )
