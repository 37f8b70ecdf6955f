"""Letters checked against the ledger of facts."""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules


def letter_tokens(letters: DataFrame, patterns=None) -> DataFrame:
    """Every factual token a letter's body states, as often as it states it."""
    patterns = rules.LETTER_TOKENS if patterns is None else patterns

    def found(kind, pattern):
        tokens = F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
        if kind == "AMOUNT":
            tokens = F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit("")))
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("value")))

    return letters.select(
        "member_key", "doc_id", "scope",
        F.explode(F.flatten(F.array([found(k, p) for k, p in patterns.items()]))).alias("t")
    ).select("member_key", "doc_id", "scope", "t.*")


def unsupported_tokens(tokens: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tokens that no fact of the member backs in the letter's scope or at member level."""
    fact = ["member_key", "kind", "value"]
    anywhere = ledger.groupBy(*fact).agg(F.bool_or(F.col("scope").isNull()).alias("member_level"))
    scoped = ledger.filter(F.col("scope").isNotNull()).select(*fact, "scope").distinct().withColumn(
        "in_scope", F.lit(True))
    return (
        tokens.join(anywhere, fact, "left").join(scoped, [*fact, "scope"], "left")
        .filter(~F.coalesce("member_level", F.lit(False)) & F.col("in_scope").isNull())
        .select("member_key", "doc_id", F.lit("UNSUPPORTED_FACT").alias("violation"),
                F.concat("kind", F.lit("="), "value").alias("token"),
                F.when(F.col("member_level").isNotNull(), "other scope")
                .otherwise("no evidence").alias("detail"))
    )


def lint_letters(letters: DataFrame, ledger: DataFrame, patterns=None) -> DataFrame:
    """G1: unsupported facts, hedged wording and missing annexures, one row each.

    ``letters``: member_key, doc_id, scope, body, annexure array<string>;
    ``ledger``: member_key, kind, value, scope (null = whole member), source.
    """
    whole = F.concat_ws("\n", "body", F.array_join("annexure", "\n"))

    def problem(violation, token, detail):
        return F.struct(F.lit(violation).alias("violation"), token.alias("token"),
                        F.lit(detail).alias("detail"))

    wording = F.array_compact(F.array(
        *[F.when(whole.rlike(p), problem(
            "HEDGED_LANGUAGE", F.regexp_extract(whole, p, 0), "speculative wording"))
          for p in rules.HEDGES],
        F.when(F.size("annexure") == 0, problem("NO_ANNEXURE", F.lit("-"), "no evidence attached"))))
    return unsupported_tokens(letter_tokens(letters, patterns), ledger).unionByName(
        letters.select("member_key", "doc_id", F.explode(wording).alias("p")).select(
            "member_key", "doc_id", "p.*"))


def supporting_facts(findings, asserted, observations, corrected, identity) -> DataFrame:
    """The facts a letter about an early exit may state.

    Account number, the recorded exit and the corrected one, the three latest
    tax dates after the exit, and the member's own number for any scope.
    """
    party = ["member_key", "party_key"]
    early = findings.filter(F.col("kind") == "EXIT_TOO_EARLY").select(*party).distinct()
    record = asserted.groupBy(*party).agg(
        F.min_by(F.struct("account_id", "doe"), F.struct("ord", "account_id", "doe")).alias("r")).select(*party, "r.*").join(early, party)
    shown = lambda day: F.date_format(day, "dd-MM-yyyy")

    def fact(df, kind, value, source, scope=F.col("party_key")):
        return df.select("member_key", F.lit(kind).alias("kind"), value.alias("value"),
                         scope.alias("scope"), F.lit(source).alias("source"))

    # newest first per party, cut to three per task before the shuffle
    latest = Window.partitionBy(*party).orderBy(F.desc("obs_date"), F.asc("ord"))
    later = (
        observations.filter(F.col("source") == rules.TAX_SOURCE)
        .join(record.select(*party, "doe"), party).filter(F.col("obs_date") > F.col("doe"))
        .withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= 3))
    members = early.select("member_key").distinct().join(identity, "member_key")
    nowhere = F.lit(None).cast("string")
    return (
        fact(members, "UAN", F.coalesce("uan", F.lit("")), "passbook header", nowhere)
        .unionByName(fact(record, "MEMBER_ID", F.col("account_id"), "passbook header"))
        .unionByName(fact(record, "DATE", shown("doe"), "service history"))
        .unionByName(fact(later, "DATE", shown("obs_date"), "statement salary entry"))
        .unionByName(fact(corrected.join(early, party), "DATE", shown("end"), "corrected boundary"))
    )
