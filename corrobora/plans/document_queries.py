"""Text jobs over rendered documents and the prose table, with their SQL.

The SQL side never parses the rendered documents: it states what they must say
straight from the tables they were rendered from.
"""

from pyspark.sql import functions as F

from corrobora.operators import letters, linkage, statements as merge
from corrobora.plans import adapters, derived_corpus as derived
from corrobora.plans.registry import query, with_ctes
from corrobora.sources import corpus, passbooks, records, statements

BREAKS = r"(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"

RAW = [("raw", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, l_orderkey, l_linenumber, l_returnflag,
         o_orderstatus, r_name, r_regionkey, CAST(o_orderdate AS DATE) AS o_day,
         CAST(l_shipdate AS DATE) AS s_day, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
         'MUM' || left(r_name, 1) || lpad(CAST(r_regionkey AS VARCHAR), 5, '0') || 'B' AS tan,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS paid,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")]

BLOCKS = RAW + [("blocks", """
  SELECT member_key, l_orderkey, r_regionkey, r_name || ' TRADERS LIMITED' AS name, tan,
         dense_rank() OVER (PARTITION BY l_orderkey ORDER BY r_regionkey) AS block_no,
         CAST(sum(paid) AS DOUBLE) AS total_paid, CAST(sum(tax) AS DOUBLE) AS total_tds
  FROM raw GROUP BY member_key, l_orderkey, r_regionkey, r_name, tan""")]


def _blocks_sql(suffix):
    return with_ctes(BLOCKS) + f"""
SELECT member_key, l_orderkey || '{suffix}' AS doc_id, block_no, name, tan, total_paid, total_tds
FROM blocks"""


def _rows_sql(suffix, section):
    return with_ctes(BLOCKS) + f"""
SELECT r.member_key, l_orderkey || '{suffix}' AS doc_id, block_no, {section} AS section,
       s_day AS txn_date, CAST(paid AS DOUBLE) AS amount_paid, CAST(tax AS DOUBLE) AS tax_deducted
FROM raw r JOIN blocks b USING (l_orderkey, r_regionkey)"""


TABULAR_SECTION = "CASE WHEN l_returnflag = 'A' THEN '194' ELSE '192' END"
CARET_SECTION = ("CASE l_returnflag WHEN 'R' THEN '192' WHEN 'N' THEN '192A' ELSE '194A' END")


@query("statement_deductors", _blocks_sql("-st"))
def statement_deductors(spark, folder):
    return statements.statement_tables(derived.statements(spark, folder))[0]


@query("statement_transactions", _rows_sql("-st", TABULAR_SECTION))
def statement_transactions(spark, folder):
    return statements.statement_tables(derived.statements(spark, folder))[1].drop("line_no")


@query("caret_deductors", _blocks_sql("-ca"))
def caret_deductors(spark, folder):
    return statements.statement_tables(derived.caret_statements(spark, folder))[0]


@query("caret_transactions", _rows_sql("-ca", CARET_SECTION))
def caret_transactions(spark, folder):
    return statements.statement_tables(derived.caret_statements(spark, folder))[1].drop("line_no")


@query("statement_arithmetic", with_ctes(RAW) + """
SELECT NULL AS member_key, NULL AS doc_id, 0 AS block_no, NULL AS tan, NULL AS measure,
       0.0 AS detail_sum, 0.0 AS header_total, 0.0 AS difference FROM raw WHERE false""")
def statement_arithmetic(spark, folder):
    """What was rendered adds up, so nothing may be reported after the round trip."""
    return merge.verify_statements(*statements.statement_tables(derived.statements(spark, folder)))


ACCOUNT = "'MHBAN' || lpad(CAST(l_orderkey AS VARCHAR), 17, '0')"


@query("passbook_heads", with_ctes(RAW) + f"""
SELECT DISTINCT member_key, l_orderkey || '-pb' AS doc_id, {ACCOUNT} AS account_id,
       CASE WHEN o_orderstatus = 'F' THEN 'HIGH STREET TRADERS LTD' END AS establishment,
       CASE WHEN o_orderstatus = 'F' THEN 'MHBAN0012345000' END AS est_code,
       CASE WHEN o_orderstatus = 'F' THEN o_day END AS doj,
       CASE WHEN o_orderstatus = 'F' THEN DATE '1960-12-25' ELSE DATE '1961-11-24' END AS dob,
       lpad(member_key, 12, '1') AS uan,
       CASE WHEN o_orderstatus = 'F' THEN 'MEMBER ' || member_key END AS name,
       CASE WHEN o_orderstatus <> 'F' THEN CAST(total AS DOUBLE) END AS closing_employee,
       CASE WHEN o_orderstatus <> 'F' THEN 90000.0 END AS closing_employer,
       CASE WHEN o_orderstatus <> 'F' THEN 45000.0 END AS closing_pension,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'MHBAN99999999999999999' END AS other_ids
FROM raw""")
def passbook_heads(spark, folder):
    heads, _ = passbooks.passbook_tables(derived.passbooks(spark, folder))
    return heads.select(
        "*", F.col("closing.employee").alias("closing_employee"),
        F.col("closing.employer").alias("closing_employer"),
        F.col("closing.pension").alias("closing_pension")).drop("closing")


@query("passbook_contributions", with_ctes(RAW) + f"""
SELECT member_key, l_orderkey || '-pb' AS doc_id, {ACCOUNT} AS account_id,
       CAST(date_trunc('month', s_day) AS DATE) AS month, CAST(paid AS DOUBLE) AS employee,
       CAST(tax AS DOUBLE) AS employer, 1250.0 AS pension FROM raw""")
def passbook_contributions(spark, folder):
    return passbooks.passbook_tables(derived.passbooks(spark, folder))[1].drop("line_no")


@query("service_history", with_ctes(RAW) + """
SELECT member_key, l_orderkey || '-sh' AS doc_id,
       'MHBAN' || lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 17, '0') AS account_id,
       o_day AS doj, CASE WHEN l_returnflag = 'R' AND s_day >= o_day THEN s_day END AS doe
FROM raw""")
def service_history(spark, folder):
    return records.service_history_table(derived.histories(spark, folder)).drop("line_no")


BANK = RAW + [("bank", """
  SELECT member_key, l_orderkey, l_linenumber, l_orderkey || '-bk' AS doc_id, s_day AS txn_date,
         CASE l_returnflag WHEN 'R' THEN 'NEFT CR-HDFC0000060-' || r_name || ' TRADERS-SALARY'
              WHEN 'N' THEN 'INT.CR QUARTERLY INTEREST CREDIT SALARY'
              ELSE 'TRANSFER TO HOUSEKEEPING' END AS narration,
         CAST(paid AS DOUBLE) AS amount, CASE WHEN l_returnflag = 'A' THEN 'DR' ELSE 'CR' END AS direction
  FROM raw""")]


@query("bank_rows", with_ctes(BANK) + """
SELECT member_key, doc_id, txn_date, narration, amount, direction FROM bank""")
def bank_rows(spark, folder):
    return records.bank_table(derived.bank_statements(spark, folder)).drop("line_no")


@query("classify_credits", with_ctes(BANK) + """
SELECT member_key, doc_id, txn_date, narration, amount, direction,
       narration LIKE 'NEFT%' AS is_salary,
       CASE WHEN narration LIKE 'INT%' THEN 'QUARTERLY' WHEN narration LIKE '%AMERICA %' THEN 'AMERICA'
            WHEN narration LIKE '%AFRICA %' THEN 'TRADERS' ELSE 'TRADERS' END AS hint,
       CASE WHEN narration LIKE 'NEFT%' THEN 0.75 ELSE 0.6 END AS confidence
FROM bank WHERE direction = 'CR'""")
def classify_credits(spark, folder):
    return records.classify_credits(
        records.bank_table(derived.bank_statements(spark, folder))).drop("line_no")


PROSE_KIND = r"""CASE WHEN regexp_matches(lower(text), 'form\s*26as|annual tax statement|tax credit statement')
            THEN '26as'
            WHEN regexp_matches(lower(text), 'service history|date of exit')
                 AND NOT contains(lower(text), 'wage month') THEN 'service_history'
            WHEN regexp_matches(lower(text), 'passbook|wage month') THEN 'passbook'
            WHEN regexp_matches(lower(text), 'narration|statement of account|closing balance') THEN 'bank'
            ELSE 'unknown' END"""

MIXED_KINDS = [("kinds", f"""
  SELECT member_key, doc_id, kind FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS member_key, o_orderkey || suffix AS doc_id, kind
    FROM orders JOIN (VALUES ('F', '-pb', 'passbook'), ('F', '-sh', 'service_history'),
                             ('O', '-ca', '26as'), ('O', '-st', '26as'), ('P', '-bk', 'bank'))
         t(s, suffix, kind) ON o_orderstatus = s
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
  UNION ALL SELECT source, CAST(doc_id AS VARCHAR), {PROSE_KIND} FROM documents""")]


@query("document_kinds", with_ctes(MIXED_KINDS) + "SELECT * FROM kinds")
def document_kinds(spark, folder):
    return corpus.classify_documents(derived.mixed(spark, folder)).drop("text")


@query("evidence_coverage", with_ctes(MIXED_KINDS) + """
, held AS (
  SELECT member_key, bool_or(kind = 'passbook') AS p, bool_or(kind = '26as') AS s,
         bool_or(kind = 'service_history') AS h, bool_or(kind = 'bank') AS b
  FROM kinds GROUP BY member_key)
SELECT member_key, NOT p AND NOT s AS missing,
       concat_ws('|', CASE WHEN NOT h THEN 'no dates can be checked' END,
                 CASE WHEN NOT p THEN 'no balances or contributions' END,
                 CASE WHEN NOT s THEN 'no independent corroboration' END,
                 CASE WHEN NOT b THEN 'no exact pay days' END) AS reduced FROM held""")
def evidence_coverage(spark, folder):
    return corpus.evidence_coverage(corpus.classify_documents(derived.mixed(spark, folder)))


@query("document_lines", f"""
WITH pieces AS (SELECT doc_id, regexp_split_to_array(text, '{BREAKS}') AS p FROM documents)
, numbered AS (
  SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS line_no, len(p) AS n FROM pieces)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, line_no, line FROM numbered
WHERE NOT (line_no = n - 1 AND line = '')""")
def document_lines(spark, folder):
    return corpus.explode_lines(derived.prose(spark, folder)).drop("member_key")


PROFILE = RAW + [
    ("texts", """
  SELECT source AS member_key, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
  UNION ALL
  SELECT member_key, l_orderkey || '-sh', 'Service History' || chr(10) || chr(10) ||
         'Member ID   Establishment' || chr(10) || string_agg(
           'MHBAN' || lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 17, '0') || '   ' || r_name ||
           '   ' || strftime(o_day, '%d-%m-%Y') || '   ' ||
           CASE WHEN l_returnflag = 'R' AND s_day >= o_day THEN strftime(s_day, '%d-%m-%Y') ELSE '-' END,
           chr(10) ORDER BY l_linenumber)
  FROM raw GROUP BY member_key, l_orderkey"""),
    ("found", r"""
  SELECT member_key, doc_id, text, lower(text) AS low,
         regexp_extract_all(text, '\b(\d{2}[-/]\d{2}[-/]\d{4})\b', 1) AS dates,
         regexp_extract_all(text, '(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-\s/]*\d{2,4})\b', 1) AS named,
         len(list_distinct(regexp_extract_all(text, '\b([A-Z]{4}\d{5}[A-Z])\b', 1))) AS tans,
         len(list_distinct(regexp_extract_all(text, '\b([A-Z]{2}[A-Z]{3}\d{7}\d{3}\d{7}|[A-Z]{5}\d{17})\b', 1))) AS account_ids,
         len(regexp_extract_all(text, '(\b\d{1,3}(?:,\d{2,3})+(?:\.\d{2})?\b|\b\d+\.\d{2}\b)', 1)) AS amounts
  FROM texts"""),
    ("months", r"""
  SELECT doc_id, m FROM (
    SELECT doc_id, CAST(substr(d, 7, 4) AS INTEGER) * 12 + CAST(substr(d, 4, 2) AS INTEGER) - 1 AS m
    FROM (SELECT doc_id, unnest(dates) AS d FROM found) WHERE CAST(substr(d, 4, 2) AS INTEGER) BETWEEN 1 AND 12
    UNION
    SELECT doc_id, (CASE WHEN y < 100 THEN y + 2000 ELSE y END) * 12 +
           list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
                         lower(left(t, 3))) - 1
    FROM (SELECT doc_id, t, CAST(regexp_extract(t, '(\d{2,4})$', 1) AS INTEGER) AS y
          FROM (SELECT doc_id, unnest(named) AS t FROM found)))
  WHERE m BETWEEN 23880 AND 25211"""),
]


@query("corpus_profile", with_ctes(PROFILE) + r"""
, k AS (
  SELECT *, CASE WHEN regexp_matches(low, 'form\s*26as|annual tax statement|tax credit statement') THEN '26as'
                 WHEN regexp_matches(low, 'passbook|member\s*id|establishment') THEN 'passbook'
                 WHEN regexp_matches(low, 'annual information statement|\bais\b') THEN 'ais'
                 ELSE 'unknown' END AS kind,
         list_filter([
           CASE WHEN regexp_matches(low, 'annual tax statement|form\s*26as|tax credit statement') THEN 'statement header' END,
           CASE WHEN regexp_matches(low, 'part\s*[-\s]*a\b') THEN 'PART A (TDS on salary)' END,
           CASE WHEN regexp_matches(low, '\btan\s*of\s*deductor\b|\btan\b') THEN 'deductor TAN column' END,
           CASE WHEN regexp_matches(low, 'name\s*of\s*deductor') THEN 'deductor name column' END,
           CASE WHEN regexp_matches(low, '\b192\b|section') THEN 'section code (192)' END,
           CASE WHEN regexp_matches(low, 'transaction\s*date|date\s*of\s*(credit|payment)') THEN 'transaction date column' END,
           CASE WHEN regexp_matches(low, 'amount\s*paid|amount\s*credited') THEN 'amount paid/credited' END,
           CASE WHEN regexp_matches(low, 'tax\s*deducted|tds\s*deposited') THEN 'tax deducted column' END],
           lambda x: x IS NOT NULL) AS sa,
         list_filter([
           CASE WHEN regexp_matches(low, 'member\s*(id|passbook)|epf\s*passbook|passbook') THEN 'passbook header' END,
           CASE WHEN regexp_matches(low, 'establishment\s*(id|code)') THEN 'establishment ID' END,
           CASE WHEN regexp_matches(low, 'member\s*id') THEN 'member ID' END,
           CASE WHEN regexp_matches(low, 'date\s*of\s*joining|doj') THEN 'date of joining' END,
           CASE WHEN regexp_matches(low, 'date\s*of\s*exit|doe') THEN 'date of exit' END,
           CASE WHEN regexp_matches(low, 'wage\s*month|month\s*[-/]?\s*year') THEN 'wage month column' END,
           CASE WHEN regexp_matches(low, 'employee\s*share|ee\s*share') THEN 'employee share' END,
           CASE WHEN regexp_matches(low, 'employer\s*share|er\s*share') THEN 'employer share' END,
           CASE WHEN regexp_matches(low, 'pension|eps\s*contribution') THEN 'pension (EPS) column' END],
           lambda x: x IS NOT NULL) AS pa FROM found)
, t AS (
  SELECT k.*, coalesce(n, 0) AS months, coalesce(hi - lo + 1, 0) AS span_months
  FROM k LEFT JOIN (SELECT doc_id, count(*) AS n, min(m) AS lo, max(m) AS hi FROM months GROUP BY doc_id)
  USING (doc_id))
SELECT member_key, doc_id, kind, tans, account_ids, amounts, months, span_months,
       array_to_string(CASE kind WHEN '26as' THEN sa WHEN 'passbook' THEN pa ELSE list_concat(sa, pa) END, '|')
         AS anchors,
       CASE kind WHEN '26as' THEN tans >= 1 AND months >= 2 AND amounts >= 4
            WHEN 'passbook' THEN (list_contains(pa, 'member ID') OR account_ids >= 1)
              AND (list_contains(pa, 'wage month column') OR months >= 2) AND list_contains(pa, 'date of joining')
            ELSE true END AS usable
FROM t""")
def corpus_profile(spark, folder):
    return corpus.corpus_profile(
        derived.prose(spark, folder).unionByName(derived.histories(spark, folder)))


@query("document_names", """
SELECT CAST(o_custkey AS VARCHAR) AS member_key, o_orderkey || '-pb' AS doc_id, 'passbook' AS kind,
       'EPFO passbook' || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END
         AS label,
       2 * 1099511627776 + row_number() OVER w AS ord, 'MEMBER ' || o_custkey AS name
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey || '-pb')""")
def document_names(spark, folder):
    return records.extract_names(corpus.classify_documents(derived.mixed(spark, folder)))


@query("identities", with_ctes(RAW, MIXED_KINDS) + """
, filled AS (
  SELECT member_key, min(lpad(member_key, 12, '1')) AS uan FROM raw WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT k.member_key, CAST(NULL AS VARCHAR) AS pan, uan,
       CASE WHEN uan IS NOT NULL THEN DATE '1960-12-25' END AS dob,
       CASE WHEN uan IS NOT NULL THEN 1 ELSE 0 END AS n_dobs, '' AS dob_conflict
FROM (SELECT DISTINCT member_key FROM kinds) k LEFT JOIN filled USING (member_key)""")
def identities(spark, folder):
    read = records.read_for_identity(corpus.classify_documents(derived.mixed(spark, folder)))
    heads, _ = passbooks.passbook_tables(read.filter(F.col("kind") == "passbook").drop("kind", "pan"))
    return records.extract_identity(read, heads)


TYPED = [("typed", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, CAST(o_orderkey AS VARCHAR) AS account_id,
         o_orderpriority AS p, CAST(o_orderdate AS DATE) AS doj, CAST(last AS DATE) AS doe, o_orderstatus AS s
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey""")]

# dates as people type them, by priority: ISO order, slashes, nothing, dots, the 31st of February
_BAD = """CASE WHEN p = '3-MEDIUM' AND (s = 'F' OR doe IS NULL) THEN 'blank' WHEN p = '3-MEDIUM' THEN 'a joining date is needed'
     WHEN p = '1-URGENT' THEN 'joining date is not D-M-YYYY'
     WHEN p = '5-LOW' THEN 'joining date is not a real date'
     WHEN s <> 'F' AND doe < doj THEN 'exit before joining' END"""


def _typed(spark, folder):
    lines = adapters.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last"))
    orders = adapters.table(spark, folder, "orders").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    p = F.col("o_orderpriority")
    doj = (
        F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format("o_orderdate", "d/M/yyyy")).when(p == "3-MEDIUM", "")
        .when(p == "5-LOW", "31-02-2001").otherwise(F.date_format("o_orderdate", " dd.MM.yyyy ")))
    doe = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format("last", "dd-MM-yyyy"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("o_orderkey").cast("string").alias("account_id"), doj.alias("doj_raw"), doe.alias("doe_raw"))


@query("typed_history_accepted", with_ctes(TYPED) + f"""
SELECT member_key, account_id, doj, CASE WHEN s <> 'F' THEN doe END AS doe
FROM typed WHERE ({_BAD}) IS NULL""")
def typed_history_accepted(spark, folder):
    return records.validate_history_rows(_typed(spark, folder))[0]


@query("typed_history_rejected", with_ctes(TYPED) + f"""
SELECT member_key, account_id, {_BAD} AS reason FROM typed WHERE ({_BAD}) <> 'blank'
UNION ALL
SELECT member_key, NULL, 'nothing was entered' FROM typed
GROUP BY member_key HAVING bool_and(coalesce({_BAD}, '') = 'blank')""")
def typed_history_rejected(spark, folder):
    return records.validate_history_rows(_typed(spark, folder))[1]


# --------------------------------------------------------------------- letters

# long capitalised words and digit groups stand for dates and ids in the prose
PROSE_TOKENS = {"WORD": "([A-Z][a-z]{9,})", "NUMBER": "([0-9]{4,})"}


def _letters(spark, folder):
    documents = adapters.table(spark, folder, "documents")
    return documents.select(
        F.col("lang").alias("member_key"), F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("scope"), F.col("text").alias("body"),
        F.when(F.col("n_chars") < 1000, F.array().cast("array<string>"))
        .otherwise(F.array("source")).alias("annexure"))


def _ledger(spark, folder):
    """Facts from the documents judged good; those of documents without toxicity hold anywhere."""
    labels = adapters.table(spark, folder, "labels").filter(F.col("quality") == 1).select(
        F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    tokens = letters.letter_tokens(_letters(spark, folder), PROSE_TOKENS)
    return tokens.join(labels, "doc_id").select(
        "member_key", "kind", "value",
        F.when(F.col("toxic") == 1, None).otherwise(F.col("scope")).alias("scope"),
        F.col("doc_id").alias("source"))


LETTER = [
    ("tokens", """
  SELECT lang AS member_key, CAST(doc_id AS VARCHAR) AS doc_id, source AS scope, 'WORD' AS kind,
         unnest(regexp_extract_all(text, '([A-Z][a-z]{9,})', 1)) AS value FROM documents
  UNION ALL
  SELECT lang, CAST(doc_id AS VARCHAR), source, 'NUMBER',
         unnest(regexp_extract_all(text, '([0-9]{4,})', 1)) FROM documents"""),
    ("ledger", """
  SELECT member_key, kind, value, CASE WHEN toxic = 1 THEN NULL ELSE scope END AS scope
  FROM tokens t JOIN labels l ON t.doc_id = CAST(l.doc_id AS VARCHAR) WHERE quality = 1"""),
]


@query("letter_tokens", with_ctes(LETTER) + "SELECT * FROM tokens")
def letter_tokens(spark, folder):
    return letters.letter_tokens(_letters(spark, folder), PROSE_TOKENS)


@query("lint_letters", with_ctes(LETTER) + r"""
SELECT member_key, doc_id, 'UNSUPPORTED_FACT' AS violation, kind || '=' || value AS token,
       CASE WHEN (member_key, kind, value) IN (SELECT (member_key, kind, value) FROM ledger)
            THEN 'other scope' ELSE 'no evidence' END AS detail
FROM tokens t
WHERE (member_key, kind, value, scope) NOT IN
        (SELECT (member_key, kind, value, scope) FROM ledger WHERE scope IS NOT NULL)
  AND (member_key, kind, value) NOT IN (SELECT (member_key, kind, value) FROM ledger WHERE scope IS NULL)
UNION ALL
SELECT lang, CAST(doc_id AS VARCHAR), 'HEDGED_LANGUAGE', regexp_extract(text, p, 0), 'speculative wording'
FROM documents, (VALUES ('(?i)\b(approximately|roughly|around|about)\s+\d'),
  ('(?i)\b(I believe|it seems|possibly|presumably|may have been)\b'),
  ('(?i)\b(as per my recollection|to the best of my memory)\b')) h(p)
WHERE regexp_matches(text || chr(10) || source, p)
UNION ALL
SELECT lang, CAST(doc_id AS VARCHAR), 'NO_ANNEXURE', '-', 'no evidence attached'
FROM documents WHERE n_chars < 1000""")
def lint_letters(spark, folder):
    return letters.lint_letters(_letters(spark, folder), _ledger(spark, folder), PROSE_TOKENS)


@query("linkage_quality", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp,
                  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn,
                  count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn FROM labels)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""")
def linkage_quality(spark, folder):
    return linkage.linkage_quality(adapters.table(spark, folder, "labels").select(
        (F.col("quality") == 1).alias("linked"), (F.col("toxic") == 0).alias("should_link")))
