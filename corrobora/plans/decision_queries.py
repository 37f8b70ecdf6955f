"""Statements, decisions, plans and corrections over the order tables, with their SQL."""

import re
import uuid

from pyspark.sql import functions as F

from corrobora.operators import (
    corrections, detectors, envelopes, letters, money, orphans, planning, statements, verdicts,
)
from corrobora.plans import adapters
from corrobora.plans.evidence_queries import (
    AS_OF, ASR, DAY, FLAGS, FND, MEM, OBS, ORDERED, RECON, WIN, findings_of, inputs,
    reconstructed, self_exit_window, settled_lines, settled_parties, settled_tables,
)
from corrobora.plans.registry import query, with_ctes
from corrobora.session import cut_lineage, shared_folder
from corrobora.streaming import refresh

# ------------------------------------------------------------------ SQL pieces

LINES = [("lines", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, l_orderkey AS doc_id, r_regionkey + 1 AS block_no,
         l_linenumber AS line_no, r_name, o_orderpriority,
         'MUM' || left(r_name, 1) || lpad(CAST(r_regionkey AS VARCHAR), 5, '0') || 'B' AS tan,
         CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN '192'
              WHEN l_returnflag = 'N' THEN '192A' ELSE '194A' END AS section,
         CAST(l_shipdate AS DATE) AS txn_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_paid,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS tax_deducted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")]

DED = LINES + [("ded", """
  SELECT member_key, doc_id, block_no, any_value(r_name || ' ' || o_orderpriority) AS name,
         any_value(tan) AS tan, sum(amount_paid) AS total_paid, sum(tax_deducted) AS total_tds
  FROM lines GROUP BY member_key, doc_id, block_no""")]

MERGED = DED + [("merged", """
  SELECT member_key, tan, arg_min(name, {'l': -length(name), 'd': doc_id, 'b': block_no}) AS name,
         CAST(sum(total_paid) AS DOUBLE) AS total_paid, CAST(sum(total_tds) AS DOUBLE) AS total_tds,
         count(*) AS blocks, min(doc_id) AS first_doc, arg_min(block_no, doc_id) AS first_block
  FROM ded GROUP BY member_key, tan""")]

FACTS = OBS + [("facts", """
  SELECT member_key, CAST(c_acctbal AS DECIMAL(18,2)) * coalesce(service_months, 0) AS balance,
         coalesce(service_months, 0) AS service_months,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN lpad(member_key, 12, '0') END AS uan,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN 'PAN' || member_key END AS pan,
         c_nationkey > 0 AS has_dob, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS n_dobs,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'fail' ELSE 'pass' END AS name_status,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 0 ELSE 1 END AS n_spellings,
         c_mktsegment <> 'BUILDING' AS has_pan,
         abs(CAST(c_acctbal AS DECIMAL(18,2))) AS pensionable_salary
  FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS member_key FROM customer)
  LEFT JOIN (SELECT member_key, count(DISTINCT month_no) AS service_months FROM obs
             GROUP BY member_key) USING (member_key)""")]

EST = FACTS + [("est", """
  SELECT member_key, rule, CAST(greatest(balance, 0) AS DOUBLE) AS balance,
         CASE WHEN rule = 'taxed' THEN CASE WHEN has_pan THEN 0.1 ELSE 0.2 END ELSE 0 END AS rate,
         CASE WHEN rule = 'taxed' THEN 60 - service_months ELSE 0 END AS months_to_free,
         round(greatest(balance, 0) *
               CASE WHEN rule = 'taxed' THEN CASE WHEN has_pan THEN 0.1 ELSE 0.2 END ELSE 0 END, 2) AS tax
  FROM (SELECT *, CASE WHEN balance <= 0 THEN 'no balance' WHEN service_months >= 60 THEN 'five years'
                       WHEN balance <= 50000 THEN 'under threshold' ELSE 'taxed' END AS rule
        FROM facts)""")]

GATE = FACTS + FND + FLAGS + [
    ("bad", """
  SELECT member_key, bool_or(kind = 'MISSING_EXIT') AS me, bool_or(kind = 'EXIT_TOO_EARLY') AS ee,
         bool_or(kind = 'SERVICE_OVERLAP') AS so, bool_or(kind = 'CONTRIBUTION_GAP') AS cg
  FROM fnd WHERE severity = 'BLOCKING' GROUP BY member_key"""),
    ("lost", """
  SELECT member_key, count(*) AS likely FROM fnd WHERE kind = 'ORPHAN_ACCOUNT' GROUP BY member_key"""),
    ("gates", """
  SELECT member_key, unnest(['G01','G02','G03','G04','G05','G06','G07','G08','G09','G10','G11',
                             'G12','G13','G14']) AS gate,
         unnest([CASE WHEN uan IS NULL THEN 'unknown' ELSE 'pass' END, 'unknown',
           CASE WHEN pan IS NULL THEN 'unknown' ELSE 'pass' END, 'unknown', 'unknown', name_status,
           CASE WHEN n_dobs > 1 THEN 'fail' WHEN has_dob THEN 'pass' ELSE 'unknown' END,
           CASE WHEN NOT dates_checked THEN 'unknown' WHEN me THEN 'fail' ELSE 'pass' END,
           CASE WHEN NOT dates_checked THEN 'unknown' WHEN ee THEN 'fail' ELSE 'pass' END,
           CASE WHEN NOT dates_checked THEN 'unknown' WHEN so THEN 'fail' ELSE 'pass' END,
           CASE WHEN NOT dates_checked THEN 'unknown' WHEN likely > 0 THEN 'fail' ELSE 'pass' END,
           CASE WHEN NOT contributions_checked THEN 'unknown' WHEN cg THEN 'fail' ELSE 'pass' END,
           CASE WHEN dates_checked THEN 'pass' ELSE 'unknown' END,
           CASE WHEN balance <= 500000 THEN 'pass' ELSE 'fail' END]) AS status
  FROM facts JOIN flags USING (member_key) LEFT JOIN bad USING (member_key)
  LEFT JOIN lost USING (member_key)"""),
    ("gsum", """
  SELECT member_key, count(*) FILTER (WHERE status = 'pass') AS passed,
         count(*) FILTER (WHERE status = 'fail') AS failed,
         count(*) FILTER (WHERE status = 'unknown') AS unknown,
         count(*) FILTER (WHERE status = 'fail' AND gate <> 'G11') AS blocking_gates,
         count(*) FILTER (WHERE status = 'fail' AND gate = 'G11') AS advisory_gates
  FROM gates GROUP BY member_key"""),
]

STEP = ORDERED + [
    ("cons", """
  SELECT *, kind IN ('SERVICE_OVERLAP', 'ORPHAN_ACCOUNT') AS late
  FROM ordered WHERE severity IN ('BLOCKING', 'OPPORTUNITY')"""),
    ("shut", """
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS member_key, r_name AS party_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal < 0"""),
    ("firsts", "SELECT member_key, count(*) AS n_first FROM cons WHERE NOT late GROUP BY member_key"),
    ("step", """
  SELECT member_key, row_number() OVER (PARTITION BY member_key ORDER BY late, finding_no) AS step_no,
         kind, party_key, party_key_2, route,
         CASE WHEN NOT late AND route = 'JOINT_DECLARATION' AND shut.party_key IS NOT NULL THEN 30
              ELSE days END AS days,
         CASE WHEN late AND n_first > 0 THEN 2 ELSE 1 END AS wave,
         CASE WHEN late AND n_first > 0 THEN n_first ELSE 0 END AS n_deps
  FROM cons LEFT JOIN firsts USING (member_key) LEFT JOIN shut USING (member_key, party_key)"""),
    ("plan", """
  SELECT member_key, count(*) AS steps, max(wave) AS waves, CAST(sum(days) AS BIGINT) AS serial_days,
         coalesce(max(days) FILTER (WHERE wave = 1), 0) + coalesce(max(days) FILTER (WHERE wave = 2), 0)
           AS critical_days,
         CAST(coalesce(sum(days) FILTER (WHERE wave = 2), 0) AS BIGINT) AS wasted_days
  FROM step GROUP BY member_key"""),
]

CLM = [("clm", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, CAST(o_orderkey AS VARCHAR) AS tracking_id,
         o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed,
         CASE o_orderstatus WHEN 'F' THEN 'Claim Rejected' WHEN 'P' THEN 'Claim Settled'
              ELSE 'Under Process' END AS status FROM orders""")]

PRP = WIN + ASR + [
    ("prp", f"""
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, CAST(r_regionkey AS BIGINT) AS proposal_id,
         r_regionkey || '-' || o_custkey AS account_id, CAST(max(o_orderdate) AS DATE) AS proposed,
         arg_max(o_orderpriority, {{'d': o_orderdate, 'k': o_orderkey}}) AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY o_custkey, r_name, r_regionkey"""),
    ("ask", """
  SELECT p.*, a.party_key, a.doj, w.latest,
         (SELECT count(*) FROM asr b WHERE b.member_key = p.member_key AND b.account_id <> p.account_id
          AND b.doj <= p.proposed AND (b.doe IS NULL OR b.doe >= p.proposed)) AS clashes
  FROM prp p LEFT JOIN asr a USING (member_key, account_id)
  LEFT JOIN win w ON w.member_key = a.member_key AND w.party_key = a.party_key"""),
    ("chk", """
  SELECT member_key, account_id, proposal_id, 'supported by evidence' AS "check",
         coalesce(proposed >= latest, false) AS ok FROM ask
  UNION ALL SELECT member_key, account_id, proposal_id, 'after joining', proposed >= doj
  FROM ask WHERE doj IS NOT NULL
  UNION ALL SELECT member_key, account_id, proposal_id, 'no overlapping service', clashes = 0 FROM ask
  UNION ALL SELECT member_key, account_id, proposal_id, 'accepted document',
         priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') FROM ask"""),
    ("prs", f"""
  SELECT p.member_key, p.proposal_id, p.account_id, p.proposed,
         CASE WHEN bool_and(ok) THEN 'ready' ELSE 'returned' END AS state,
         count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS outstanding,
         {DAY} + 20 AS due
  FROM prp p JOIN chk USING (member_key, proposal_id)
  GROUP BY p.member_key, p.proposal_id, p.account_id, p.proposed"""),
]

CTB = [("ctb", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key,
         o_custkey || '-' || o_orderstatus || '-' || year(o_orderdate) AS doc_id,
         o_custkey || '-' || o_orderstatus AS account_id, year(o_orderdate) AS file_ord,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(o_totalprice AS DECIMAL(18,2)) AS employee,
         round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.25, 2) AS employer, 1250.00 AS pension,
         o_orderkey AS line_no, o_orderpriority, o_orderdate FROM orders""")]

ACC = CTB + [
    ("file", """
  SELECT member_key, account_id, doc_id, file_ord, max(month) AS last_month,
         CAST(min(o_orderdate) AS DATE) AS first_day,
         arg_max({'p': o_orderpriority, 'e': employee, 'r': employer, 'n': pension},
                 {'d': o_orderdate, 'k': line_no}) AS z
  FROM ctb GROUP BY ALL"""),
    ("acc", """
  SELECT member_key, account_id,
         arg_min(z.p, {'m': last_month, 'f': file_ord}) FILTER (WHERE z.p <> '5-LOW') AS establishment,
         arg_min(first_day, {'m': last_month, 'f': file_ord})
           FILTER (WHERE z.p <> '4-NOT SPECIFIED') AS doj,
         count(*) AS files, arg_max(z, {'m': last_month, 'f': file_ord}) AS latest
  FROM file GROUP BY member_key, account_id"""),
    ("acs", """
  SELECT member_key, account_id, count(DISTINCT month) AS months, count(*) AS rows,
         min(month) AS first_month, max(month) AS last_month, sum(employee + employer) AS fund,
         sum(pension) AS eps FROM ctb GROUP BY member_key, account_id"""),
    ("account", """
  SELECT member_key, account_id, establishment, doj, files, months, rows, first_month, last_month,
         CAST(CASE WHEN latest.p <> '1-URGENT' THEN latest.e + latest.r ELSE fund END AS DOUBLE)
           AS balance,
         CAST(CASE WHEN latest.p <> '1-URGENT' THEN latest.n ELSE eps END AS DOUBLE) AS pension
  FROM acc JOIN acs USING (member_key, account_id)"""),
]

ORP = WIN + ASR + [
    ("cand", """
  SELECT w.member_key, w.party_key, earliest AS first_seen, latest AS last_seen, months, gross_monthly
  FROM win w ANTI JOIN asr USING (member_key, party_key)
  JOIN (SELECT member_key, party_key, count(*) AS months, avg(CAST(amount AS DOUBLE)) AS gross_monthly
        FROM obs WHERE source = 'TDS_26AS' GROUP BY ALL) USING (member_key, party_key)"""),
    ("dir", """
  SELECT r_name AS est_name, 'EST' || lpad(CAST(r_regionkey AS VARCHAR), 12, '0') AS est_code,
         count(*) FILTER (WHERE s_acctbal > 0) > 0 AND r_name <> 'ASIA' AS covered,
         CAST(DATE '1996-01-01' + INTERVAL 1 YEAR * r_regionkey AS DATE) AS coverage_from
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
  WHERE r_name <> 'EUROPE' GROUP BY r_name, r_regionkey"""),
    ("judged", f"""
  SELECT *, date_diff('day', last_seen, {DAY}) / 365.25e0 AS y,
         CASE WHEN est_name IS NULL THEN 'UNCERTAIN' WHEN NOT covered OR months < 3 THEN 'UNLIKELY'
              ELSE 'LIKELY' END AS verdict,
         CASE WHEN est_name IS NULL THEN 'not in the register' WHEN NOT covered THEN 'not covered'
              WHEN months < 3 THEN 'too short' ELSE 'covered, unlinked' END AS reason
  FROM cand LEFT JOIN dir ON est_name = party_key"""),
    ("asm", """
  SELECT member_key, party_key, first_seen, last_seen, months, gross_monthly, est_name, est_code,
         verdict, reason, coalesce(covered AND first_seen < coverage_from, false) AS before_coverage,
         verdict = 'LIKELY' AND y > 3 AS inoperative,
         CASE WHEN verdict = 'LIKELY' THEN CAST(round_even(plow * g, -2) AS BIGINT) END AS low,
         CASE WHEN verdict = 'LIKELY' THEN CAST(round_even(phigh * g, -2) AS BIGINT) END AS high,
         CASE WHEN verdict = 'LIKELY' THEN CAST(round_even(plow, -2) AS BIGINT) END AS principal_low,
         CASE WHEN verdict = 'LIKELY' THEN CAST(round_even(phigh, -2) AS BIGINT) END AS principal_high,
         CASE WHEN verdict = 'LIKELY' THEN round_even(y, 1) END AS years
  FROM (SELECT *, pow(1.0815e0, greatest(0, y)) AS g,
               (gross_monthly * 0.4e0 * 0.12e0 + greatest(0, gross_monthly * 0.4e0 * 0.12e0
                 - least(gross_monthly * 0.4e0, 15000e0) * 0.0833e0)) * months AS plow,
               (gross_monthly * 0.5e0 * 0.12e0 + greatest(0, gross_monthly * 0.5e0 * 0.12e0
                 - least(gross_monthly * 0.5e0, 15000e0) * 0.0833e0)) * months AS phigh
        FROM judged)"""),
]

# ------------------------------------------------------------------ statements


@query("salary_only", with_ctes(LINES) + """
SELECT member_key, doc_id, block_no, line_no, section, txn_date,
       CAST(amount_paid AS DOUBLE) AS amount_paid, CAST(tax_deducted AS DOUBLE) AS tax_deducted, tan
FROM lines WHERE section IS NULL OR section IN ('192', '192A')""")
def salary_only(spark, folder):
    return statements.salary_only(adapters.transactions(spark, folder))


@query("verify_statements", with_ctes(LINES) + """
, header AS (
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, o_orderkey AS doc_id, 1 AS block_no,
         o_orderpriority AS tan, CAST(o_totalprice AS DECIMAL(18,2)) AS total_paid FROM orders)
SELECT h.member_key, h.doc_id, h.block_no, h.tan, 'paid' AS measure,
       CAST(coalesce(sum(amount_paid), 0) AS DOUBLE) AS detail_sum,
       CAST(total_paid AS DOUBLE) AS header_total,
       CAST(coalesce(sum(amount_paid), 0) - total_paid AS DOUBLE) AS difference
FROM header h LEFT JOIN lines USING (doc_id)
GROUP BY h.member_key, h.doc_id, h.block_no, h.tan, total_paid
HAVING abs(coalesce(sum(amount_paid), 0) - total_paid) > 1""")
def verify_statements(spark, folder):
    return statements.verify_statements(
        adapters.order_headers(spark, folder),
        adapters.transactions(spark, folder, whole_orders=True))


@query("merge_deductors", with_ctes(MERGED) + "SELECT * FROM merged")
def merge_deductors(spark, folder):
    return statements.merge_deductors(adapters.deductors(spark, folder))


@query("merge_passbooks", with_ctes(ACC) + "SELECT * FROM account")
def merge_passbooks(spark, folder):
    return _accounts(spark, folder).select(
        "member_key", "account_id", "establishment", "doj", "files", "months", "rows",
        "first_month", "last_month", "balance", "pension")


def _accounts(spark, folder):
    return statements.merge_passbooks(
        adapters.passbook_heads(spark, folder), adapters.contributions(spark, folder))


@query("related_ids", with_ctes(CTB) + """
SELECT DISTINCT member_key, member_key || '-F' AS related_id FROM ctb
WHERE member_key || '-F' NOT IN (SELECT account_id FROM ctb)""")
def related_ids(spark, folder):
    return statements.related_ids(adapters.passbook_heads(spark, folder))


@query("last_contributions", with_ctes(CTB) + """
SELECT member_key, account_id, month, CAST(employee AS DOUBLE) AS employee,
       CAST(employer AS DOUBLE) AS employer, CAST(pension AS DOUBLE) AS pension, position
FROM (SELECT *, row_number() OVER (PARTITION BY member_key
                                   ORDER BY month DESC, account_id, doc_id, line_no) AS position FROM ctb)
WHERE position <= 5""")
def last_contributions(spark, folder):
    return statements.last_contributions(adapters.contributions(spark, folder)).select(
        "member_key", "account_id", "month", "employee", "employer", "pension", "position")


@query("passbook_flags", with_ctes(ACC, ASR) + """
, mine AS (SELECT account_id AS a, member_key || '-F' AS id, CAST(min(o_orderdate) AS DATE) AS doe
           FROM ctb WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL)
SELECT member_key, account_id, last_month, doe,
       CASE WHEN last_month > doe THEN 'contributions after exit'
            WHEN doe IS NULL THEN 'no exit recorded' END AS flag
FROM account LEFT JOIN mine ON account_id = a""")
def passbook_flags(spark, folder):
    record = (
        adapters.contributions(spark, folder).filter(F.col("o_orderpriority") != "1-URGENT")
        .groupBy("member_key", "account_id")
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("doe"))
        .withColumn("ord", F.lit(0)))
    return statements.passbook_flags(_accounts(spark, folder), record)


@query("worklist", with_ctes(MERGED, ASR) + """
SELECT l.member_key, l.tan, min(txn_date) AS first_paid, max(txn_date) AS last_paid,
       count(*) AS salary_rows, any_value(m.name) AS name
FROM lines l JOIN merged m USING (member_key, tan)
WHERE (section IS NULL OR section IN ('192', '192A'))
  AND member_key NOT IN (SELECT member_key FROM asr) GROUP BY l.member_key, l.tan""")
def worklist(spark, folder):
    return statements.worklist(
        adapters.deductors(spark, folder), adapters.transactions(spark, folder),
        adapters.asserted(spark, folder))


@query("ingest_summary", with_ctes(DED, ASR, MEM, ACC) + """
, per_tan AS (
  SELECT member_key, tan, count(*) FILTER (WHERE section IS NULL OR section IN ('192', '192A')) AS s,
         count(*) FILTER (WHERE section = '194A') AS o FROM lines GROUP BY ALL)
SELECT member_key, coalesce(employers, 0) AS employers, coalesce(salary_rows, 0) AS salary_rows,
       coalesce(ignored_rows, 0) AS ignored_rows, 0 AS problems, coalesce(files, 0) AS files,
       coalesce(months, 0) AS months, coalesce(history_rows, 0) AS history_rows,
       coalesce(bank_rows, 0) AS bank_rows, coalesce(salary_credits, 0) AS salary_credits
FROM mem
LEFT JOIN (SELECT member_key, count(*) FILTER (WHERE s > 0) AS employers,
                  CAST(sum(s) AS BIGINT) AS salary_rows, CAST(sum(o) AS BIGINT) AS ignored_rows
           FROM per_tan GROUP BY 1) USING (member_key)
LEFT JOIN (SELECT member_key, count(*) AS files, CAST(sum(months) AS BIGINT) AS months
           FROM account GROUP BY 1) USING (member_key)
LEFT JOIN (SELECT member_key, count(*) AS history_rows FROM asr GROUP BY 1) USING (member_key)
LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS member_key, count(*) AS bank_rows,
                  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS salary_credits
           FROM orders GROUP BY 1) USING (member_key)""")
def ingest_summary(spark, folder):
    blocks = adapters.deductors(spark, folder)
    rows = adapters.transactions(spark, folder)
    bank = adapters.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("member_key"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_salary"))
    return statements.ingest_summary(
        adapters.members(spark, folder), blocks, rows,
        statements.verify_statements(blocks, rows), _accounts(spark, folder),
        adapters.asserted(spark, folder), bank)


@query("timeline_only", with_ctes(DED, ASR, MEM) + """
SELECT member_key, member_key IN (SELECT member_key FROM ded)
       AND member_key NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')
       AND member_key NOT IN (SELECT member_key FROM asr) AS timeline_only FROM mem""")
def timeline_only(spark, folder):
    """Partly shipped orders stand for passbooks."""
    passbooks = adapters.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").cast("string").alias("member_key"))
    return verdicts.timeline_only(
        adapters.members(spark, folder), passbooks, adapters.asserted(spark, folder),
        adapters.deductors(spark, folder))


@query("observations_from_documents", with_ctes(LINES, CTB) + """
SELECT member_key, r_name AS party_key, txn_date AS obs_date, 'TDS_26AS' AS source,
       CAST(amount_paid AS DOUBLE) AS amount, 'salary TDS' AS note, doc_id * 8 + line_no AS ord
FROM lines WHERE section IS NULL OR section IN ('192', '192A')
UNION ALL
SELECT DISTINCT member_key, right(account_id, 1), month, 'EPF_CONTRIB', CAST(NULL AS DOUBLE), '', 0
FROM ctb
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_orderdate AS DATE), 'BANK_SALARY',
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), 'salary credit', o_orderkey FROM orders""")
def observations_from_documents(spark, folder):
    region = adapters.table(spark, folder, "region").select(
        F.concat(F.lit("MUM"), F.substring("r_name", 1, 1),
                 F.lpad(F.col("r_regionkey").cast("string"), 5, "0"), F.lit("B")).alias("id"),
        F.col("r_name").alias("party_key"))
    seen = adapters.members(spark, folder)
    tax = (
        adapters.transactions(spark, folder)
        .join(region.withColumnRenamed("id", "tan"), "tan")
        .join(seen, "member_key", "left_semi")
        .withColumn("ord", F.col("doc_id") * 8 + F.col("line_no")))
    fund = adapters.contributions(spark, folder)
    months = fund.select(
        "member_key", F.substring_index("account_id", "-", -1).alias("party_key"), "month"
    ).distinct().withColumn("ord", F.lit(0).cast("bigint"))
    credits = adapters.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("o_orderstatus").alias("party_key"), F.col("o_orderdate").cast("date").alias("txn_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderkey").alias("ord"))
    return statements.observations_of(tax, months, credits)


@query("accounts_to_parties", with_ctes(LINES) + """
SELECT member_key, tan, doc_id, line_no, r_name AS party_key FROM lines""")
def accounts_to_parties(spark, folder):
    rows = adapters.transactions(spark, folder).select("member_key", "tan", "doc_id", "line_no")
    links = adapters._lines(spark, folder).select(
        F.col("o_custkey").cast("string").alias("member_key"), adapters.tan().alias("id"),
        F.col("r_name").alias("party_key")).distinct()
    return statements.to_parties(rows, links, "tan")


# ----------------------------------------------------------------------- money


@query("withdrawal_estimates", with_ctes(EST) + """
SELECT member_key, rule, balance, CAST(rate AS DOUBLE) AS tax_rate, CAST(tax AS DOUBLE) AS tax,
       round(balance - CAST(tax AS DOUBLE), 2) AS net, months_to_free FROM est""")
def withdrawal_estimates(spark, folder):
    return money.withdrawal_estimates(adapters.member_facts(spark, folder))


@query("withdrawal_portfolio", with_ctes(EST) + """
SELECT rule, count(*) AS members, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS balance,
       CAST(sum(CAST(tax AS DECIMAL(18,2))) AS DOUBLE) AS tax,
       CAST(sum(CAST(balance AS DECIMAL(18,2)) - CAST(tax AS DECIMAL(18,2))) AS DOUBLE) AS net
FROM est GROUP BY rule""")
def withdrawal_portfolio(spark, folder):
    return money.withdrawal_portfolio(withdrawal_estimates(spark, folder))


@query("pension_estimates", with_ctes(FACTS) + """
, p AS (SELECT member_key, service_months AS m, least(pensionable_salary, 15000) AS s FROM facts)
SELECT member_key, m >= 120 AS eligible, greatest(120 - m, 0) AS months_short,
       CASE WHEN m >= 120 THEN greatest(round(s * (m + CASE WHEN m >= 240 THEN 24 ELSE 0 END) / 840, 2),
                                        1000) END AS monthly,
       CASE WHEN m >= 120 THEN greatest(round(s * (m + CASE WHEN m >= 240 THEN 24 ELSE 0 END) / 840, 2),
                                        1000) ELSE round(s * 120 / 840, 2) END AS at_full_service
FROM p""")
def pension_estimates(spark, folder):
    return money.pension_estimates(adapters.member_facts(spark, folder))


@query("settlement_verdicts", with_ctes(FACTS, FND, FLAGS) + """
, s AS (
  SELECT f.*, dates_checked,
         (SELECT count(*) FROM fnd WHERE fnd.member_key = f.member_key AND severity = 'BLOCKING') AS b
  FROM facts f JOIN flags USING (member_key))
, v AS (
  SELECT *, CASE WHEN NOT dates_checked THEN 'unknown' WHEN b > 0 THEN 'blocked'
                 WHEN n_spellings > 1 THEN 'manual' WHEN balance > 500000 THEN 'manual'
                 ELSE 'auto' END AS mode FROM s)
SELECT member_key, mode, mode = 'manual' AND n_spellings <= 1 AND balance > 500000 AS ceiling_applies,
       CAST(CASE WHEN mode = 'auto' THEN round(balance * 0.75, 2) ELSE 0 END AS DOUBLE) AS upi_limit,
       CAST(CASE WHEN mode = 'auto' THEN round(balance * 0.50, 2) ELSE 0 END AS DOUBLE) AS atm_limit
FROM v""")
def settlement_verdicts(spark, folder):
    tables = settled_tables(spark, folder)
    asserted = tables[1]
    status = verdicts.claim_status(
        findings_of(spark, folder, tables), adapters.members(spark, folder), asserted)
    known = asserted.select("member_key").distinct().withColumn("checked", F.lit(True))
    members = (
        adapters.member_facts(spark, folder).join(status, "member_key")
        .join(known, "member_key", "left").fillna(False, ["checked"])
        .withColumn("amount", F.lit(None).cast("decimal(18,2)"))
        .withColumn("kyc_risk", F.col("n_spellings") > 1))
    return money.settlement_verdicts(members)


@query("kyc_items", with_ctes(FACTS) + """
SELECT member_key, unnest(['Name', 'UAN', 'PAN', 'Bank account', 'Aadhaar']) AS item,
       unnest([CASE WHEN n_spellings > 1 THEN 'risk' WHEN n_spellings = 1 THEN 'ok' ELSE 'unknown' END,
               CASE WHEN uan IS NULL THEN 'unknown' ELSE 'ok' END,
               CASE WHEN pan IS NULL THEN 'unknown' ELSE 'ok' END, 'unknown', 'unknown']) AS status
FROM facts""")
def kyc_items(spark, folder):
    return money.kyc_items(adapters.member_facts(spark, folder))


@query("kyc_summary", with_ctes(FACTS) + """
SELECT member_key, n_spellings <= 1 AS kyc_ready, true AS kyc_unverified FROM facts""")
def kyc_summary(spark, folder):
    return money.kyc_summary(kyc_items(spark, folder))


@query("declaration_routes", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'attested' ELSE 'online' END AS declaration
FROM supplier""")
def declaration_routes(spark, folder):
    return adapters.table(spark, folder, "supplier").select(
        "s_suppkey", money.declaration_route(F.col("s_acctbal") < 0).alias("declaration"))


@query("claim_form_status", with_ctes(GATE) + """
SELECT member_key, unnest(['Form 31', 'Form 19', 'Form 10C']) AS form,
       CASE WHEN NOT dates_checked THEN 'Not yet known' WHEN blocking_gates > 0 THEN 'Blocked'
            ELSE 'Open' END AS form_status,
       CASE WHEN blocking_gates > 0 THEN 'rejected' WHEN NOT dates_checked THEN 'not yet known'
            ELSE 'eligible' END AS claim_verdict
FROM gsum JOIN flags USING (member_key)""")
def claim_form_status(spark, folder):
    settled = _settled(spark, folder)
    flags = verdicts.checked_flags(envelopes.sources_in(settled[1]), settled[2], adapters.members(spark, folder))
    return money.claim_form_status(
        planning.gate_summary(_gates(spark, folder, settled)).join(flags, "member_key"))


# ------------------------------------------------------------- gates and plans


def _gate_members(spark, folder, parties, asserted, found, members=None):
    members = adapters.members(spark, folder) if members is None else members
    flags = verdicts.checked_flags(envelopes.sources_in(parties), asserted, members)
    likely = found.filter(F.col("kind") == "ORPHAN_ACCOUNT").groupBy("member_key").agg(
        F.count(F.lit(1)).alias("likely_orphans"))
    return (
        adapters.member_facts(spark, folder, envelopes.days_in(parties)).join(flags, "member_key")
        .join(likely, "member_key", "left").fillna(0, ["likely_orphans"]))


def _settled(spark, folder):
    """Evidence, party rows, record, findings and the order lines they come from, each written once."""
    lines = settled_lines(spark, folder)
    observations, parties, asserted = settled_parties(spark, folder, lines)
    found = cut_lineage(findings_of(spark, folder, (observations, asserted), parties))
    return observations, parties, asserted, found, lines


def _gates(spark, folder, settled=None, members=None):
    """The gates of all members, or of ``members`` if the settled tables are theirs alone."""
    _, parties, asserted, found, *_ = settled or _settled(spark, folder)
    return planning.gates(_gate_members(spark, folder, parties, asserted, found, members), found)


@query("gates", with_ctes(GATE) + "SELECT *, gate = 'G11' AS advisory FROM gates")
def gates(spark, folder):
    return _gates(spark, folder)


@query("gate_summary", with_ctes(GATE) + "SELECT * FROM gsum")
def gate_summary(spark, folder):
    return planning.gate_summary(_gates(spark, folder))


def closed_parties(lines):
    """Parties that dealt with a supplier in debt stand for closed establishments."""
    return lines.filter("in_debt").select(
        F.col("o_custkey").cast("string").alias("member_key"),
        F.col("r_name").alias("party_key")).distinct()


def _steps(spark, folder, settled=None):
    *_, found, lines = settled or _settled(spark, folder)
    return planning.plan_steps(found, closed_parties(lines))


@query("plan_steps", with_ctes(STEP) + "SELECT * FROM step")
def plan_steps(spark, folder):
    return _steps(spark, folder)


@query("plan_summary", with_ctes(STEP, MEM) + """
SELECT member_key, coalesce(steps, 0) AS steps, coalesce(waves, 0) AS waves,
       coalesce(serial_days, 0) AS serial_days, coalesce(critical_days, 0) AS critical_days,
       coalesce(wasted_days, 0) AS wasted_days, coalesce(serial_days - critical_days, 0) AS saved_days
FROM mem LEFT JOIN plan USING (member_key)""")
def plan_summary(spark, folder):
    return planning.plan_summary(_steps(spark, folder), adapters.members(spark, folder))


@query("next_step", with_ctes(STEP, GATE) + """
, opening AS (
  SELECT *, row_number() OVER (PARTITION BY member_key
           ORDER BY CASE WHEN route = 'SELF_SERVICE' THEN 0 ELSE 1 END, step_no) AS rn
  FROM step WHERE n_deps = 0)
SELECT f.member_key,
       CASE WHEN NOT dates_checked THEN 'ADD_HISTORY' WHEN o.kind IS NOT NULL THEN o.kind
            WHEN likely > 0 THEN 'BRING_ACCOUNT_ACROSS' END AS action,
       CASE WHEN dates_checked THEN o.party_key END AS party_key,
       CASE WHEN dates_checked THEN o.route END AS route
FROM flags f LEFT JOIN opening o ON o.member_key = f.member_key AND rn = 1
LEFT JOIN lost ON lost.member_key = f.member_key""")
def next_step(spark, folder):
    settled = _settled(spark, folder)
    flags = verdicts.checked_flags(envelopes.sources_in(settled[1]), settled[2], adapters.members(spark, folder))
    return planning.next_step(
        _steps(spark, folder, settled), flags, _gates(spark, folder, settled))


@query("notification_events", with_ctes(STEP, GATE, RECON, CLM) + f"""
SELECT member_key, {DAY} AS on_date, 'Action needed' AS event, NULL AS subject,
       blocking_gates AS figure, critical_days AS days, CAST(NULL AS DATE) AS opens_on
FROM gsum JOIN plan USING (member_key) WHERE blocking_gates > 0
UNION ALL
SELECT member_key, {DAY}, 'Action needed', NULL, blocking_gates, 0, NULL
FROM gsum ANTI JOIN plan USING (member_key) WHERE blocking_gates > 0
UNION ALL
SELECT member_key, {DAY}, CASE WHEN last_seen < DATE '2001-11-01' THEN 'You can fix this' ELSE 'Wait' END,
       party_key, 0, 0,
       CASE WHEN last_seen >= DATE '2001-11-01'
            THEN CAST(date_trunc('month', last_seen) + INTERVAL 2 MONTH AS DATE) END
FROM recon WHERE verdict = 'exit_missing'
UNION ALL
SELECT member_key, filed, 'Rejected', form, 0, 0, NULL FROM clm WHERE status = 'Claim Rejected'""")
def notification_events(spark, folder):
    settled = _settled(spark, folder)
    plans = planning.plan_summary(_steps(spark, folder, settled), adapters.members(spark, folder))
    exits = envelopes.self_exit_window(
        envelopes.reconstruct(envelopes.days_in(settled[1]), settled[2], settled[2]), AS_OF)
    return planning.notification_events(
        planning.gate_summary(_gates(spark, folder, settled)), plans, exits,
        adapters.claims(spark, folder), AS_OF)


# ----------------------------------------------------------------- corrections


@query("rejection_diagnoses", with_ctes(FND, CLM) + """
, dated AS (SELECT * FROM fnd WHERE severity = 'BLOCKING' AND first_evidence IS NOT NULL)
, hits AS (
  SELECT c.member_key, tracking_id, any_value(form) AS form, any_value(filed) AS filed,
         any_value(status) AS status, count(kind) AS n_causes,
         count(kind) FILTER (WHERE kind = 'MISSING_EXIT') AS m,
         count(kind) FILTER (WHERE kind = 'EXIT_TOO_EARLY') AS e,
         count(kind) FILTER (WHERE kind = 'CONTRIBUTION_GAP') AS g
  FROM clm c LEFT JOIN dated d ON c.member_key = d.member_key AND d.first_evidence <= c.filed
  WHERE status = 'Claim Rejected' GROUP BY c.member_key, tracking_id)
SELECT member_key, tracking_id, form, filed, status, n_causes, m + e > 0 AS confident,
       concat_ws('|', CASE WHEN m > 0 THEN 'MISSING_EXIT' END, CASE WHEN e > 0 THEN 'EXIT_TOO_EARLY' END,
                 CASE WHEN g > 0 THEN 'CONTRIBUTION_GAP' END) AS causes
FROM hits""")
def rejection_diagnoses(spark, folder):
    return corrections.diagnose_rejections(adapters.claims(spark, folder), findings_of(spark, folder))


def _checks(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return corrections.check_proposals(adapters.proposals(spark, folder), asserted, days)


@query("proposal_checks", with_ctes(PRP) + "SELECT * FROM chk")
def proposal_checks(spark, folder):
    return _checks(spark, folder)


@query("proposal_state", with_ctes(PRP) + "SELECT * FROM prs")
def proposal_state(spark, folder):
    return corrections.proposal_state(adapters.proposals(spark, folder), _checks(spark, folder))


def _ready(spark, folder, parties, asserted, lines=None):
    proposals = cut_lineage(adapters.proposals(spark, folder, lines))
    state = corrections.proposal_state(
        proposals, corrections.check_proposals(proposals, asserted, parties))
    return cut_lineage(state.filter(F.col("state") == "ready"))


# the same SQL chain, over the record with ready dates in place
_OVERLAID = [("asr0", ASR[0][1])] + [
    (n, b.replace("FROM asr", "FROM asr0").replace("JOIN asr", "JOIN asr0")) for n, b in PRP if n != "asr"
] + [("asr", """
  SELECT a.* REPLACE (coalesce(p.proposed, a.doe) AS doe)
  FROM asr0 a LEFT JOIN (SELECT * FROM prs WHERE state = 'ready') p USING (member_key, account_id)""")]


@query("overlaid_record", with_ctes(_OVERLAID) + "SELECT * FROM asr")
def overlaid_record(spark, folder):
    _, parties, asserted = settled_parties(spark, folder)
    return corrections.overlay(asserted, _ready(spark, folder, parties, asserted))


def _corrected(spark, folder):
    """Of the members with ready proposals: evidence, party rows and record, the proposals, and the record with them in place.

    Others are cut away before the detectors read anything, as a member's findings come from nobody else's rows.
    """
    lines = settled_lines(spark, folder)
    observations, parties, asserted = settled_parties(spark, folder, lines)
    ready = _ready(spark, folder, parties, asserted, lines)
    touched = cut_lineage(ready.select("member_key").distinct())
    parties = cut_lineage(parties.join(touched, "member_key", "left_semi"))
    record = cut_lineage(asserted.join(touched, "member_key", "left_semi"))
    return observations, parties, record, ready, cut_lineage(corrections.overlay(record, ready)), touched


@query("findings_after_corrections", with_ctes(_OVERLAID, FND) + f"""
SELECT {', '.join(detectors.FINDING_COLUMNS)} FROM fnd
WHERE member_key IN (SELECT member_key FROM prs WHERE state = 'ready')""")
def findings_after_corrections(spark, folder):
    observations, parties, _, ready, after, _ = _corrected(spark, folder)
    found = detectors.all_findings(observations, after, AS_OF, parties=envelopes.with_records(parties, after))
    return found.join(ready.select("member_key").distinct(), "member_key", "left_semi")


def _renamed(parts, suffix):
    """A chain of SQL fragments under names of its own."""
    names = "|".join(n for n, _ in parts)
    again = lambda text: re.sub(rf"\b(?<!')({names})\b(?!\()", rf"\1{suffix}", text)
    return [(n + suffix, again(b)) for n, b in parts]


@query("gates_cleared", with_ctes(_renamed(GATE, "_now"), _OVERLAID, GATE) + """
SELECT g.member_key, g.gate FROM gates_now g
WHERE g.status = 'fail' AND g.gate <> 'G11'
  AND g.member_key IN (SELECT member_key FROM prs WHERE state = 'ready')
  AND (g.member_key, g.gate) NOT IN
      (SELECT (member_key, gate) FROM gates WHERE status = 'fail' AND gate <> 'G11')""")
def gates_cleared(spark, folder):
    observations, parties, asserted, ready, corrected, touched = _corrected(spark, folder)
    members = adapters.members(spark, folder).join(touched, "member_key", "left_semi")
    before = cut_lineage(detectors.all_findings(observations, asserted, AS_OF, parties=parties))
    after = cut_lineage(detectors.all_findings(
        observations, corrected, AS_OF, parties=envelopes.with_records(parties, corrected)))
    return corrections.gates_cleared(
        _gates(spark, folder, (observations, parties, asserted, before), members),
        _gates(spark, folder, (observations, parties, corrected, after), members), ready)


@query("supporting_facts", with_ctes(FND, FACTS) + """
, early AS (SELECT DISTINCT member_key, party_key FROM fnd WHERE kind = 'EXIT_TOO_EARLY')
, facing AS (SELECT * FROM asr JOIN early USING (member_key, party_key))
SELECT DISTINCT member_key, 'UAN' AS kind, coalesce(uan, '') AS value, NULL AS scope,
       'passbook header' AS source FROM early JOIN facts USING (member_key)
UNION ALL SELECT member_key, 'MEMBER_ID', account_id, party_key, 'passbook header' FROM facing
UNION ALL SELECT member_key, 'DATE', strftime(doe, '%d-%m-%Y'), party_key, 'service history' FROM facing
UNION ALL
SELECT member_key, 'DATE', strftime(obs_date, '%d-%m-%Y'), party_key, 'statement salary entry'
FROM (SELECT o.*, row_number() OVER (PARTITION BY member_key, party_key
                                     ORDER BY obs_date DESC, o.ord) AS rn
      FROM obs o JOIN facing USING (member_key, party_key)
      WHERE source = 'TDS_26AS' AND obs_date > doe) WHERE rn <= 3
UNION ALL
SELECT member_key, 'DATE', strftime(e, '%d-%m-%Y'), party_key, 'corrected boundary'
FROM corrected JOIN early USING (member_key, party_key)""")
def supporting_facts(spark, folder):
    observations, parties, asserted, found, _ = _settled(spark, folder)
    corrected = detectors.corrected_timeline(asserted, envelopes.party_windows(parties), AS_OF)
    return letters.supporting_facts(
        found, asserted, observations, corrected,
        adapters.member_facts(spark, folder, envelopes.days_in(parties)).select("member_key", "uan"))


# --------------------------------------------------------------------- orphans


def directory(spark, folder):
    """Regions as the register of establishments; one is missing and one not covered."""
    return (
        adapters.table(spark, folder, "region").filter(F.col("r_name") != "EUROPE")
        .join(adapters.table(spark, folder, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(adapters.table(spark, folder, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "r_regionkey").agg(F.count_if(F.col("s_acctbal") > 0).alias("sound"))
        .select(
            F.col("r_name").alias("est_name"),
            F.concat(F.lit("EST"), F.lpad(F.col("r_regionkey").cast("string"), 12, "0")).alias("est_code"),
            ((F.col("sound") > 0) & (F.col("r_name") != "ASIA")).alias("covered"),
            F.make_date(F.lit(1996) + F.col("r_regionkey"), F.lit(1), F.lit(1)).alias("coverage_from"))
    )


def _candidates(spark, folder):
    observations, days, asserted = inputs(spark, folder)
    lost = detectors.orphans(envelopes.support_windows(days), asserted)
    return orphans.orphan_candidates(observations, lost)


def _assessed(spark, folder):
    register = directory(spark, folder)
    candidates = _candidates(spark, folder)
    resolved = candidates.join(register, candidates["party_key"] == register["est_name"], "left")
    return orphans.assess_orphans(resolved, AS_OF)


@query("orphan_candidates", with_ctes(ORP) + "SELECT * FROM cand")
def orphan_candidates(spark, folder):
    return _candidates(spark, folder)


@query("assess_orphans", with_ctes(ORP) + "SELECT * FROM asm")
def assess_orphans(spark, folder):
    return _assessed(spark, folder)


@query("recovery_steps", with_ctes(ORP) + """
, likely AS (
  SELECT * FROM (VALUES (1, 'TRACE_ID', NULL), (2, 'CHECK_OWN_PAPERS', NULL),
    (3, 'FILE_TRANSFER', 'ID_FOUND'),
    (4, 'ESCALATE', 'TRACE_FAILED')) t(n, action, blocked_by))
SELECT member_key, party_key, verdict, n AS step_no, action, blocked_by
FROM asm, likely WHERE verdict IN ('LIKELY', 'UNCERTAIN')
UNION ALL
SELECT member_key, party_key, verdict, 0, 'CONFIRM_NAME', NULL
FROM asm WHERE verdict = 'UNCERTAIN'""")
def recovery_steps(spark, folder):
    return orphans.recovery_steps(_assessed(spark, folder))


@query("account_list", with_ctes(ACC, ORP) + """
SELECT member_key, account_id AS account, false AS orphan, months, balance, pension FROM account
UNION ALL
SELECT member_key, party_key, true, months, 0, 0 FROM asm WHERE verdict = 'LIKELY'""")
def account_list(spark, folder):
    return statements.account_list(_accounts(spark, folder), _assessed(spark, folder))


@query("member_totals", with_ctes(ACC, ORP, MEM) + """
SELECT member_key, round(coalesce(b, 0), 2) AS balance, round(coalesce(p, 0), 2) AS pension,
       coalesce(m, 0) AS service_months, coalesce(m, 0) >= 120 AS pension_eligible,
       coalesce(low, 0) AS forgotten_low
FROM mem LEFT JOIN (SELECT member_key, sum(balance) AS b, sum(pension) AS p,
                           CAST(sum(months) AS BIGINT) AS m FROM account GROUP BY 1) USING (member_key)
LEFT JOIN (SELECT member_key, CAST(sum(low) AS BIGINT) AS low FROM asm GROUP BY 1) USING (member_key)""")
def member_totals(spark, folder):
    return statements.member_totals(
        adapters.members(spark, folder), _accounts(spark, folder), _assessed(spark, folder))


# ------------------------------------------------------------------- streaming


@query("findings_from_stream", with_ctes(FND) + f"""
SELECT {', '.join(detectors.FINDING_COLUMNS)} FROM fnd""")
def findings_from_stream(spark, folder):
    """Evidence handed in as files over three batches must end in the findings of the batch plan."""
    store = f"{shared_folder(spark).rstrip('/')}/corrobora-stream-{uuid.uuid4().hex}"
    turn = F.pmod(F.xxhash64("party_key", "obs_date", "source"), F.lit(3))
    observations, asserted = settled_tables(spark, folder)
    for batch in range(3):
        observations.filter(turn == batch).write.mode("append").option("compression", "zstd").parquet(f"{store}/in")
        refresh.refresh_findings_stream(
            refresh.evidence_stream(spark, f"{store}/in"), store, asserted, AS_OF, f"{store}/state",
            buckets=8).awaitTermination()
    return refresh.current_findings(spark, store)
