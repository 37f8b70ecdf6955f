"""Evidence, detectors and findings over the order tables, each beside its SQL counterpart."""

from pyspark.sql import functions as F

from corrobora.operators import detectors, envelopes, verdicts
from corrobora.plans import adapters
from corrobora.plans.registry import query, with_ctes
from corrobora.session import cut_lineage

AS_OF = adapters.AS_OF
DAY = f"DATE '{AS_OF.isoformat()}'"

OBS = [("obs", """
  SELECT CAST(o_custkey AS VARCHAR) AS member_key, r_name AS party_key,
         CAST(l_shipdate AS DATE) AS obs_date,
         CASE l_returnflag WHEN 'R' THEN 'EPF_CONTRIB' WHEN 'N' THEN 'TDS_26AS'
              ELSE 'BANK_SALARY' END AS source,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
         l_orderkey * 8 + l_linenumber AS ord,
         year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month_no,
         CAST(CASE WHEN l_returnflag = 'R' THEN date_trunc('month', l_shipdate)
              ELSE l_shipdate END AS DATE) AS stamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")]

ASR = [("asr", """
  SELECT * EXCLUDE (last_filled, last_status),
         CASE WHEN last_status <> 'O' THEN last_filled END AS doe
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS member_key, r_name AS party_key,
               r_regionkey || '-' || o_custkey AS account_id, CAST(r_regionkey AS BIGINT) AS ord,
               CAST(min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS DATE) AS doj,
               CAST(max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS DATE) AS last_filled,
               arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS last_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY o_custkey, r_name, r_regionkey)
  WHERE doj IS NOT NULL""")]

MEM = [("mem", "SELECT CAST(c_custkey AS VARCHAR) AS member_key FROM customer")]

WIN = OBS + [("win", """
  SELECT member_key, party_key, min(obs_date) AS earliest, max(obs_date) AS latest,
         string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
         count(DISTINCT source) AS n_sources, count(*) AS n_obs, min(ord) AS first_ord
  FROM obs GROUP BY member_key, party_key""")]

EXF = WIN + ASR + [
    ("exits", "SELECT DISTINCT member_key, party_key, doe FROM asr WHERE doe IS NOT NULL"),
    ("later", """
  SELECT member_key, party_key, doe, count(*) AS n_later, count(DISTINCT source) AS later_sources,
         count(DISTINCT month_no) AS later_months, min(stamp) AS first_stamp,
         bool_or(source = 'EPF_CONTRIB') AS fund_later
  FROM exits JOIN obs USING (member_key, party_key) WHERE obs_date > doe
  GROUP BY member_key, party_key, doe"""),
    ("usual", """
  SELECT member_key, party_key, doe,
         list_sort(list(amount))[count(*) // 2 + 1] AS usual_amount
  FROM exits JOIN obs USING (member_key, party_key)
  WHERE obs_date <= doe AND amount IS NOT NULL GROUP BY member_key, party_key, doe"""),
    ("odd", """
  SELECT DISTINCT member_key, party_key, doe
  FROM usual JOIN obs USING (member_key, party_key)
  WHERE obs_date > doe AND usual_amount > 0 AND amount IS NOT NULL
    AND abs(amount - usual_amount) > 0.35 * usual_amount"""),
    ("exf", """
  SELECT l.member_key, l.party_key, l.doe, n_later, later_sources, later_months, first_stamp,
         NOT fund_later AND later_months <= 2 AND odd.doe IS NOT NULL AS settlement
  FROM later l LEFT JOIN odd USING (member_key, party_key, doe)"""),
]

LAST3 = OBS + [("last3", """
  SELECT member_key, party_key, min(stamp) AS last_cited
  FROM (SELECT *, row_number() OVER (PARTITION BY member_key, party_key
                                     ORDER BY obs_date DESC, ord DESC, source DESC) AS rn FROM obs)
  WHERE rn <= 3 GROUP BY member_key, party_key""")]


def _ago(a, b):
    return f"((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})))"


REC = EXF + LAST3 + [
    ("joined", f"""
  SELECT a.*, w.earliest, w.latest, x.n_later, x.later_sources, x.first_stamp, x.settlement,
         c.last_cited
  FROM asr a JOIN win w USING (member_key, party_key)
  LEFT JOIN last3 c USING (member_key, party_key)
  LEFT JOIN exf x USING (member_key, party_key, doe)"""),
    ("rec", f"""
  SELECT member_key, 'MISSING_EXIT' AS kind, party_key, NULL AS party_key_2, account_id,
         'BLOCKING' AS severity, {_ago('latest', DAY)} AS measure, 0 AS n_sources,
         last_cited AS first_evidence, 'set the date of exit' AS fix, 'SELF_SERVICE' AS route,
         1 AS days, 0 AS phase, ord * 4 AS ord
  FROM joined WHERE doe IS NULL AND {_ago('latest', DAY)} >= 2
  UNION ALL
  SELECT member_key, 'TRAILING_PAYOUT', party_key, NULL, account_id, 'DEGRADED', n_later,
         later_sources, first_stamp, 'confirm with the payslip, file nothing', 'GRIEVANCE', 30, 0,
         ord * 4 + 1
  FROM joined WHERE n_later IS NOT NULL AND settlement
  UNION ALL
  SELECT member_key, 'EXIT_TOO_EARLY', party_key, NULL, account_id,
         CASE WHEN later_sources >= 2 THEN 'BLOCKING' ELSE 'DEGRADED' END, n_later, later_sources,
         first_stamp, 'correct the date of exit', 'JOINT_DECLARATION', 20, 0, ord * 4 + 1
  FROM joined WHERE n_later IS NOT NULL AND NOT settlement
  UNION ALL
  SELECT member_key, 'JOIN_SUSPECT', party_key, NULL, account_id, 'DEGRADED',
         {_ago('doj', 'earliest')}, 0, NULL, 'verify the date of joining', 'JOINT_DECLARATION', 20, 0,
         ord * 4 + 2
  FROM joined WHERE {_ago('doj', 'earliest')} > 1"""),
]

TIMELINE = WIN + ASR + [
    ("stated", f"SELECT member_key, party_key, ord, doj AS s, coalesce(doe, {DAY}) AS e FROM asr"),
    ("corrected", """
  SELECT member_key, party_key, st.ord, least(s, coalesce(earliest, s)) AS s,
         greatest(e, coalesce(latest, e)) AS e
  FROM stated st LEFT JOIN win USING (member_key, party_key)"""),
]


def _overlaps(source):
    return f"""
  SELECT member_key, party_key, party_key_2, s AS a_start, e AS a_end, b_start,
         date_diff('day', b_start, e) + 1 AS overlap_days, ord
  FROM (SELECT *, lead(party_key) OVER w AS party_key_2, lead(s) OVER w AS b_start
        FROM {source} WINDOW w AS (PARTITION BY member_key ORDER BY s, ord))
  WHERE e >= b_start"""


OVL = TIMELINE + [
    ("ovl", _overlaps("stated")),
    ("ovc", f"""SELECT c.* FROM ({_overlaps('corrected')}) c
  ANTI JOIN ovl USING (member_key, party_key, party_key_2)"""),
]

GAP = OBS + [
    ("pm", """
  SELECT member_key, party_key, month_no, bool_or(source = 'EPF_CONTRIB') AS in_fund,
         bool_or(source = 'TDS_26AS') AS in_tax
  FROM obs WHERE source IN ('EPF_CONTRIB', 'TDS_26AS') GROUP BY ALL"""),
    ("bounds", """
  SELECT member_key, party_key, min(month_no) AS lo, max(month_no) AS hi
  FROM pm WHERE in_fund GROUP BY ALL"""),
    ("gm", """
  SELECT member_key, party_key, month_no, lo, hi FROM pm JOIN bounds USING (member_key, party_key)
  WHERE in_tax AND NOT in_fund AND month_no > lo AND month_no < hi"""),
    ("gr", """
  SELECT member_key, party_key, lo, hi, min(month_no) AS a, max(month_no) AS b, count(*) AS n
  FROM (SELECT *, month_no - row_number() OVER (PARTITION BY member_key, party_key
                                                ORDER BY month_no) AS island FROM gm)
  GROUP BY member_key, party_key, lo, hi, island"""),
    ("gap", """
  SELECT member_key, party_key, lo AS fund_first, hi AS fund_last, CAST(sum(n) AS BIGINT) AS n_months,
         count(*) AS n_runs,
         string_agg(CASE WHEN a = b THEN strftime(make_date(a // 12, a % 12 + 1, 1), '%Y-%m')
                    ELSE strftime(make_date(a // 12, a % 12 + 1, 1), '%Y-%m') || ' to ' ||
                         strftime(make_date(b // 12, b % 12 + 1, 1), '%Y-%m') END,
                    ', ' ORDER BY a) AS spans
  FROM gr GROUP BY ALL"""),
]

FND = REC + OVL + GAP + [("fnd", f"""
  SELECT * FROM rec
  UNION ALL
  SELECT member_key, 'SERVICE_OVERLAP', party_key, party_key_2, NULL, 'BLOCKING', overlap_days, 0,
         NULL, 'correct the boundary the evidence contradicts', 'JOINT_DECLARATION', 20, 1,
         date_diff('day', DATE '1970-01-01', a_start) * 4294967296 + ord FROM ovl
  UNION ALL
  SELECT member_key, 'CORRECTION_CONFLICT', party_key, party_key_2, NULL, 'DEGRADED', overlap_days, 0,
         NULL, 'establish which service ended first, file nothing yet', 'GRIEVANCE', 30, 2,
         date_diff('day', DATE '1970-01-01', a_start) * 4294967296 + ord FROM ovc
  UNION ALL
  SELECT member_key, 'ORPHAN_ACCOUNT', party_key, NULL, NULL, 'OPPORTUNITY',
         {_ago('earliest', 'latest')} + 1, 0, NULL, 'trace the account and file a transfer claim',
         'CLAIM_ORPHAN', 20, 3, first_ord
  FROM win ANTI JOIN asr USING (member_key, party_key)
  UNION ALL
  SELECT member_key, 'CONTRIBUTION_GAP', party_key, NULL, NULL, 'BLOCKING', n_months, 0,
         make_date(fund_first // 12, fund_first % 12 + 1, 1), 'have the missing months deposited',
         'GRIEVANCE', 30, 4, 0 FROM gap""")]

FINDING_LIST = ", ".join(detectors.FINDING_COLUMNS)

ORDERED = FND + [("ranked", """
  SELECT *, CASE severity WHEN 'BLOCKING' THEN 0 WHEN 'DEGRADED' THEN 1 ELSE 2 END AS severity_rank
  FROM fnd"""), ("ordered", """
  SELECT *, row_number() OVER (PARTITION BY member_key
                               ORDER BY severity_rank, phase, ord, party_key, kind) AS finding_no
  FROM ranked""")]

STATUS = FND + MEM + [("status", """
  SELECT m.member_key, count(f.kind) FILTER (WHERE severity = 'BLOCKING') AS blocking_count,
         count(f.kind) AS finding_count,
         CASE WHEN count(f.kind) FILTER (WHERE severity = 'BLOCKING') > 0 THEN 'WILL_BE_REJECTED'
              WHEN m.member_key IN (SELECT member_key FROM asr) THEN 'LIKELY_TO_SETTLE'
              ELSE 'NOT_CHECKED' END AS claim_status
  FROM mem m LEFT JOIN fnd f USING (member_key) GROUP BY m.member_key""")]

RECON = WIN + ASR + [("recon", """
  SELECT w.member_key, w.party_key, a.account_id, a.doj AS asserted_doj, a.doe AS asserted_doe,
         earliest AS first_seen, latest AS last_seen, sources, n_sources,
         CASE WHEN n_sources >= 3 THEN 'High' WHEN n_sources = 2 THEN 'Medium' ELSE 'Low' END
           AS confidence,
         CASE WHEN a.doj IS NULL AND w.member_key IN (SELECT member_key FROM asr) THEN 'unlinked'
              WHEN a.doj IS NULL THEN 'unchecked'
              WHEN a.doe IS NULL THEN 'exit_missing'
              WHEN a.doe < latest THEN 'exit_wrong'
              WHEN a.doj > earliest THEN 'join_wrong' ELSE 'agrees' END AS verdict
  FROM win w LEFT JOIN asr a USING (member_key, party_key)""")]


def inputs(spark, folder):
    observations = adapters.observations(spark, folder)
    return observations, envelopes.evidence_days(observations), adapters.asserted(spark, folder)


def settled_inputs(spark, folder, lines=None):
    """The same tables for plans that read each of them many times: order lines are joined and written once."""
    observations, parties, asserted = settled_parties(spark, folder, lines)
    return observations, envelopes.days_in(parties), asserted


def settled_parties(spark, folder, lines=None):
    """Observations, one written row per party with its days and its records, and the record."""
    observations, asserted = settled_tables(spark, folder, lines)
    return observations, cut_lineage(envelopes.party_rows(observations, asserted)), asserted


def settled_tables(spark, folder, lines=None):
    lines = settled_lines(spark, folder) if lines is None else lines
    return adapters.observations(spark, folder, lines), cut_lineage(adapters.asserted(spark, folder, lines))


def settled_lines(spark, folder):
    return cut_lineage(adapters.party_lines(spark, folder))


def findings_of(spark, folder, tables=None, parties=None):
    observations, asserted = tables or settled_tables(spark, folder)
    return detectors.all_findings(observations, asserted, AS_OF, parties=parties)


@query("evidence_days", with_ctes(OBS) + """
SELECT member_key, party_key, source, obs_date, count(*) AS n_obs, min(ord) AS first_ord,
       CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount
FROM obs GROUP BY member_key, party_key, source, obs_date""")
def evidence_days(spark, folder):
    return inputs(spark, folder)[1]


@query("support_windows", with_ctes(WIN) + "SELECT * FROM win")
def support_windows(spark, folder):
    return envelopes.support_windows(inputs(spark, folder)[1])


@query("evidence_confidence", with_ctes(OBS) + """
SELECT member_key, party_key, count(*) AS n_sources, round(1 - product(miss), 4) AS confidence
FROM (SELECT DISTINCT member_key, party_key,
             CASE source WHEN 'EPF_CONTRIB' THEN 1 - 0.95e0 WHEN 'TDS_26AS' THEN 1 - 0.90e0
                         ELSE 1 - 0.65e0 END AS miss
      FROM obs) GROUP BY member_key, party_key""")
def evidence_confidence(spark, folder):
    return envelopes.evidence_confidence(envelopes.support_windows(inputs(spark, folder)[1]))


@query("attach_asserted", with_ctes(WIN, ASR) + """
SELECT a.*, earliest, latest, coalesce(n_sources, 0) AS n_sources
FROM asr a LEFT JOIN win USING (member_key, party_key)""")
def attach_asserted(spark, folder):
    _, days, asserted = inputs(spark, folder)
    windows = envelopes.support_windows(days).select(
        *envelopes.PARTY, "earliest", "latest", "n_sources")
    return asserted.join(windows, envelopes.PARTY, "left").fillna(0, ["n_sources"])


@query("month_runs", with_ctes(OBS) + """
SELECT member_key, party_key, source, make_date(min(m) // 12, min(m) % 12 + 1, 1) AS run_start,
       CAST(last_day(make_date(max(m) // 12, max(m) % 12 + 1, 1)) AS DATE) AS run_end,
       count(*) AS n_months
FROM (SELECT member_key, party_key, source, m,
             m - row_number() OVER (PARTITION BY member_key, party_key, source ORDER BY m) AS island
      FROM (SELECT DISTINCT member_key, party_key, source, month_no AS m FROM obs))
GROUP BY member_key, party_key, source, island""")
def month_runs(spark, folder):
    return envelopes.month_runs(inputs(spark, folder)[1])


@query("event_day_runs", """
SELECT user_id, event_type, min(d) AS run_start, max(d) AS run_end, count(*) AS n_days
FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY d) AS INTEGER)
             AS island
      FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events))
GROUP BY user_id, event_type, island""")
def event_day_runs(spark, folder):
    events = adapters.table(spark, folder, "events").select(
        "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return envelopes.day_runs(events, ["user_id", "event_type"], "day")


CITE = """
SELECT member_key, party_key, {number} AS cite_no, obs_date, stamp,
       source || '@' || left(CAST(obs_date AS VARCHAR), CASE WHEN source = 'EPF_CONTRIB' THEN 7 ELSE 10 END) AS citation
FROM (SELECT *, row_number() OVER (PARTITION BY member_key, party_key
                                   ORDER BY obs_date {way}, ord {way}, source {way}) AS rn FROM obs)
WHERE rn <= 3"""


@query("cite_first", with_ctes(OBS) + CITE.format(number="rn", way="ASC"))
def cite_first(spark, folder):
    return envelopes.cite_first(adapters.observations(spark, folder))


@query("cite_last", with_ctes(OBS) + CITE.format(number="-rn", way="DESC"))
def cite_last(spark, folder):
    return envelopes.cite_last(adapters.observations(spark, folder))


@query("timeline_segments", with_ctes(OBS, ASR) + f"""
, runs AS (
  SELECT member_key, party_key, source, make_date(min(m) // 12, min(m) % 12 + 1, 1) AS run_start,
         CAST(last_day(make_date(max(m) // 12, max(m) % 12 + 1, 1)) AS DATE) AS run_end
  FROM (SELECT member_key, party_key, source, m,
               m - row_number() OVER (PARTITION BY member_key, party_key, source ORDER BY m) AS island
        FROM (SELECT DISTINCT member_key, party_key, source, month_no AS m FROM obs))
  GROUP BY member_key, party_key, source, island)
, segments AS (
  SELECT r.*, coalesce(run_end > doe, false) AS after_exit
  FROM runs r LEFT JOIN asr USING (member_key, party_key)
  UNION ALL
  SELECT member_key, party_key, 'ASSERTED', doj, coalesce(doe, {DAY}), false FROM asr)
, axis AS (
  SELECT o.member_key, o.party_key,
         make_date(year(least(min(obs_date), coalesce(any_value(doj), min(obs_date)))), 1, 1)
           AS axis_start,
         make_date(year(greatest(max(obs_date), coalesce(any_value(doe), max(obs_date)))), 12, 31)
           AS axis_end
  FROM obs o LEFT JOIN asr USING (member_key, party_key) GROUP BY o.member_key, o.party_key)
SELECT * FROM segments JOIN axis USING (member_key, party_key)""")
def timeline_segments(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return envelopes.timeline_segments(days, asserted, AS_OF)


@query("reconstructed", with_ctes(RECON) + """
SELECT *, CASE WHEN verdict <> 'agrees' THEN CAST(last_day(last_seen) AS DATE) END AS exit_best
FROM recon""")
def reconstructed(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return envelopes.reconstruct(days, asserted, asserted)


@query("self_exit_window", with_ctes(RECON) + f"""
SELECT member_key, party_key, last_seen, CAST(last_day(last_seen) AS DATE) AS exit_best, confidence,
       {_ago('last_seen', DAY)} >= 2 AS ready,
       CASE WHEN {_ago('last_seen', DAY)} < 2
            THEN CAST(date_trunc('month', last_seen) + INTERVAL 2 MONTH AS DATE) END AS wait_until
FROM recon WHERE verdict = 'exit_missing'""")
def self_exit_window(spark, folder):
    return envelopes.self_exit_window(reconstructed(spark, folder), AS_OF)


@query("exit_facts", with_ctes(EXF) + "SELECT * FROM exf")
def exit_facts(spark, folder):
    observations, days, asserted = settled_inputs(spark, folder)
    return detectors.exit_facts(observations, days, asserted)


def _records(spark, folder):
    observations, days, asserted = settled_inputs(spark, folder)
    return detectors.record_findings(
        observations, days, envelopes.support_windows(days), asserted, AS_OF)


@query("missing_exits", with_ctes(REC) + f"""
SELECT {FINDING_LIST} FROM rec WHERE kind = 'MISSING_EXIT'""")
def missing_exits(spark, folder):
    return _records(spark, folder).filter(F.col("kind") == "MISSING_EXIT")


@query("early_exits", with_ctes(REC) + f"""
SELECT {FINDING_LIST} FROM rec WHERE kind IN ('EXIT_TOO_EARLY', 'TRAILING_PAYOUT')""")
def early_exits(spark, folder):
    return _records(spark, folder).filter(F.col("kind").isin("EXIT_TOO_EARLY", "TRAILING_PAYOUT"))


@query("suspect_joins", with_ctes(REC) + f"""
SELECT {FINDING_LIST} FROM rec WHERE kind = 'JOIN_SUSPECT'""")
def suspect_joins(spark, folder):
    return _records(spark, folder).filter(F.col("kind") == "JOIN_SUSPECT")


@query("corrected_timeline", with_ctes(TIMELINE) + """
SELECT member_key, party_key, ord, s AS start, e AS "end" FROM corrected""")
def corrected_timeline(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return detectors.corrected_timeline(asserted, envelopes.support_windows(days), AS_OF)


@query("service_overlaps", with_ctes(OVL) + "SELECT * FROM ovl")
def service_overlaps(spark, folder):
    asserted = adapters.asserted(spark, folder)
    return detectors.adjacent_overlaps(detectors.asserted_intervals(asserted, AS_OF))


@query("overlaps_all_pairs", with_ctes(OVL) + """
, pairs AS (
  SELECT a.member_key, a.ord, count(*) AS n,
         arg_max({'p': b.party_key, 'd': date_diff('day', a.s, least(a.e, b.e)) + 1},
                 {'e': b.e, 's': -date_diff('day', DATE '1970-01-01', b.s), 'o': -b.ord})
           FILTER ((b.s, b.ord) < (a.s, a.ord)) AS earlier
  FROM corrected a JOIN corrected b
  ON a.member_key = b.member_key AND a.ord <> b.ord AND b.s <= a.e AND b.e >= a.s GROUP BY 1, 2)
, follow AS (
  SELECT member_key, ord, lead(party_key) OVER w AS p, lead(s) OVER w AS b
  FROM corrected WINDOW w AS (PARTITION BY member_key ORDER BY s, ord))
SELECT c.member_key, c.party_key, c.ord, c.s AS "start", c.e AS "end", coalesce(n, 0) AS n_overlaps,
       earlier.p AS earlier_party, earlier.d AS earlier_days, CASE WHEN b <= c.e THEN p END AS next_party
FROM corrected c LEFT JOIN pairs USING (member_key, ord) JOIN follow USING (member_key, ord)""")
def overlaps_all_pairs(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return detectors.overlaps_all_pairs(
        cut_lineage(detectors.corrected_timeline(asserted, envelopes.support_windows(days), AS_OF)))


@query("correction_conflicts", with_ctes(FND) + f"""
SELECT {FINDING_LIST} FROM fnd WHERE kind = 'CORRECTION_CONFLICT'""")
def correction_conflicts(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return detectors.overlap_findings(
        asserted, envelopes.support_windows(days), AS_OF
    ).filter(F.col("kind") == "CORRECTION_CONFLICT")


@query("find_orphans", with_ctes(WIN, ASR) + f"""
SELECT member_key, party_key, earliest, latest, {_ago('earliest', 'latest')} + 1 AS span_months
FROM win ANTI JOIN asr USING (member_key, party_key)""")
def find_orphans(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return detectors.orphans(envelopes.support_windows(days), asserted).select(
        *envelopes.PARTY, "earliest", "latest",
        (detectors.months_apart("earliest", "latest") + 1).alias("span_months"))


@query("contribution_gaps", with_ctes(GAP) + "SELECT * FROM gap")
def contribution_gaps(spark, folder):
    return detectors.contribution_gaps(inputs(spark, folder)[1])


@query("findings", with_ctes(FND) + f"SELECT {FINDING_LIST} FROM fnd")
def findings(spark, folder):
    return findings_of(spark, folder)


@query("ordered_findings", with_ctes(ORDERED) + f"""
SELECT {FINDING_LIST}, severity_rank, finding_no FROM ordered""")
def ordered_findings(spark, folder):
    return verdicts.order_findings(cut_lineage(findings_of(spark, folder)))


@query("claim_status", with_ctes(STATUS) + "SELECT * FROM status")
def claim_status(spark, folder):
    tables = settled_tables(spark, folder)
    return verdicts.claim_status(
        findings_of(spark, folder, tables), adapters.members(spark, folder), tables[1])


@query("suppress_without_history", with_ctes(FND) + f"""
SELECT {FINDING_LIST} FROM fnd
WHERE kind <> 'ORPHAN_ACCOUNT' OR member_key IN (SELECT member_key FROM asr)""")
def suppress_without_history(spark, folder):
    tables = settled_tables(spark, folder)
    return verdicts.suppress_without_history(cut_lineage(findings_of(spark, folder, tables)), tables[1])


@query("no_denial_audit", with_ctes(STATUS) + """
SELECT member_key, kind, 'no fix' AS broken FROM fnd WHERE coalesce(fix, '') = ''
UNION ALL SELECT member_key, kind, 'no route' FROM fnd WHERE coalesce(route, '') = ''
UNION ALL SELECT member_key, kind, 'unknown severity' FROM fnd
  WHERE severity NOT IN ('BLOCKING', 'DEGRADED', 'OPPORTUNITY')
UNION ALL SELECT member_key, NULL, 'unknown status' FROM status
  WHERE claim_status NOT IN ('WILL_BE_REJECTED', 'LIKELY_TO_SETTLE', 'NOT_CHECKED')""")
def no_denial_audit(spark, folder):
    tables = settled_tables(spark, folder)
    found = cut_lineage(findings_of(spark, folder, tables))
    return verdicts.audit(
        found, verdicts.claim_status(found, adapters.members(spark, folder), tables[1]))


@query("blocking_per_party", with_ctes(FND) + """
SELECT a.member_key, a.party_key, count(c.party_key) AS blocking
FROM (SELECT DISTINCT member_key, party_key FROM asr) a
LEFT JOIN (SELECT member_key, party_key FROM fnd WHERE severity = 'BLOCKING'
           UNION ALL SELECT member_key, party_key_2 FROM fnd
           WHERE severity = 'BLOCKING' AND party_key_2 IS NOT NULL) c USING (member_key, party_key)
GROUP BY a.member_key, a.party_key""")
def blocking_per_party(spark, folder):
    tables = settled_tables(spark, folder)
    parties = tables[1].select(*envelopes.PARTY).distinct()
    return verdicts.blocking_per_party(findings_of(spark, folder, tables), parties)


FLAGS = OBS + ASR + MEM + [("flags", """
  SELECT member_key, member_key IN (SELECT member_key FROM asr) AS dates_checked,
         member_key IN (SELECT a.member_key FROM obs a JOIN obs b USING (member_key, party_key)
                        WHERE a.source = 'EPF_CONTRIB' AND b.source = 'TDS_26AS')
           AS contributions_checked
  FROM mem""")]


@query("checked_flags", with_ctes(FLAGS) + "SELECT * FROM flags")
def checked_flags(spark, folder):
    _, days, asserted = inputs(spark, folder)
    return verdicts.checked_flags(days, asserted, adapters.members(spark, folder))


@query("finding_evidence", with_ctes(FND) + f"""
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY member_key, party_key ORDER BY obs_date, ord, source) AS rn,
         row_number() OVER (PARTITION BY member_key, party_key
                            ORDER BY obs_date DESC, ord DESC, source DESC) AS back,
         source || '@' || left(CAST(obs_date AS VARCHAR), CASE WHEN source = 'EPF_CONTRIB' THEN 7 ELSE 10 END) AS citation
  FROM obs)
, gap_cited AS (
  SELECT *, row_number() OVER (PARTITION BY member_key, party_key ORDER BY month_no) AS rn FROM gm)
SELECT n.member_key, n.party_key, kind, -back AS cite_no, citation
FROM numbered n JOIN fnd f USING (member_key, party_key)
WHERE kind = 'MISSING_EXIT' AND back <= 3
UNION ALL
SELECT n.member_key, n.party_key, kind, rn, citation
FROM numbered n JOIN fnd f USING (member_key, party_key)
WHERE kind IN ('JOIN_SUSPECT', 'ORPHAN_ACCOUNT') AND rn <= 3
UNION ALL
SELECT n.member_key, n.party_key, kind, 0, citation
FROM numbered n JOIN fnd f USING (member_key, party_key) JOIN asr a USING (member_key, party_key)
WHERE kind IN ('EXIT_TOO_EARLY', 'TRAILING_PAYOUT') AND obs_date > doe
UNION ALL
SELECT member_key, party_key, 'CONTRIBUTION_GAP', rn,
       'TDS_26AS@' || strftime(make_date(month_no // 12, month_no % 12 + 1, 1), '%Y-%m')
FROM gap_cited WHERE rn <= 6
UNION ALL
SELECT member_key, party_key, 'CONTRIBUTION_GAP', 7,
       'EPF_CONTRIB@' || strftime(make_date(fund_first // 12, fund_first % 12 + 1, 1), '%Y-%m')
       || ' (first)' FROM gap
UNION ALL
SELECT member_key, party_key, 'CONTRIBUTION_GAP', 8,
       'EPF_CONTRIB@' || strftime(make_date(fund_last // 12, fund_last % 12 + 1, 1), '%Y-%m')
       || ' (last)' FROM gap
UNION ALL
SELECT member_key, party_key, 'SERVICE_OVERLAP', 1, 'asserted:' || party_key || '[..' || a_end || ']'
FROM ovl
UNION ALL
SELECT member_key, party_key, 'SERVICE_OVERLAP', 2,
       'asserted:' || party_key_2 || '[' || b_start || '..]' FROM ovl
UNION ALL
SELECT member_key, party_key, 'CORRECTION_CONFLICT', 1,
       'corrected:' || party_key || '[..' || a_end || ']' FROM ovc
UNION ALL
SELECT member_key, party_key, 'CORRECTION_CONFLICT', 2,
       'asserted:' || party_key_2 || '[' || b_start || '..]' FROM ovc""")
def finding_evidence(spark, folder):
    lines = settled_lines(spark, folder)
    asserted = cut_lineage(adapters.asserted(spark, folder, lines))
    return detectors.evidence_of_all(adapters.observations(spark, folder, lines), asserted, AS_OF)
