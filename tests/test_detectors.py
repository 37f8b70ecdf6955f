"""Small scenarios with known findings, and rules that must stay silent."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corrobora.contracts import CONTRACTS
from corrobora.operators import detectors, envelopes, verdicts


def monthly(member, party, source, first, n, amount=None, start=0):
    out, y, m = [], first.year, first.month
    for i in range(n):
        out.append((member, party, date(y, m, 1), source, amount, "", start + i))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def months(member, party, source, numbers):
    return [(member, party, date(2020, n, 5), source, None, "", n) for n in numbers]


SCENARIOS = (
    # exit recorded early, so service overlaps
    monthly("overlap", "ACME", "EPF_CONTRIB", date(2017, 6, 1), 34)
    + monthly("overlap", "ACME", "TDS_26AS", date(2017, 6, 1), 34, start=100)
    + [("overlap", "ACME", date(2020, 3, 28), "BANK_SALARY", None, "", 200)]
    + monthly("overlap", "BOREAL", "EPF_CONTRIB", date(2020, 4, 1), 60, start=300)
    + monthly("overlap", "BOREAL", "TDS_26AS", date(2020, 4, 1), 60, start=400)
    # an account nobody linked
    + monthly("orphan", "STARLIT", "TDS_26AS", date(2012, 8, 1), 11)
    + monthly("orphan", "STARLIT", "BANK_SALARY", date(2012, 8, 1), 11, start=100)
    + monthly("orphan", "BOREAL", "EPF_CONTRIB", date(2020, 4, 1), 60, start=200)
    + monthly("orphan", "BOREAL", "TDS_26AS", date(2020, 4, 1), 60, start=300)
    # one source only
    + monthly("single", "GRAMEEN", "EPF_CONTRIB", date(2021, 7, 1), 29)
    # gaps
    + months("gap", "A", "TDS_26AS", [4, 5, 6, 7, 8, 9]) + months("gap", "A", "EPF_CONTRIB", [4, 5, 8, 9])
    + months("gap", "B", "TDS_26AS", [4, 5, 6, 7, 8, 9]) + months("gap", "B", "EPF_CONTRIB", [4, 6, 8, 9])
    + months("gap", "C", "TDS_26AS", [4, 5, 6, 7]) + months("gap", "C", "EPF_CONTRIB", [4, 5])
    + months("gap", "D", "TDS_26AS", [4, 5, 6, 7]) + months("gap", "D", "EPF_CONTRIB", [6, 7])
    + months("gap", "E", "TDS_26AS", [4, 5, 6]) + months("gap", "F", "EPF_CONTRIB", [4, 6])
    + months("gap", "G", "BANK_SALARY", [4, 5, 6])
    + months("gap", "H", "TDS_26AS", [5]) + months("gap", "H", "EPF_CONTRIB", [4, 5, 6])
    # a settlement after a right exit
    + monthly("settled", "ACME", "TDS_26AS", date(2020, 4, 1), 8, 65000)
    + monthly("settled", "ACME", "EPF_CONTRIB", date(2020, 4, 1), 8, start=50)
    + [("settled", "ACME", date(2021, 1, 31), "TDS_26AS", 195000, "", 99)]
    # the same tail at the usual amount is no settlement
    + monthly("worked", "ACME", "TDS_26AS", date(2020, 4, 1), 8, 65000)
    + [("worked", "ACME", date(2021, 1, 31), "TDS_26AS", 66000, "", 99)]
)
ASSERTED = [
    ("overlap", "ACME", "m1", date(2017, 6, 12), date(2020, 1, 31), 0),
    ("overlap", "BOREAL", "m2", date(2020, 1, 20), None, 1),
    ("orphan", "BOREAL", "m3", date(2020, 4, 1), None, 0),
    ("single", "GRAMEEN", "m4", date(2021, 7, 5), None, 0),
    ("settled", "ACME", "m5", date(2020, 4, 1), date(2020, 11, 30), 0),
    ("worked", "ACME", "m6", date(2020, 4, 1), date(2020, 11, 30), 0),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(*r[:4], None if r[4] is None else Decimal(r[4]), *r[5:]) for r in SCENARIOS]
    return (spark.createDataFrame(rows, CONTRACTS["observations"]),
            spark.createDataFrame(ASSERTED, CONTRACTS["asserted"]))


@pytest.fixture(scope="module")
def found(tables):
    rows = detectors.all_findings(*tables, date(2025, 4, 1)).collect()
    by_member = {}
    for r in rows:
        by_member.setdefault(r.member_key, []).append(r)
    return by_member


def kinds(rows):
    return sorted((r.kind, r.severity, r.measure) for r in rows)


def test_overlap(found):
    got = kinds(found["overlap"])
    assert ("SERVICE_OVERLAP", "BLOCKING", 12) in got
    assert ("JOIN_SUSPECT", "DEGRADED", 3) in got
    assert any(k == "EXIT_TOO_EARLY" and s == "BLOCKING" for k, s, _ in got)
    assert not any(k == "CORRECTION_CONFLICT" for k, _, _ in got)


def test_orphan(found):
    assert kinds(found["orphan"]) == [("ORPHAN_ACCOUNT", "OPPORTUNITY", 11)]


def test_single_source(found):
    assert kinds(found["single"]) == [("MISSING_EXIT", "BLOCKING", 17)]


def test_settlement_is_told_from_employment(found):
    assert kinds(found["settled"]) == [("TRAILING_PAYOUT", "DEGRADED", 1)]
    assert kinds(found["worked"]) == [("EXIT_TOO_EARLY", "DEGRADED", 1)]


def test_gaps_and_silence(tables, found):
    gaps = {r.party_key: r.measure for r in found["gap"] if r.kind == "CONTRIBUTION_GAP"}
    assert gaps == {"A": 2, "B": 2}
    spans = {r.party_key: r.spans for r in detectors.contribution_gaps(
        envelopes.evidence_days(tables[0]).filter("member_key = 'gap'")).collect()}
    assert spans == {"A": "2020-06 to 2020-07", "B": "2020-05, 2020-07"}


def test_clean_record(spark):
    rows = monthly("m", "B", "EPF_CONTRIB", date(2020, 4, 1), 48) + monthly(
        "m", "B", "TDS_26AS", date(2020, 4, 1), 48, start=50)
    found = detectors.all_findings(
        spark.createDataFrame(rows, CONTRACTS["observations"]),
        spark.createDataFrame([("m", "B", "x", date(2020, 4, 1), None, 0)], CONTRACTS["asserted"]),
        date(2024, 4, 1))
    assert found.count() == 0


def test_row_order_and_partitioning_do_not_matter(tables, found):
    shuffled = tables[0].repartition(7, "ord").orderBy(F.desc("ord"))
    again = detectors.all_findings(shuffled, tables[1].repartition(3), date(2025, 4, 1)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for rows in found.values() for r in rows)


def test_a_hot_party_is_reduced_before_it_is_grouped(spark):
    """A third of a million copies of one row are one evidence day."""
    rows = spark.range(300000).select(
        F.lit("m").alias("member_key"), F.lit("p").alias("party_key"),
        F.lit(date(2020, 1, 1)).alias("obs_date"), F.lit("TDS_26AS").alias("source"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit("").alias("note"), F.col("id").alias("ord"))
    days = envelopes.evidence_days(rows).collect()
    assert [(r.n_obs, r.first_ord) for r in days] == [(300000, 0)]
    assert envelopes.cite_last(rows).count() == 3


def test_duplicate_records_keep_last_dates_at_first_position(spark):
    asserted = spark.createDataFrame(
        [("m", "A", "1", date(2020, 1, 1), date(2020, 6, 30), 0),
         ("m", "B", "2", date(2020, 5, 1), date(2020, 9, 30), 1),
         ("m", "A", "3", date(2021, 1, 1), date(2021, 6, 30), 2)], CONTRACTS["asserted"])
    kept = {r.party_key: (r.account_id, r.doj, r.ord) for r in envelopes.latest_record(asserted).collect()}
    assert kept["A"] == ("3", date(2021, 1, 1), 0)
    overlaps = detectors.adjacent_overlaps(detectors.asserted_intervals(asserted, date(2022, 1, 1)))
    assert overlaps.count() == 0


def test_touching_days_overlap_and_only_neighbours_count(spark):
    asserted = spark.createDataFrame(
        [("m", "A", "1", date(2020, 1, 1), date(2020, 12, 31), 0),
         ("m", "B", "2", date(2020, 3, 1), date(2020, 3, 31), 1),
         ("m", "C", "3", date(2020, 12, 31), None, 2)], CONTRACTS["asserted"])
    got = detectors.adjacent_overlaps(detectors.asserted_intervals(asserted, date(2022, 1, 1))).collect()
    assert [(r.party_key, r.party_key_2, r.overlap_days) for r in got] == [("A", "B", 306)]


def test_status_without_history(spark, tables):
    found = spark.createDataFrame([], ", ".join(
        ["member_key string", "kind string", "severity string", "fix string", "route string"]))
    members = spark.createDataFrame([("a",), ("b",)], "member_key string")
    history = spark.createDataFrame([("a",)], "member_key string")
    status = {r.member_key: r.claim_status for r in verdicts.claim_status(found, members, history).collect()}
    assert status == {"a": "LIKELY_TO_SETTLE", "b": "NOT_CHECKED"}


def test_self_exit_opens_on_the_first_of_the_second_month(spark):
    seen = spark.createDataFrame(
        [("m", "p", date(2020, 11, 30), date(2020, 11, 30), "Low", "exit_missing")],
        "member_key string, party_key string, last_seen date, exit_best date, confidence string, verdict string")
    waiting = envelopes.self_exit_window(seen, date(2020, 12, 31)).first()
    assert (waiting.ready, waiting.wait_until) == (False, date(2021, 1, 1))
    open_now = envelopes.self_exit_window(seen, date(2020, 12, 31) + timedelta(days=1)).first()
    assert (open_now.ready, open_now.wait_until) == (True, None)


@pytest.mark.parametrize("name", ["windows", "gaps", "orphans", "overlaps"])
def test_no_plan_pairs_everything_or_calls_python(tables, name):
    observations, asserted = tables
    days = envelopes.evidence_days(observations)
    windows = envelopes.support_windows(days)
    plan = {
        "windows": windows, "gaps": detectors.contribution_gaps(days),
        "orphans": detectors.orphans(windows, asserted),
        "overlaps": detectors.overlap_findings(asserted, windows, date(2025, 4, 1)),
    }[name]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_overlaps_of_all_pairs(spark):
    import random
    from datetime import timedelta
    rng, rows = random.Random(4), []
    for member in "abc":
        for ord_ in range(60):
            start = date(2015, 1, 1) + timedelta(days=rng.randint(0, 900))
            rows.append((member, f"p{ord_}", ord_, start, start + timedelta(days=rng.choice([0, 3, 40, 400]))))
    rows.append(("lone", "p", 1, date(2020, 1, 1), date(2020, 1, 1)))
    told = {(r.member_key, r.ord): r for r in detectors.overlaps_all_pairs(spark.createDataFrame(
        rows, "member_key string, party_key string, ord bigint, start date, end date")).collect()}
    assert len(told) == len(rows)
    for m, p, o, s, e in rows:
        others = [x for x in rows if x[0] == m and x[2] != o]
        shared = [x for x in others if x[3] <= e and x[4] >= s]
        before = max((x for x in shared if (x[3], x[2]) < (s, o)), key=lambda x: (x[4], -x[3].toordinal(), -x[2]), default=None)
        after = min((x for x in others if (x[3], x[2]) > (s, o)), key=lambda x: (x[3], x[2]), default=None)
        r = told[m, o]
        assert r.n_overlaps == len(shared)
        assert (r.earlier_party, r.earlier_days) == ((before[1], (min(e, before[4]) - s).days + 1) if before else (None, None))
        assert r.next_party == (after[1] if after and after[3] <= e else None)
