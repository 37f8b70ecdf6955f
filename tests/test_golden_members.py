"""Documents in, decisions out, for two members with known outcomes and for copies of one."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from corrobora.contracts import CONTRACTS
from corrobora.operators import corrections
from corrobora.plans.analysis import analyse, what_if
from tests import golden

MER, QUI = golden.MERIDIAN[:15], golden.QUILLHAVEN[:15]


def rows(df, member, *columns):
    return [tuple(r) for r in df.filter(F.col("member_key") == member).select(*columns).collect()]


@pytest.fixture(scope="module")
def register(spark):
    return spark.createDataFrame(golden.REGISTER, CONTRACTS["establishments"])


@pytest.fixture(scope="module")
def result(spark, register):
    documents = spark.createDataFrame(
        golden.defective() + golden.clean() + golden.defective("GM1-copy"), CONTRACTS["documents"])
    return analyse(documents, golden.AS_OF, register)


def test_statement_blocks(result):
    assert len(rows(result["deductors"], "GM1", "tan")) == 3
    per_block = result["transactions"].filter("member_key = 'GM1'").groupBy("block_no").count()
    assert sorted(tuple(r) for r in per_block.collect()) == [(1, 7), (2, 8), (3, 5)]
    assert result["problems"].count() == 0


def test_bank_rows_and_attribution(result):
    assert len(rows(result["bank_rows"], "GM1", "line_no")) == 7
    assert len(rows(result["credits"].filter("is_salary"), "GM1", "hint")) == 5
    assert len(rows(result["observations"].filter("source = 'BANK_SALARY'"), "GM1", "party_key")) == 5
    assert rows(result["bank_rows"], "GM2", "line_no") == []


def test_findings_and_status(result):
    found = sorted(rows(result["findings"], "GM1", "kind", "party_key", "severity", "measure", "n_sources"))
    assert found == [
        ("EXIT_TOO_EARLY", MER, "BLOCKING", 9, 3),
        ("MISSING_EXIT", QUI, "BLOCKING", 62, 0),
        ("ORPHAN_ACCOUNT", "VPNT22417F", "OPPORTUNITY", 7, 0),
    ]
    assert rows(result["status"], "GM1", "claim_status", "blocking_count") == [("WILL_BE_REJECTED", 2)]
    assert rows(result["findings"], "GM2", "kind") == []
    assert rows(result["status"], "GM2", "claim_status") == [("LIKELY_TO_SETTLE",)]


def test_corrected_end_confidence_and_verdict(result):
    ends = dict(rows(result["corrected"], "GM1", "party_key", "end"))
    assert ends == {MER: date(2018, 9, 30), QUI: golden.AS_OF}
    sure = dict(rows(result["confidence"], "GM1", "party_key", "confidence"))
    assert sure[MER] == pytest.approx(0.9982, abs=1e-4)
    assert sure[QUI] == pytest.approx(0.995, abs=1e-4)
    assert rows(result["reconstructed"], "GM2", "verdict") == [("agrees",)]
    assert dict(rows(result["reconstructed"], "GM1", "party_key", "verdict")) == {
        MER: "exit_wrong", QUI: "exit_missing", "VPNT22417F": "unlinked"}


def test_totals_and_withdrawal(result):
    assert [(float(b), float(p), m) for b, p, m in rows(
        result["totals"], "GM1", "balance", "pension", "service_months")] == [(112750.0, 15690.0, 13)]
    assert [(float(b), float(p)) for b, p in rows(
        result["totals"], "GM2", "balance", "pension")] == [(105300.0, 11250.0)]
    assert [(r, float(t), float(n), m) for r, t, n, m in rows(
        result["withdrawals"], "GM1", "rule", "tax", "net", "months_to_free")] == [
        ("taxed", 11275.0, 101475.0, 47)]


def test_gates_plan_and_next_step(result):
    assert rows(result["gate_summary"], "GM1", "passed", "failed", "unknown", "blocking_gates") == [
        (8, 3, 3, 2)]
    failed = sorted(rows(result["gates"].filter("status = 'fail'"), "GM1", "gate"))
    assert failed == [("G08",), ("G09",), ("G11",)]
    assert rows(result["plan_summary"], "GM1", "steps", "serial_days", "critical_days", "wasted_days") == [
        (3, 41, 40, 20)]
    assert sorted(rows(result["plan_steps"], "GM1", "step_no", "kind", "days", "wave")) == [
        (1, "EXIT_TOO_EARLY", 20, 1), (2, "MISSING_EXIT", 1, 1), (3, "ORPHAN_ACCOUNT", 20, 2)]
    assert rows(result["next_step"], "GM1", "action") == [("MISSING_EXIT",)]
    assert rows(result["plan_summary"], "GM2", "steps", "serial_days") == [(0, 0)]


def test_unlinked_account(result):
    assert rows(result["orphans"], "GM1", "verdict", "low", "high", "principal_low", "principal_high",
                "years", "months", "est_code") == [
        ("LIKELY", 29900, 38000, 13600, 17300, 10.0, 7, "APVSP0071188000")]
    assert [r[0] for r in sorted(rows(result["recovery"], "GM1", "step_no"))] == [1, 2, 3, 4]


def test_names_and_identity(result):
    assert rows(result["name_check"], "GM1", "canonical", "same_person") == [("ISHAAN DEV TALWAR", True)]
    assert rows(result["identity"], "GM1", "pan", "uan", "dob") == [
        ("KLMPT4821Q", "100482615937", date(1987, 7, 9))]


def test_rejected_claims_are_explained(spark, result):
    claims = spark.createDataFrame([
        ("GM1", "1", "Form-19", date(2019, 6, 12), "Claim Rejected"),
        ("GM1", "2", "Form-10C", date(2019, 6, 13), "Claim Rejected"),
        ("GM1", "3", "Form-19", date(2016, 1, 1), "claim REJECTED"),
        ("GM1", "4", "Form-19", date(2020, 1, 1), "Settled")], CONTRACTS["claims"])
    diagnosed = corrections.diagnose_rejections(claims, result["findings"])
    assert sorted(rows(diagnosed, "GM1", "tracking_id", "causes", "confident")) == [
        ("1", ["MISSING_EXIT", "EXIT_TOO_EARLY"], True),
        ("2", ["MISSING_EXIT", "EXIT_TOO_EARLY"], True),
        ("3", [], False)]


def test_corrections_clear_the_record(spark, result, register):
    proposals = spark.createDataFrame(
        [("GM1", 1, golden.MERIDIAN, date(2018, 9, 30), "Appointment letter", golden.AS_OF),
         ("GM1", 2, golden.QUILLHAVEN, date(2019, 3, 31), "Appointment letter", golden.AS_OF)],
        "member_key string, proposal_id bigint, account_id string, proposed date, evidence string, "
        "started date")
    after = what_if(result, proposals, golden.AS_OF, register)
    assert sorted(rows(after["state"], "GM1", "proposal_id", "state", "due")) == [
        (1, "ready", date(2024, 6, 3)), (2, "ready", date(2024, 6, 3))]
    assert rows(after["findings"], "GM1", "kind") == [("ORPHAN_ACCOUNT",)]
    assert sorted(rows(after["cleared"], "GM1", "gate")) == [("G08",), ("G09",)]


def test_copies_of_a_member_give_copies_of_the_findings(result):
    columns = ["kind", "party_key", "severity", "measure", "first_evidence"]
    assert sorted(rows(result["findings"], "GM1", *columns), key=str) == sorted(
        rows(result["findings"], "GM1-copy", *columns), key=str)


def test_supporting_facts(result):
    facts = sorted(rows(result["supporting_facts"], "GM1", "kind", "value"))
    assert facts == [
        ("DATE", "30-06-2018"), ("DATE", "30-09-2018"), ("DATE", "30-09-2018"), ("DATE", "31-07-2018"),
        ("DATE", "31-08-2018"), ("MEMBER_ID", golden.MERIDIAN), ("UAN", "100482615937")]


def test_what_is_shown_beside_the_decisions(result):
    assert result["audit"].count() == 0
    assert sorted(rows(result["blocking_per_party"], "GM1", "party_key", "blocking")) == [
        (MER, 1), ("VPNT22417F", 0), (QUI, 1)]
    assert len(rows(result["ordered_findings"], "GM1", "kind")) == 3
    assert rows(result["ingest_summary"], "GM1", "history_rows", "bank_rows", "salary_credits") == [(2, 7, 5)]
    assert {r[0] for r in rows(result["finding_evidence"], "GM1", "kind")} == {
        "EXIT_TOO_EARLY", "MISSING_EXIT", "ORPHAN_ACCOUNT"}
    assert [r[0] for r in rows(result["notifications"], "GM1", "event")].count("Action needed") == 1
    assert len(rows(result["last_contributions"], "GM1", "month")) == 5
    assert {r[0] for r in rows(result["passbook_flags"], "GM1", "flag")} <= {
        "contributions after exit", "no exit recorded", None}
    assert result["withdrawal_portfolio"].count() >= 1 and result["rejections"].count() == 0
    assert len(rows(result["corpus_profile"], "GM1", "doc_id")) == len(rows(result["documents"], "GM1", "doc_id"))
