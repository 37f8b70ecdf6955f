"""Registered queries against their SQL on the smallest scale factor, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from corrobora.plans.catalogue import ORACLES, QUERIES
from tests.oracle_check import compare, database

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["findings", "gate_summary", "plan_summary", "rejection_diagnoses", "proposal_checks", "merge_passbooks",
          "statement_deductors", "passbook_heads", "employer_pairs", "first_word_scores", "first_word_links", "weakest_pair",
          "lint_letters"]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    same, message = compare(spark, database(FOLDER), FOLDER, name)
    assert same, message


@needs_data
def test_entry(spark):
    assert contract.entry(spark).columns == ["member_key", "blocking_count", "finding_count", "claim_status"]


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
