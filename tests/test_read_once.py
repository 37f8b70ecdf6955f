"""Text and rows are read once, however many results need them."""

import random
import re
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Window, functions as F

from corrobora import rules
from corrobora.functions.text import holds, strip
from corrobora.operators import detectors, envelopes, people, spread
from corrobora.plans import adapters, derived_corpus, evidence_queries
from corrobora.sources import corpus, passbooks, records
from corrobora.streaming import refresh

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark):
    return spark.createDataFrame([
        ("m", "a", "EPF Member Passbook\nMember ID   MHBAN00123450000000001\nMember Name   ASHA RAO\nUAN   100200300400"),
        ("m", "b", ""), ("m", "c", None), ("n", "d", "Form 26AS\nABCDE1234F")], "member_key string, doc_id string, text string")


def test_names_are_numbered_without_reading_the_text_again(spark):
    names = records.extract_names(corpus.classify_documents(documents(spark)))
    assert "regexp_extract" not in plan(names)
    assert [(r.member_key, r.label, r.name) for r in names.collect()] == [("m", "EPFO passbook", "ASHA RAO")]


def test_mixed_documents_are_rendered_for_their_orders_only(spark):
    assert "LeftSemi" not in plan(derived_corpus.mixed(spark, SMALL))


def test_passbook_heads_come_from_the_lines_alone(spark):
    heads, contributions = passbooks.passbook_tables(documents(spark))
    assert "Join" not in plan(heads)
    rows = {r.doc_id: (r.account_id, r.name, r.uan, r.other_ids) for r in heads.collect()}
    assert rows == {"a": ("MHBAN00123450000000001", "ASHA RAO", "100200300400", []),
                    "b": (None, None, None, []), "c": (None, None, None, []), "d": (None, None, None, [])}
    assert contributions.count() == 0


def test_identity_reads_kinds_and_numbers_from_one_written_table(spark):
    read = records.read_for_identity(corpus.classify_documents(documents(spark)))
    heads, _ = passbooks.passbook_tables(read.filter("kind = 'passbook'").drop("kind", "pan"))
    found = records.extract_identity(read, heads)
    assert "regexp_extract" not in plan(found)
    assert sorted((r.member_key, r.pan, r.uan) for r in found.collect()) == [
        ("m", None, "100200300400"), ("n", "ABCDE1234F", None)]


def test_positions_move_the_rows_once(spark):
    rows = spark.range(4000).selectExpr("id % 3 key", "1000 - id % 1000 place", "id", "repeat('x', 50) load")
    placed = spread.position_in_order(rows, ["key"], ["place", "id"], "n", rows_per_bucket=64)
    written = placed._jdf.queryExecution().executedPlan().toString()
    assert written.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in written
    expected = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("place", "id")))
    assert sorted(placed.select("key", "id", "n").collect()) == sorted(expected.select("key", "id", "n").collect())


def test_order_lines_are_joined_once_for_evidence_and_record(spark):
    observations, _, _ = evidence_queries.settled_inputs(spark, SMALL)
    assert "Join" not in plan(observations)


def test_lines_are_cut_as_by_the_pattern_of_all_breaks(spark):
    texts = ["", "a", "a\n", "\n", "\n\n", "a\r\nb\r\n", "a\r\r\nb", "a\x0bb\x0c", "\x1c\x1d\x1e", "a\x85b\u2028c\u2029", "\u2029",
             "a\tb\x1fc\n\nd", "a\n\r", "\x0e\nb", "\u0939\n\u0930"]
    docs = spark.createDataFrame([("m", str(i), t) for i, t in enumerate(texts)] + [("m", "x", None)],
                                 "member_key string, doc_id string, text string")
    lines = corpus.explode_lines(docs)
    assert "regexp_replace" not in plan(lines)  # one kind of break needs no pattern
    told = {(r.doc_id, r.line_no): r.line for r in lines.collect()}
    expected = {}
    for i, t in enumerate(texts):
        pieces = re.split(rules.LINE_BREAK, t)
        for k, line in enumerate(pieces[:-1] if pieces[-1] == "" else pieces):
            expected[str(i), k] = line
    assert told == expected
    marked = corpus.lines_and_markers(docs).collect()
    assert {(r.doc_id, r.line_no): r.line for r in marked if r.line_no >= 0} == expected
    assert sorted(r.doc_id for r in marked if r.line_no < 0) == sorted([*map(str, range(len(texts))), "x"])


def test_words_are_looked_for_before_patterns(spark):
    patterns = [*rules.STATEMENT_ANCHORS.values(), *rules.PASSBOOK_ANCHORS.values(), rules.STATEMENT_WORDS, rules.HISTORY_WORDS,
                rules.PASSBOOK_WORDS, rules.BANK_WORDS, rules.PROBE_PASSBOOK_WORDS, rules.PROBE_AIS_WORDS]
    texts = ["", "form26as", "form \t26as", "form x 26as", "annual tax statement", "part -a", "part ab", "titan tan.", "titan",
             "tan of deductor", "name\nof deductor", "1192", "192", "section", "transaction date", "date of payment", "date of",
             "amount  credited", "tds deposited", "member id", "member passbook", "members", "epf passbook", "establishment code",
             "establishment", "doj", "doe", "date of exit", "date of joining", "month / year", "month-year", "month x year", "wage month",
             "employee share", "ee share", "er share", "eps contribution", "pension", "ais", "rais", "annual information statement",
             "service history", "narration", "closing balance", "closing"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[
        F.struct(holds(F.col("t"), p).alias("a"), F.col("t").rlike(p).alias("b")).alias(str(i)) for i, p in enumerate(patterns)])
    assert all(r[str(i)].a == r[str(i)].b for r in found.collect() for i in range(len(patterns)))
    assert all(any(r[str(i)].a for r in found.collect()) for i in range(len(patterns)))


def test_white_space_of_any_kind_is_stripped(spark):
    row = spark.createDataFrame([(" \t\n\x0b\f\ra b\r\n \t",)], "t string").select(strip(F.col("t")).alias("s"), F.expr("1")).first()
    assert row.s == "a b" and "regexp_replace" not in str(strip(F.col("t")))


def test_names_are_not_multiplied_where_they_are_read(spark):
    names = spark.createDataFrame([("a", "RAVI SINGH"), ("a", "RAVEE SINGH"), ("b", "RAVI SINGH"), ("b", "RAVI SINGH"), ("c", None),
                                   ("c", "ASHA RAO")], "member_key string, name string")
    classes = people.name_classes(names)
    assert "Expand" not in plan(classes)
    assert sum(r.n_members for r in classes.collect() if "RAVI" in r.representative or "RAVEE" in r.representative) >= 2
    assert {r.representative: (r.n_members, r.n_spellings) for r in classes.collect()}["ASHA RAO"] == (1, 1)


def test_copies_of_evidence_are_counted_after_one_shuffle(spark):
    rows = [("f1", 1, "p", "s", "m", 5)] * 3 + [("f2", 1, "p", "s", "m", 5)] * 2 + [("f2", 1, "q", "s", "m", 5)]
    counted = refresh.row_copies(spark.createDataFrame(
        rows, "file string, bucket int, party_key string, source string, member_key string, ord long"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.party_key, r.copies) for r in counted.collect()) == [("p", 3), ("q", 1)]


def test_evidence_by_party_rows_equals_evidence_of_all_findings(spark):
    """Plain parties, and parties with notes, crowded days, unknown places and dates, several records or unknown accounts."""
    rng, as_of, sources = random.Random(3), date(2001, 12, 1), ["EPF_CONTRIB", "TDS_26AS", "BANK_SALARY", rules.ASSERTED_SOURCE]
    seen, records = [], []
    for i in range(320):
        who, kind, n = (f"m{i // 4}", f"p{i % 4}"), i % 16, rng.choice([0, 1, 2, 5, 12, 30])
        start, last_fund = date(1995, 1, 1) + timedelta(rng.randrange(900)), rng.randrange(n + 1)
        days = sorted(rng.randrange(60 + 40 * n) for _ in range(n))
        for k, d in enumerate(days):
            source = rng.choice(sources if k <= last_fund else sources[1:])
            amount = None if source == "EPF_CONTRIB" or rng.random() < 0.1 else Decimal(rng.choice([100, 101, 102, 900]))
            for _ in range(rng.choice([1, 1, 1, 1, 2, 5 if kind == 1 else 1])):
                seen.append((*who, None if kind == 2 and k == 3 else start + timedelta(d), source, amount,
                             "late" if kind == 3 and k % 3 == 0 else "", None if kind == 4 and k == 1 else rng.randrange(10 ** 6)))
        for r in range([1, 0, 1, 1][i % 4] + (kind in (5, 6))):
            end = days[-1 - min(n - 1, rng.choice([0, 1, 2, 3, n // 2]))] if n and rng.random() < 0.8 else None
            records.append((*who, None if kind == 7 else f"a{i}-{r if kind == 5 else 0}", start + timedelta(rng.choice([-9, 0, 80])),
                            None if end is None else start + timedelta(end), r * 10 + i % 4))
    observations = spark.createDataFrame(
        seen, "member_key string, party_key string, obs_date date, source string, amount decimal(18,2), note string, ord long").cache()
    asserted = spark.createDataFrame(
        records, "member_key string, party_key string, account_id string, doj date, doe date, ord long").cache()
    days = envelopes.evidence_days(observations).cache()
    expected = Counter(detectors.finding_evidence(
        detectors.all_findings(observations, asserted, as_of, days), observations, days, asserted,
        envelopes.support_windows(days), as_of).collect())
    told = detectors.evidence_of_all(observations, asserted, as_of)
    assert Counter(told.collect()) == expected
    assert {r.kind for r in expected} == {*detectors.ROUTE_OF}


def test_lines_are_not_sorted_for_the_record(spark):
    lines = adapters.party_lines(spark, SMALL)
    assert "SortAggregate" not in adapters.asserted(spark, SMALL, lines)._jdf.queryExecution().executedPlan().toString()
