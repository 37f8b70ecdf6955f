"""Money, orphan and plan rules at their boundaries, and spread operators against brute force."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import Window, functions as F

from corrobora.contracts import CONTRACTS
from corrobora.operators import linkage, money, orphans, planning, spread
from corrobora.streaming import refresh
from corrobora.streaming.refresh import current_findings, evidence_stream, refresh_findings_stream
from corrobora.operators import detectors


def test_withdrawal_boundaries(spark):
    cases = [("low", 50000, 59, True), ("over", 50001, 59, True), ("no pan", 60000, 12, False),
             ("five", 500000, 60, True), ("none", 0, 12, True)]
    members = spark.createDataFrame(
        [(k, Decimal(b), m, p) for k, b, m, p in cases],
        "member_key string, balance decimal(18,2), service_months bigint, has_pan boolean")
    got = {r.member_key: (r.rule, float(r.tax), float(r.net), r.months_to_free)
           for r in money.withdrawal_estimates(members).collect()}
    assert got == {"low": ("under threshold", 0, 50000, 0), "over": ("taxed", 5000.1, 45000.9, 1),
                   "no pan": ("taxed", 12000, 48000, 48), "five": ("five years", 0, 500000, 0),
                   "none": ("no balance", 0, 0, 0)}


def test_pension_boundaries(spark):
    members = spark.createDataFrame(
        [(str(m), m, Decimal(20000)) for m in (119, 120, 240, 300)] + [("poor", 120, Decimal(3000))],
        "member_key string, service_months bigint, pensionable_salary decimal(18,2)")
    got = {r.member_key: (r.eligible, r.months_short, r.monthly and float(r.monthly), float(r.at_full_service))
           for r in money.pension_estimates(members).collect()}
    assert got == {"119": (False, 1, None, 2142.86), "120": (True, 0, 2142.86, 2142.86),
                   "240": (True, 0, 4714.29, 4714.29), "300": (True, 0, 5785.71, 5785.71),
                   "poor": (True, 0, 1000.0, 1000.0)}


def test_settlement_order(spark):
    members = spark.createDataFrame(
        [("unchecked", 1, 5, True, False, None), ("blocked", 1, 1, True, True, None),
         ("kyc", 1, 0, True, True, None), ("large", 600000, 0, False, True, None),
         ("part", 600000, 0, False, True, 1000), ("auto", 1000, 0, False, True, None)],
        "member_key string, balance int, blocking_count int, kyc_risk boolean, checked boolean, amount int"
    ).withColumn("balance", F.col("balance").cast("decimal(18,2)")).withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.member_key: (r.mode, r.ceiling_applies, float(r.upi_limit))
           for r in money.settlement_verdicts(members).collect()}
    assert got == {"unchecked": ("unknown", False, 0), "blocked": ("blocked", False, 0),
                   "kyc": ("manual", False, 0), "large": ("manual", True, 0),
                   "part": ("auto", False, 450000), "auto": ("auto", False, 750)}


def test_orphan_cases(spark):
    register = spark.createDataFrame(
        [("TIDEWATER CANNERY PRIVATE LIMITED", "APVSP0071188000", True, date(2009, 4, 1), 1),
         ("MERIDIAN LOOMWORKS PRIVATE LIMITED", "GJSRT0041729000", True, date(2015, 7, 1), 2),
         ("PEREIRA & DAUGHTERS BAKERY", "", False, None, 3)], CONTRACTS["establishments"])
    cases = spark.createDataFrame(
        [("1", "p", "TIDEWATER CANNERY PVT LTD", date(2013, 10, 31), date(2014, 4, 30), 7, 31000.0),
         ("2", "p", "PEREIRA AND DAUGHTERS BAKERY", date(2015, 1, 31), date(2015, 9, 30), 9, 16500.0),
         ("3", "p", "MERIDIAN LOOMWORKS PVT LTD", date(2017, 6, 30), date(2017, 8, 31), 2, 27500.0),
         ("4", "p", "JUNIPER GLASSWORKS LLP", date(2011, 8, 31), date(2012, 5, 31), 10, 19500.0)],
        "member_key string, party_key string, name string, first_seen date, last_seen date, months bigint, "
        "gross_monthly double")
    resolved = cases.join(linkage.resolve_establishments(cases.select("name"), register), "name", "left")
    assessed = orphans.assess_orphans(resolved, date(2025, 8, 20))
    assert {r.member_key: (r.verdict, r.low is not None) for r in assessed.collect()} == {
        "1": ("LIKELY", True), "2": ("UNLIKELY", False), "3": ("UNLIKELY", False), "4": ("UNCERTAIN", False)}
    steps = {}
    for r in orphans.recovery_steps(assessed).collect():
        steps.setdefault(r.member_key, []).append((r.step_no, r.action))
    assert [n for n, _ in sorted(steps["1"])] == [1, 2, 3, 4]
    assert sorted(steps["4"])[0] == (0, "CONFIRM_NAME") and len(steps["4"]) == 5
    assert "2" not in steps and "3" not in steps


def test_plan_waves(spark):
    findings = spark.createDataFrame(
        [("a", "ORPHAN_ACCOUNT", "p", None, "OPPORTUNITY", "CLAIM_ORPHAN", 20, 3, 1),
         ("b", "EXIT_TOO_EARLY", "p", None, "BLOCKING", "JOINT_DECLARATION", 20, 0, 1),
         ("b", "SERVICE_OVERLAP", "p", "q", "BLOCKING", "JOINT_DECLARATION", 20, 1, 2),
         ("b", "JOIN_SUSPECT", "p", None, "DEGRADED", "JOINT_DECLARATION", 20, 0, 3)],
        "member_key string, kind string, party_key string, party_key_2 string, severity string, route string, "
        "days int, phase int, ord bigint")
    closed = spark.createDataFrame([("b", "p")], "member_key string, party_key string")
    got = sorted((r.member_key, r.step_no, r.kind, r.days, r.wave, r.n_deps)
                 for r in planning.plan_steps(findings, closed).collect())
    assert got == [("a", 1, "ORPHAN_ACCOUNT", 20, 1, 0), ("b", 1, "EXIT_TOO_EARLY", 30, 1, 0),
                   ("b", 2, "SERVICE_OVERLAP", 20, 2, 1)]


def test_spread_operators_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 40), i, Decimal(rng.randint(1, 900000)) / 100) for i in range(400)]
    rows += [("hot", 7, 1000 + i, Decimal("5.00")) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x int, i int, v decimal(18,2)")
    bucket = F.floor(F.col("x") / 10)
    ordered = {}
    for k, x, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ordered.setdefault(k, []).append((x, i, v))
    got = {(r.k, r.i): r.position for r in spread.position_in_group(df, ["k"], bucket, ["x", "i"]).collect()}
    assert got == {(k, i): n for k, items in ordered.items() for n, (_, i, _) in enumerate(items, 1)}
    nxt = {(r.k, r.i): r.nxt and r.nxt.i for r in spread.following_row(
        df, ["k"], bucket, ["x", "i"], F.struct("i"), "nxt").collect()}
    assert nxt == {(k, a[1]): b and b[1] for k, items in ordered.items()
                   for a, b in zip(items, items[1:] + [None])}
    medians = {r.k: r["median"] for r in spread.upper_median(df, ["k"], "v").collect()}
    assert medians == {k: sorted(v for _, _, v in items)[len(items) // 2] for k, items in ordered.items()}
    asks = spark.createDataFrame([(k, x) for k in "ab" for x in (-1, 0, 13, 99)] * 2, "k string, x int")
    totals = {(r.k, r.x): r.i for r in spread.totals_as_of(df, asks, ["k"], "x", ["i"]).collect()}
    assert totals == {(k, a): sum(i for x, i, _ in ordered[k] if x <= a) for k in "ab" for a in (-1, 0, 13, 99)}


def test_stream_equals_batch(spark, tmp_path):
    """Three batches: a file handed in twice, evidence older than all before, a finding that goes away."""
    def batch(rows):
        spark.createDataFrame(rows, CONTRACTS["observations"]).coalesce(1).write.parquet(
            f"{tmp_path}/in", mode="append")
        refresh_findings_stream(
            evidence_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/store", asserted, as_of,
            f"{tmp_path}/state", buckets=4).awaitTermination()

    def check(rows, open_exit):
        whole = spark.createDataFrame(rows, CONTRACTS["observations"])
        expected = sorted(map(str, detectors.all_findings(whole, asserted, as_of).collect()))
        got = current_findings(spark, f"{tmp_path}/store").collect()
        assert sorted(map(str, got)) == expected
        assert any((r.member_key, r.kind) == ("m", "MISSING_EXIT") for r in got) == open_exit

    as_of = date(2020, 10, 1)
    asserted = spark.createDataFrame(
        [("m", "P", "1", date(2019, 1, 1), None, 0), ("n", "P", "2", date(2020, 4, 1), date(2020, 6, 1), 0)],
        CONTRACTS["asserted"])
    one = [("m", "P", date(2019, 5, 1), "EPF_CONTRIB", None, "", 1), ("n", "P", date(2020, 5, 1), "TDS_26AS", None, "", 1)]
    two = [("n", "P", date(2020, 9, 1), "EPF_CONTRIB", None, "", 2)] * 2
    three = [("m", "P", date(2020, 9, 1), "EPF_CONTRIB", None, "", 3), ("n", "P", date(2018, 1, 1), "TDS_26AS", None, "", 3)]
    batch(one)
    check(one, True)
    batch(two)
    batch(two)
    check(one + two, True)
    batch(three)
    check(one + two + three, False)


def test_stream_reads_its_own_rows_and_the_state(spark, tmp_path, monkeypatch):
    """Four batches, bases after two deltas: the last one reads the base before it and the deltas since."""
    monkeypatch.setattr(refresh, "COMPACT_AFTER", 2)
    as_of, store, every = date(2020, 10, 1), f"{tmp_path}/store", []
    asserted = spark.createDataFrame([("m", "P", "1", date(2019, 1, 1), date(2020, 1, 1), 0)], CONTRACTS["asserted"])
    for k in range(4):
        rows = [("m", "P", date(2020, 2 + k, 1), "EPF_CONTRIB", None, "", k), ("m", "P", date(2019, 2, 1), "TDS_26AS", None, "", 0)]
        every += rows if k == 0 else rows[:1]
        spark.createDataFrame(rows, CONTRACTS["observations"]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        refresh_findings_stream(evidence_stream(spark, f"{tmp_path}/in"), store, asserted, as_of, f"{tmp_path}/state",
                                buckets=1).awaitTermination()
        expected = detectors.all_findings(spark.createDataFrame(every, CONTRACTS["observations"]), asserted, as_of).collect()
        assert sorted(map(str, current_findings(spark, store).collect())) == sorted(map(str, expected))
    index = {r.batch: r.compacted for r in spark.read.parquet(f"{store}/index").filter("batch >= 0").collect()}
    assert index == {0: False, 1: True, 2: False, 3: True}
    read, due = refresh.bucket_state(spark, store, 3, [0])
    files = {r[0].split("/evidence/")[1].split("/bucket")[0] for r in read.select(F.input_file_name()).collect()}
    assert files == {"batch=1/kind=base", "batch=2/kind=delta", "batch=3/kind=delta"}
    assert due == [0] and sum(r.copies for r in refresh.merged_copies(read).collect()) == len(every)


def test_exit_counts_any_source(spark):
    asserted = spark.createDataFrame([("m", "P", "1", date(2020, 1, 1), date(2020, 6, 1), 0)], CONTRACTS["asserted"])
    seen = spark.createDataFrame(
        [("m", "P", date(2020, month, 1), source, None, "", month) for month, source in
         ((2, "PAYSLIP"), (8, "EPF_CONTRIB"), (9, "PAYSLIP"))], CONTRACTS["observations"])
    found = detectors.all_findings(seen, asserted, date(2020, 10, 1)).filter("kind = 'EXIT_TOO_EARLY'").collect()
    assert [(r.severity, r.n_sources, r.measure) for r in found] == [("BLOCKING", 2, 2)]


def test_positions_in_sampled_buckets(spark):
    """Positions equal a plain row_number, whatever the buckets; a hot key is spread, nulls come first."""
    df = spark.range(60_000).selectExpr(
        "if(id % 10 = 0, cast(id % 70 as string), 'hot') k", "0 phase", "if(id % 997 = 0, null, hash(id) % 1000) x", "id i")
    order = ["phase", "x", "i"]
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    for rows_per_bucket in (256, 1024, 1 << 20):
        told = spread.position_in_order(df, ["k"], order, "n", rows_per_bucket)
        assert told.select(*plain.columns).exceptAll(plain).isEmpty() and told.count() == 60_000
    sizes = [r["count"] for r in spread.order_buckets(df, ["k"], order, "b", 1024).filter("k = 'hot'").groupBy("b").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 3 * 1024
    assert spread.position_in_order(df.limit(0), ["k"], order).count() == 0
