"""Findings from one row per party equal the detectors, and evidence crosses the network once."""

import functools
import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from corrobora import rules
from corrobora.operators import detectors, envelopes, planning, spread
from corrobora.plans import decision_queries
from corrobora.session import cut_lineage
from corrobora.streaming import refresh

AS_OF = date(2001, 12, 1)


def tables(spark, seed):
    """Plain parties, crowded days, unknown dates, places, sources, parties and members, several records, unknown starts."""
    rng, sources, seen, records = random.Random(seed), ["EPF_CONTRIB", "TDS_26AS", "BANK_SALARY", rules.ASSERTED_SOURCE], [], []
    for i in range(320):
        who, kind, n = [f"m{i // 4}", f"p{i % 4}"], i % 16, rng.choice([0, 1, 2, 3, 5, 12, 30])
        if kind in (8, 9) and i % 3 == 0:
            who[9 - kind] = None
        start, last_fund = date(1995, 1, 1) + timedelta(rng.randrange(900)), rng.randrange(n + 1)
        days = sorted(rng.randrange(rng.choice([3, 60 + 40 * n])) for _ in range(n))
        for k, d in enumerate(days):
            source = None if kind == 10 and k == 2 else rng.choice(sources if k <= last_fund else sources[1:])
            amount = None if source == "EPF_CONTRIB" or rng.random() < 0.1 else Decimal(rng.choice([100, 101, 102, 900]))
            for _ in range(rng.choice([1, 1, 1, 1, 2, 5 if kind in (1, 11) else 1])):
                if kind in (11, 12) and rng.random() < 0.5:
                    source, amount = rng.choice(sources), Decimal(rng.choice([100, 300]))
                seen.append((*who, start + timedelta(d) if kind != 2 or k != 3 else None, source, amount, "",
                             None if kind == 4 and k == 1 else rng.randrange(10 if kind == 13 else 10 ** 6)))
        for r in range([1, 0, 1, 1][i % 4] + (kind in (5, 6))):
            end = days[-1 - min(n - 1, rng.choice([0, 1, 2, 3, n // 2]))] if n and rng.random() < 0.8 else None
            records.append((*who, None if kind == 7 else f"a{i}-{r if kind == 5 else 0}",
                            None if kind == 14 and rng.random() < 0.5 else start + timedelta(rng.choice([-9, 0, 80])),
                            None if end is None else start + timedelta(end), r * 10 + i % 4))
    return (spark.createDataFrame(seen, "member_key string, party_key string, obs_date date, source string, "
                                  "amount decimal(18,2), note string, ord long").cache(),
            spark.createDataFrame(records, "member_key string, party_key string, account_id string, doj date, doe date, ord long").cache())


def counted(df):
    return Counter(map(str, df.collect()))


def by_detectors(observations, asserted):
    days = envelopes.evidence_days(observations).cache()
    windows = envelopes.support_windows(days)
    return counted(detectors.record_findings(observations, days, windows, asserted, AS_OF)
                   .unionByName(detectors.overlap_findings(asserted, windows, AS_OF))
                   .unionByName(detectors.orphan_findings(windows, asserted)).unionByName(detectors.gap_findings(days)))


def test_findings_of_party_rows_equal_the_detectors(spark, monkeypatch):
    observations, asserted = tables(spark, 1)
    expected = by_detectors(observations, asserted)
    assert all(any(f"kind='{kind}'" in row for row in expected) for kind in detectors.ROUTE_OF)
    parties = envelopes.party_rows(observations, asserted)
    assert detectors.party_findings(parties, AS_OF).filter("undecided IS NOT NULL").count() > 0
    assert counted(detectors.all_findings(observations, asserted, AS_OF)) == expected
    days = envelopes.evidence_days(observations)
    assert counted(envelopes.days_in(parties)) == counted(days.select(envelopes.days_in(parties).columns))
    assert counted(envelopes.party_windows(parties)) == counted(envelopes.support_windows(days))
    busy = functools.partial(spread.busy_keys, rows=64)  # a party of 60 observations and a member without a key are busy now
    monkeypatch.setattr(envelopes, "busy_keys", busy)
    assert busy(observations, envelopes.PARTY, ["source", "obs_date", "ord"]) is not None
    assert counted(detectors.all_findings(observations, asserted, AS_OF)) == expected


def test_intervals_of_busy_members(spark):
    rows = [("m", f"p{i}", i, date(1995, 1, 1) + timedelta(17 * i), date(1995, 1, 20) + timedelta(17 * i + i % 9)) for i in range(90)]
    intervals = spark.createDataFrame(rows + [("n", *r[1:]) for r in rows[:3]], "member_key string, party_key string, ord long, start date, end date")
    intervals = intervals.withColumns({"c_start": F.date_sub("start", 5), "c_end": F.col("end")})
    plain = counted(detectors.with_following(intervals))
    spread_out = spread.busy_keys(intervals, ["member_key"], ["party_key"], rows=32)
    assert [r[0] for r in spread_out.collect()] == ["m"]
    original, detectors.busy_keys = detectors.busy_keys, functools.partial(spread.busy_keys, rows=32)
    try:
        assert counted(detectors.with_following(intervals)) == plain
    finally:
        detectors.busy_keys = original


def test_observations_cross_the_network_once(spark):
    observations, asserted = tables(spark, 2)
    parties = envelopes.party_rows(observations, asserted)
    written = parties._jdf.queryExecution().executedPlan().toString()
    assert written.count("REPARTITION_BY_COL") == 1 and written.count("Exchange hashpartitioning") == 2  # the other one moves records
    told = cut_lineage(parties)
    assert "Exchange" not in detectors.party_findings(told, AS_OF)._jdf.queryExecution().executedPlan().toString()


def test_state_moves_once_for_the_rows_of_parties(spark):
    observations, asserted = tables(spark, 3)
    state = observations.filter("member_key IS NOT NULL").withColumn("copies", F.lit(1).cast("bigint"))
    state = state.unionByName(state.limit(50).withColumn("copies", F.lit(2).cast("bigint")))
    touched = state.select("member_key").distinct().filter(F.xxhash64("member_key") % 2 == 0)
    rows = refresh.repeated(refresh.merged_copies(state.join(touched, "member_key", "left_semi")))
    record = asserted.join(touched, "member_key", "left_semi")
    told = refresh.touched_rows(state, touched, asserted)
    assert counted(detectors.all_findings(rows, record, AS_OF, parties=told)) == by_detectors(rows, record)


def test_steps_are_counted_where_they_are_numbered(spark):
    found = spark.createDataFrame(
        [("a", "MISSING_EXIT", "p", None, "BLOCKING", 0, 0), ("a", "ORPHAN_ACCOUNT", "q", None, "OPPORTUNITY", 3, 5),
         ("b", "ORPHAN_ACCOUNT", "p", None, "OPPORTUNITY", 3, 1), ("a", "JOIN_SUSPECT", "p", None, "DEGRADED", 0, 2),
         (None, "MISSING_EXIT", "p", None, "BLOCKING", 0, 0)],
        "member_key string, kind string, party_key string, party_key_2 string, severity string, phase int, ord long").withColumns(
        {"route": F.lit(rules.SELF_SERVICE), "days": F.lit(1)})
    steps = planning.plan_steps(cut_lineage(found))
    assert "Join" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.member_key, r.step_no, r.kind, r.wave, r.n_deps) for r in steps.collect()) == [
        ("a", 1, "MISSING_EXIT", 1, 0), ("a", 2, "ORPHAN_ACCOUNT", 2, 1), ("b", 1, "ORPHAN_ACCOUNT", 1, 0)]


def test_corrections_look_at_their_members_only(spark):
    *_, parties, record, _, after, touched = decision_queries._corrected(spark, "/root/testdata/sf0.001")
    members = {r[0] for r in touched.collect()}
    assert {r[0] for r in parties.select("member_key").collect()} == members
    assert {r[0] for r in record.select("member_key").collect()} == members == {r[0] for r in after.select("member_key").collect()}
