"""The eight contradiction detectors, as one findings table.

Checks on a single record are columns of one joined row, so they share one
join and one explode. Checks across records (overlaps) and across months
(gaps) are windows over data already reduced to records or months.
"""

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import rules
from corrobora.functions.dates import (
    month_from_no, month_no, months_apart, stamp,
)
from corrobora.operators.envelopes import (
    PARTY, cite_first, cite_last, citation, evidence_days, latest_record, party_rows, support_windows,
)
from corrobora.operators.spread import best_before, busy_keys, following_row, totals_as_of, upper_median
from corrobora.session import cut_lineage

FINDING_COLUMNS = [
    "member_key", "kind", "party_key", "party_key_2", "account_id", "severity",
    "measure", "n_sources", "first_evidence", "fix", "route", "days", "phase", "ord",
]


def _finding(kind, severity, route, *, measure, phase, ord, party_2=None, account=None,
             n_sources=None, first_evidence=None):
    """One finding as a struct; every finding carries a fix and a route."""
    route = F.lit(route)
    return F.struct(
        F.lit(kind).alias("kind"),
        (party_2 if party_2 is not None else F.lit(None).cast("string")).alias("party_key_2"),
        (account if account is not None else F.lit(None).cast("string")).alias("account_id"),
        (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"),
        measure.cast("bigint").alias("measure"),
        (n_sources if n_sources is not None else F.lit(0)).cast("bigint").alias("n_sources"),
        (first_evidence if first_evidence is not None
         else F.lit(None).cast("date")).alias("first_evidence"),
        F.lit(rules.FIX[kind]).alias("fix"),
        route.alias("route"),
        F.lit(_days_of(kind)).alias("days"),
        F.lit(phase).alias("phase"),
        ord.cast("bigint").alias("ord"),
    )


def _days_of(kind):
    return rules.ROUTE_DAYS[ROUTE_OF[kind]]


ROUTE_OF = {
    "MISSING_EXIT": rules.SELF_SERVICE,
    "EXIT_TOO_EARLY": rules.JOINT_DECLARATION,
    "TRAILING_PAYOUT": rules.GRIEVANCE,
    "JOIN_SUSPECT": rules.JOINT_DECLARATION,
    "SERVICE_OVERLAP": rules.JOINT_DECLARATION,
    "CORRECTION_CONFLICT": rules.GRIEVANCE,
    "ORPHAN_ACCOUNT": rules.CLAIM_ORPHAN,
    "CONTRIBUTION_GAP": rules.GRIEVANCE,
}


# ----------------------------------------------------------------- exit dates

def exit_facts(observations: DataFrame, days: DataFrame, asserted: DataFrame) -> DataFrame:
    """What the evidence says after each recorded exit date.

    Exit dates and evidence days are laid on one descending timeline per party,
    so each date reads running totals of what lies after it and no exit is ever
    paired with an observation. Per party the timeline holds at most one row
    per source and calendar day.
    """
    independent = days.filter(F.col("source") != rules.ASSERTED_SOURCE)
    evidence = independent.select(
        *PARTY, F.col("obs_date").alias("day"), F.lit(1).alias("is_day"), "n_obs",
        "source",
        (F.col("source") == rules.FUND_SOURCE).cast("int").alias("from_fund"),
        stamp("obs_date", "source", rules.MONTH_STAMPED_SOURCES).alias("stamp"),
        "min_amount", "max_amount",
    )
    exits = asserted.filter(F.col("doe").isNotNull()).select(
        *PARTY, F.col("doe").alias("day"), F.lit(0).alias("is_day")).distinct()
    timeline = evidence.unionByName(exits, allowMissingColumns=True)

    newest_first = Window.partitionBy(*PARTY).orderBy(F.desc("day"), F.asc("is_day"))
    later = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    month = F.when(F.col("is_day") == 1, month_no("day"))
    timeline = timeline.withColumn(
        "new_month",
        (month.isNotNull() & ~month.eqNullSafe(F.last(month, ignorenulls=True).over(later)))
        .cast("int"))
    at_exit = timeline.select(
        *PARTY, F.col("day").alias("doe"), "is_day",
        F.coalesce(F.sum("n_obs").over(later), F.lit(0)).alias("n_later"),
        F.size(F.collect_set("source").over(later)).alias("later_sources"),
        F.coalesce(F.max("from_fund").over(later), F.lit(0)).alias("fund_later"),
        F.coalesce(F.sum("new_month").over(later), F.lit(0)).alias("later_months"),
        F.min("stamp").over(later).alias("first_stamp"),
        F.min("min_amount").over(later).alias("tail_low"),
        F.max("max_amount").over(later).alias("tail_high"),
    ).filter((F.col("is_day") == 0) & (F.col("n_later") > 0)).drop("is_day")
    # at most one row per record, read three times below: written once
    at_exit = cut_lineage(at_exit)

    # Only a short tail without fund payments can be a settlement. Exits with
    # the same evidence after them share the evidence before them, so their
    # median is taken once.
    short_tail = at_exit.filter(
        (F.col("fund_later") == 0)
        & (F.col("later_months") <= rules.SETTLEMENT_TAIL_MONTHS)
        & F.col("tail_low").isNotNull())
    cuts = short_tail.groupBy(*PARTY, "n_later").agg(F.max("doe").alias("_cut"))
    paid_before = (
        observations
        .filter(F.col("amount").isNotNull() & (F.col("source") != rules.ASSERTED_SOURCE))
        .select(*PARTY, "obs_date", "amount")
        .join(cuts, PARTY)
        .filter(F.col("obs_date") <= F.col("_cut"))
    )
    usual = upper_median(paid_before, [*PARTY, "n_later"], "amount", "usual_amount")

    allowed = F.col("usual_amount") * F.lit(rules.SETTLEMENT_DEVIATION).cast("decimal(3,2)")
    breaks_pattern = (F.col("usual_amount") > 0) & (
        (F.col("tail_high") - F.col("usual_amount") > allowed)
        | (F.col("usual_amount") - F.col("tail_low") > allowed))
    settled = (
        short_tail.join(usual, [*PARTY, "n_later"]).filter(breaks_pattern)
        .select(*PARTY, "doe", F.lit(True).alias("settlement"))
    )
    return (
        at_exit.join(settled, [*PARTY, "doe"], "left")
        .select(*PARTY, "doe", "n_later", "later_sources", "later_months", "first_stamp",
                F.coalesce("settlement", F.lit(False)).alias("settlement"))
    )


def record_findings(observations, days, windows, asserted, as_of) -> DataFrame:
    """Every check on one record against its own envelope."""
    dated = cite_last(observations).groupBy(*PARTY).agg(F.min("stamp").alias("last_cited"))
    seen = (
        asserted.join(windows.select(*PARTY, "earliest", "latest"), PARTY)
        .join(dated, PARTY, "left")
        .join(exit_facts(observations, days, asserted), [*PARTY, "doe"], "left")
    )
    stale = month_no(F.lit(as_of)) - month_no("latest")
    gap = months_apart("doj", "earliest")
    after_exit = F.col("n_later").isNotNull()
    checks = [
        F.when(
            F.col("doe").isNull() & (stale >= rules.STALE_EXIT_MONTHS),
            _finding("MISSING_EXIT", rules.BLOCKING, ROUTE_OF["MISSING_EXIT"],
                     measure=stale, phase=0, ord=F.col("ord") * 4, account=F.col("account_id"),
                     first_evidence=F.col("last_cited"))),
        F.when(
            after_exit & F.col("settlement"),
            _finding("TRAILING_PAYOUT", rules.DEGRADED, ROUTE_OF["TRAILING_PAYOUT"],
                     measure=F.col("n_later"), phase=0, ord=F.col("ord") * 4 + 1,
                     account=F.col("account_id"), n_sources=F.col("later_sources"),
                     first_evidence=F.col("first_stamp"))),
        F.when(
            after_exit & ~F.col("settlement"),
            _finding("EXIT_TOO_EARLY",
                     F.when(F.col("later_sources") >= 2, rules.BLOCKING)
                     .otherwise(rules.DEGRADED),
                     ROUTE_OF["EXIT_TOO_EARLY"],
                     measure=F.col("n_later"), phase=0, ord=F.col("ord") * 4 + 1,
                     account=F.col("account_id"), n_sources=F.col("later_sources"),
                     first_evidence=F.col("first_stamp"))),
        F.when(
            gap > rules.JOIN_GAP_MONTHS,
            _finding("JOIN_SUSPECT", rules.DEGRADED, ROUTE_OF["JOIN_SUSPECT"],
                     measure=gap, phase=0, ord=F.col("ord") * 4 + 2,
                     account=F.col("account_id"))),
    ]
    return seen.select(
        *PARTY, F.explode(F.array_compact(F.array(*checks))).alias("f")
    ).select(*PARTY, "f.*").select(*FINDING_COLUMNS)


# ------------------------------------------------------------------- overlaps

def asserted_intervals(asserted: DataFrame, as_of) -> DataFrame:
    return latest_record(asserted).select(
        *PARTY, "ord", F.col("doj").alias("start"),
        F.coalesce("doe", F.lit(as_of)).alias("end"))


def corrected_timeline(asserted: DataFrame, windows: DataFrame, as_of) -> DataFrame:
    """Boundaries moved out to where the evidence reaches."""
    return (
        asserted_intervals(asserted, as_of)
        .join(windows.select(*PARTY, "earliest", "latest"), PARTY, "left")
        .select(*PARTY, "ord", F.least("start", "earliest").alias("start"),
                F.greatest("end", "latest").alias("end"))
    )


def adjacent_overlaps(intervals: DataFrame) -> DataFrame:
    """Each interval against the next one by start; a shared day is an overlap."""
    paired = following_row(
        intervals, ["member_key"], month_no("start"), ["start", "ord"],
        F.struct("party_key", "start"), "next")
    return paired.filter(F.col("end") >= F.col("next.start")).select(
        "member_key", "party_key", F.col("next.party_key").alias("party_key_2"),
        F.col("start").alias("a_start"), F.col("end").alias("a_end"),
        F.col("next.start").alias("b_start"),
        (F.datediff("end", "next.start") + 1).alias("overlap_days"), "ord",
    )


def overlaps_all_pairs(intervals: DataFrame) -> DataFrame:
    """J4 beyond neighbours: of each interval, how many others share a day with it, and which ones matter most.

    ``intervals``: member_key, party_key, ord, start, end; (start, ord) is unique in a member, ends are not before
    starts. A sweep over starts and ends per day gives the number: what began up to the last day, less what was over
    before the first. Beside it stand the earlier interval that reaches furthest into this one with the days shared
    (ties: the one that began first), and the next one to begin while this one runs. No pair of intervals is formed:
    a member has a row per interval and a row per day at most, spread over months.
    """
    key = ["member_key"]
    opened = intervals.select(*key, F.col("start").alias("day"), F.lit(1).alias("opened"))
    closed = intervals.select(*key, F.date_add("end", 1).alias("day"), F.lit(1).alias("closed"))
    begun = totals_as_of(opened, intervals.select(*key, F.col("end").alias("day")), key, "day", ["opened"])
    over = totals_as_of(closed, intervals.select(*key, F.col("start").alias("day")), key, "day", ["closed"])
    reach = F.struct(F.col("end").alias("end"), (-F.unix_date("start")).alias("began"), (-F.col("ord")).alias("ord"),
                     F.col("party_key").alias("party"))
    placed = best_before(intervals, key, month_no("start"), ["start", "ord"], reach, "before")
    placed = following_row(placed, key, month_no("start"), ["start", "ord"], F.struct("party_key", "start"), "next")
    shared = F.when(F.col("before").isNotNull(), F.datediff(F.least("end", "before.end"), "start") + 1)
    return (
        placed.join(begun.withColumnRenamed("day", "end"), [*key, "end"])
        .join(over.withColumnRenamed("day", "start"), [*key, "start"])
        .select(*PARTY, "ord", "start", "end", (F.col("opened") - F.col("closed") - 1).alias("n_overlaps"),
                F.when(shared > 0, F.col("before.party")).alias("earlier_party"),
                F.when(shared > 0, shared).alias("earlier_days"),
                F.when(F.col("next.start") <= F.col("end"), F.col("next.party_key")).alias("next_party"))
    )


def overlap_findings(asserted, windows, as_of) -> DataFrame:
    """Overlaps on record, and overlaps a correction would create."""
    on_record = adjacent_overlaps(asserted_intervals(asserted, as_of))
    corrected = adjacent_overlaps(corrected_timeline(asserted, windows, as_of))
    new_only = corrected.join(
        on_record.select("member_key", "party_key", "party_key_2"),
        ["member_key", "party_key", "party_key_2"], "left_anti")

    def shaped(df, kind, severity, phase):
        by_start = F.shiftleft(F.unix_date("a_start").cast("bigint"), 32) + F.col("ord")
        return df.select(
            *PARTY, _finding(kind, severity, ROUTE_OF[kind], measure=F.col("overlap_days"),
                             phase=phase, ord=by_start, party_2=F.col("party_key_2")).alias("f")
        ).select(*PARTY, "f.*").select(*FINDING_COLUMNS)

    return shaped(on_record, "SERVICE_OVERLAP", rules.BLOCKING, 1).unionByName(
        shaped(new_only, "CORRECTION_CONFLICT", rules.DEGRADED, 2))


# -------------------------------------------------------------------- orphans

def orphans(windows: DataFrame, asserted: DataFrame) -> DataFrame:
    """Parties with evidence and no record at all."""
    return windows.join(asserted.select(*PARTY).distinct(), PARTY, "left_anti")


def orphan_findings(windows, asserted) -> DataFrame:
    span = months_apart("earliest", "latest") + 1
    return orphans(windows, asserted).select(
        *PARTY, _finding("ORPHAN_ACCOUNT", rules.OPPORTUNITY, ROUTE_OF["ORPHAN_ACCOUNT"],
                         measure=span, phase=3, ord=F.col("first_ord")).alias("f")
    ).select(*PARTY, "f.*").select(*FINDING_COLUMNS)


# ----------------------------------------------------------------------- gaps

def gap_months(days: DataFrame) -> DataFrame:
    """Months with tax deducted and no contribution, strictly inside the contributions' span."""
    by_month = (
        days.filter(F.col("source").isin(rules.FUND_SOURCE, rules.TAX_SOURCE))
        .groupBy(*PARTY, month_no("obs_date").alias("month"))
        .agg(F.max(F.col("source") == rules.FUND_SOURCE).alias("in_fund"),
             F.max(F.col("source") == rules.TAX_SOURCE).alias("in_tax"))
    )
    party = Window.partitionBy(*PARTY)
    fund_month = F.when(F.col("in_fund"), F.col("month"))
    return (
        by_month.withColumn("fund_first", F.min(fund_month).over(party))
        .withColumn("fund_last", F.max(fund_month).over(party))
        .filter(F.col("in_tax") & ~F.col("in_fund")
                & (F.col("month") > F.col("fund_first")) & (F.col("month") < F.col("fund_last")))
        .select(*PARTY, "month", "fund_first", "fund_last")
    )


def gap_runs(missing: DataFrame) -> DataFrame:
    island = F.col("month") - F.row_number().over(Window.partitionBy(*PARTY).orderBy("month"))
    return (
        missing.withColumn("_island", island)
        .groupBy(*PARTY, "fund_first", "fund_last", "_island")
        .agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"),
             F.count(F.lit(1)).alias("n_months"))
        .drop("_island")
    )


def contribution_gaps(days: DataFrame) -> DataFrame:
    """One row per party with a gap, its runs listed in order."""
    def label(number):
        return F.date_format(month_from_no(number), "yyyy-MM")

    spans = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("first_month", "last_month"))),
        lambda run: F.when(run["first_month"] == run["last_month"], label(run["first_month"]))
        .otherwise(F.concat(label(run["first_month"]), F.lit(" to "), label(run["last_month"])))
    ), ", ")
    return gap_runs(gap_months(days)).groupBy(*PARTY, "fund_first", "fund_last").agg(
        F.sum("n_months").alias("n_months"), F.count(F.lit(1)).alias("n_runs"),
        spans.alias("spans"),
    )


def gap_findings(days: DataFrame) -> DataFrame:
    return contribution_gaps(days).select(
        *PARTY, _finding("CONTRIBUTION_GAP", rules.BLOCKING, ROUTE_OF["CONTRIBUTION_GAP"],
                         measure=F.col("n_months"), phase=4, ord=F.lit(0),
                         first_evidence=month_from_no("fund_first")).alias("f")
    ).select(*PARTY, "f.*").select(*FINDING_COLUMNS)


# ------------------------------------------------------------------- together

def all_findings(observations: DataFrame, asserted: DataFrame, as_of, days=None, parties=None) -> DataFrame:
    """The union of all detectors, from one row per party with its evidence and its records.

    ``parties`` is ``party_rows(observations, asserted)``, if it is there already. What a row can't tell, as it knows days
    and not observations, is left to the detectors of records, for these records alone; ``days`` (``evidence_days``) saves
    them the reduction. What the rows say is written once, overlaps are found from its intervals.
    """
    told = cut_lineage(party_findings(party_rows(observations, asserted) if parties is None else parties, as_of))
    found = (
        told.select(*PARTY, F.explode_outer("found").alias("f")).filter(F.col("f").isNotNull())
        .select(*PARTY, "f.*").select(*FINDING_COLUMNS)
        .unionByName(interval_findings(told.filter(F.col("interval").isNotNull()).select(*PARTY, "interval.*"))))
    undecided = told.filter(F.col("undecided").isNotNull()).select(*PARTY, "undecided.*")
    if undecided.isEmpty():
        return found
    records = cut_lineage(undecided)
    concerned = cut_lineage(records.select(*PARTY).distinct())
    crowded = cut_lineage(observations.join(concerned, PARTY, "left_semi"))
    crowded_days = cut_lineage(evidence_days(crowded) if days is None else days.join(concerned, PARTY, "left_semi"))
    return found.unionByName(record_findings(crowded, crowded_days, support_windows(crowded_days), records, as_of))


def with_following(intervals: DataFrame) -> DataFrame:
    """Each interval with the next one by start on record (``next``) and by corrected start (``c_next``).

    Members cross the network once, unless they have very many intervals: these are spread over months.
    """
    key = ["member_key"]

    def starting(column):
        return F.struct("party_key", F.col(column).alias("start"))

    def at_once(rows):
        def following(column):
            following = F.lead(starting(column)).over(Window.partitionBy(*key).orderBy(column, "ord"))
            # intervals of an unknown member meet in their month only
            return F.when(F.col("member_key").isNotNull() | (month_no(following["start"]) == month_no(column)), following)
        return rows.select("*", following("start").alias("next"), following("c_start").alias("c_next"))

    def by_month(rows):
        for column, name in (("start", "next"), ("c_start", "c_next")):
            rows = following_row(rows, key, month_no(column), [column, "ord"], starting(column), name)
        return rows

    busy = busy_keys(intervals, key, ["party_key"])
    if busy is None:
        return at_once(intervals)
    return at_once(intervals.join(busy, key, "left_anti")).unionByName(by_month(intervals.join(busy, key, "left_semi")))


def interval_findings(intervals: DataFrame) -> DataFrame:
    """J4 and J5 of one row per party: start and end on record, and as the evidence corrects them.

    Both overlaps of an interval are in its row, so a pair on record is known where its correction is looked at.
    """
    seen = with_following(intervals)
    on_record = "start IS NOT NULL AND coalesce(end >= next.start, false)"
    corrected = "c_start IS NOT NULL AND coalesce(c_end >= c_next.start, false)"
    same = f"coalesce({on_record} AND member_key IS NOT NULL AND party_key IS NOT NULL AND next.party_key = c_next.party_key, false)"

    def shaped(kind, severity, phase, start, end, following):
        return _finding_sql(
            kind, f"'{severity}'", f"datediff({end}, {following}.start) + 1", phase,
            f"shiftleft(CAST(unix_date({start}) AS BIGINT), 32) + ord", party_2=f"{following}.party_key")
    return seen.selectExpr(*PARTY, f"""explode_outer(array_compact(array(
        CASE WHEN {on_record} THEN {shaped("SERVICE_OVERLAP", rules.BLOCKING, 1, "start", "end", "next")} END,
        CASE WHEN {corrected} AND NOT {same}
          THEN {shaped("CORRECTION_CONFLICT", rules.DEGRADED, 2, "c_start", "c_end", "c_next")} END))) AS f""").filter(
        "f IS NOT NULL").select(*PARTY, "f.*").select(*FINDING_COLUMNS)


def _finding_sql(kind, severity, measure, phase, ord, account="CAST(NULL AS STRING)", party_2="CAST(NULL AS STRING)", n_sources="0",
                 first_evidence="CAST(NULL AS DATE)"):
    """``_finding`` as SQL text."""
    return f"""named_struct(
      'kind', '{kind}', 'party_key_2', {party_2}, 'account_id', {account}, 'severity', {severity},
      'measure', CAST({measure} AS BIGINT), 'n_sources', CAST({n_sources} AS BIGINT), 'first_evidence', {first_evidence},
      'fix', '{rules.FIX[kind]}', 'route', '{ROUTE_OF[kind]}', 'days', {_days_of(kind)}, 'phase', {phase}, 'ord', CAST({ord} AS BIGINT))"""


def party_findings(parties: DataFrame, as_of) -> DataFrame:
    """What each row of ``party_rows`` tells by itself: a row per record, or one for a party without.

    ``found``: findings on the record, and on a party's first row unlinked accounts and gaps. ``interval``: the record the
    party counts with, on its first row. ``undecided``: a record that needs the observations themselves, for the median of
    payments on crowded days, or for the last citations where a crowded day holds the third.
    """
    amount = parties.schema["days"].dataType.elementType["min_amount"].dataType.simpleString()
    fund, tax = f"'{rules.FUND_SOURCE}'", f"'{rules.TAX_SOURCE}'"
    by_month = "d.source IN ({})".format(", ".join(f"'{source}'" for source in rules.MONTH_STAMPED_SOURCES))
    today = f"DATE '{as_of.isoformat()}'"

    def month(day):
        return f"(year({day}) * 12 + month({day}) - 1)"

    def months_of(source):
        return f"array_distinct(transform(filter(days, d -> d.source = {source}), d -> {month('d.obs_date')}))"

    def of(days, column):
        return f"transform({days}, d -> d.{column})"

    def stamps(days):
        return f"transform({days}, d -> CASE WHEN {by_month} THEN trunc(d.obs_date, 'MM') ELSE d.obs_date END)"

    def n_obs(days):
        return f"aggregate({days}, 0L, (n, d) -> n + d.n_obs)"

    def certain(condition):
        return f"coalesce({condition}, false)"

    def last_of(last, first):
        return f"coalesce(d.{last}, d.{first})"

    stale = f"({month(today)} - {month('latest')})"
    allowed = f"usual * CAST({rules.SETTLEMENT_DEVIATION} AS DECIMAL(3,2))"
    rows = parties.selectExpr(
        *PARTY, "days", "records", f"filter(days, d -> d.source <> '{rules.ASSERTED_SOURCE}') AS seen",
        "posexplode_outer(records) AS (k, r)")
    steps = [
        {"earliest": f"array_min({of('seen', 'obs_date')})", "latest": f"array_max({of('seen', 'obs_date')})",
         "ord": "r.ord", "account_id": "r.account_id", "doj": "r.doj", "doe": "r.doe", "first": "coalesce(k, 0) = 0",
         "tail": "filter(seen, d -> d.obs_date > r.doe)"},
        # only a short tail without fund payments can be a settlement, if it breaks the pattern of payments before it
        {"no_exit": certain(f"records IS NOT NULL AND doe IS NULL AND {stale} >= {rules.STALE_EXIT_MONTHS}"),
         "short": certain(f"""NOT exists(tail, d -> d.source = {fund}) AND exists(tail, d -> d.min_amount IS NOT NULL)
           AND size(array_distinct(transform(tail, d -> {month('d.obs_date')}))) <= {rules.SETTLEMENT_TAIL_MONTHS}"""),
         "later_sources": f"size(array_distinct({of('tail', 'source')}))", "after_exit": certain("size(tail) > 0"),
         "first_stamp": f"array_min({stamps('tail')})"},
        {"before": "CASE WHEN short THEN filter(seen, d -> d.n_amounts > 0 AND d.obs_date <= doe) END",
         # the last three observations lie on the last three days of sources; on the date of the third there may be a choice
         "last": "CASE WHEN no_exit THEN slice(reverse(filter(seen, d -> d.obs_date IS NOT NULL)), 1, 3) END"},
        {"unknown_pay": certain("exists(before, d -> d.n_amounts > 2 AND d.max_amount IS NOT NULL)"),
         "paid": """sort_array(flatten(transform(before, d -> CASE WHEN d.max_amount IS NULL
           THEN array(named_struct('amount', d.min_amount, 'n', d.n_amounts))
           ELSE array(named_struct('amount', d.min_amount, 'n', 1L), named_struct('amount', d.max_amount, 'n', 1L)) END)))""",
         "third": f"""CASE WHEN {n_obs('slice(last, 1, 1)')} >= 3 THEN get(last, 0).obs_date
           WHEN {n_obs('slice(last, 1, 2)')} >= 3 THEN get(last, 1).obs_date ELSE get(last, 2).obs_date END"""},
        {"half": "floor(aggregate(paid, 0L, (n, p) -> n + p.n) / 2)",
         "newer": "CASE WHEN third IS NULL THEN last ELSE filter(seen, d -> d.obs_date > third) END",
         "at_third": "CASE WHEN third IS NOT NULL THEN filter(seen, d -> d.obs_date = third) END"},
        {"usual": f"""aggregate(paid, named_struct('n', 0L, 'amount', CAST(NULL AS {amount})),
           (upto, p) -> named_struct('n', upto.n + p.n, 'amount',
             CASE WHEN upto.n <= half AND upto.n + p.n > half THEN p.amount ELSE upto.amount END), upto -> upto.amount)""",
         "free": f"3 - {n_obs('newer')}"},
        {"choice": certain(f"""{n_obs('at_third')} > free AND exists(at_third, d -> {by_month})
           AND exists(at_third, d -> NOT {by_month})"""),
         "settlement": certain(f"""short AND usual > 0 AND (
           array_max(transform(tail, d -> {last_of('max_amount', 'min_amount')})) - usual > {allowed}
           OR usual - array_min({of('tail', 'min_amount')}) > {allowed})""")},
        {"unknown_place": certain("choice AND exists(at_third, d -> d.n_obs > 2 OR NOT d.placed)")},
        {"month_cited": f"""CASE WHEN choice AND NOT unknown_place THEN exists(slice(sort_array(flatten(transform(at_third, d ->
             CASE WHEN d.n_obs = 1 THEN array(named_struct('ord', d.first_ord, 'source', d.source))
             ELSE array(named_struct('ord', d.first_ord, 'source', d.source),
                        named_struct('ord', {last_of('last_ord', 'first_ord')}, 'source', d.source)) END)), false),
           1, CAST(free AS INT)), d -> {by_month}) ELSE exists(at_third, d -> {by_month}) END""",
         "open_record": "unknown_pay OR unknown_place",
         "fund": f"CASE WHEN first THEN {months_of(fund)} END",
         # a party's last record holds the place of its first, as in latest_record
         "counts": "CASE WHEN first THEN array_max(records) END"},
        {"last_cited": f"""least(array_min({stamps('newer')}),
           CASE WHEN month_cited THEN trunc(third, 'MM') ELSE third END)""",
         "fund_first": "array_min(fund)", "fund_last": "array_max(fund)"},
        {"missing": f"""CASE WHEN size(fund) > 0 THEN filter(
           array_except({months_of(tax)}, fund), m -> m > fund_first AND m < fund_last) END"""},
    ]
    for step in steps:
        rows = rows.withColumns({name: F.expr(text) for name, text in step.items()})
    exit_cited = {"measure": n_obs("tail"), "phase": 0, "ord": "ord * 4 + 1", "account": "account_id",
                  "n_sources": "later_sources", "first_evidence": "first_stamp"}
    late_join = f"({month('earliest')} - {month('doj')})"
    checks = [
        ("no_exit AND NOT open_record", _finding_sql(
            "MISSING_EXIT", f"'{rules.BLOCKING}'", stale, 0, "ord * 4", "account_id", first_evidence="last_cited")),
        ("after_exit AND settlement AND NOT open_record", _finding_sql("TRAILING_PAYOUT", f"'{rules.DEGRADED}'", **exit_cited)),
        ("after_exit AND NOT settlement AND NOT open_record", _finding_sql(
            "EXIT_TOO_EARLY", f"CASE WHEN later_sources >= 2 THEN '{rules.BLOCKING}' ELSE '{rules.DEGRADED}' END", **exit_cited)),
        (f"records IS NOT NULL AND {late_join} > {rules.JOIN_GAP_MONTHS} AND NOT open_record", _finding_sql(
            "JOIN_SUSPECT", f"'{rules.DEGRADED}'", late_join, 0, "ord * 4 + 2", "account_id")),
        ("records IS NULL AND size(seen) > 0", _finding_sql(
            "ORPHAN_ACCOUNT", f"'{rules.OPPORTUNITY}'", f"{month('latest')} - {month('earliest')} + 1", 3,
            f"array_min({of('seen', 'first_ord')})")),
        ("first AND size(missing) > 0", _finding_sql(
            "CONTRIBUTION_GAP", f"'{rules.BLOCKING}'", "size(missing)", 4, "0",
            first_evidence="make_date(CAST(floor(fund_first / 12) AS INT), fund_first % 12 + 1, 1)")),
    ]
    found = ", ".join(f"CASE WHEN {condition} THEN {finding} END" for condition, finding in checks)
    return rows.selectExpr(
        *PARTY, f"array_compact(array({found})) AS found",
        f"""CASE WHEN counts IS NOT NULL THEN named_struct(
              'ord', array_min(transform(records, r -> r.ord)), 'start', counts.doj, 'end', coalesce(counts.doe, {today}),
              'c_start', least(counts.doj, earliest), 'c_end', greatest(coalesce(counts.doe, {today}), latest)) END AS interval""",
        "CASE WHEN open_record THEN named_struct('account_id', account_id, 'doj', doj, 'doe', doe, 'ord', ord) END AS undecided")


def finding_evidence(findings, observations, days, asserted, windows, as_of) -> DataFrame:
    """The citations behind each finding, one row per citation.

    A row per citation rather than an array per finding: an early exit cites
    everything after it, which for a busy party has no bound.
    """
    return record_evidence(findings, observations, days, asserted).unionByName(
        overlap_evidence(asserted, windows, as_of))


def record_evidence(findings, observations, days, asserted) -> DataFrame:
    """The citations of everything but overlaps."""
    last3 = cite_last(observations).select(*PARTY, "cite_no", "citation")
    first3 = cite_first(observations).select(*PARTY, "cite_no", "citation")

    def kinds(*names):
        return findings.filter(F.col("kind").isin(*names)).select(*PARTY, "kind").distinct()

    after = (
        findings.filter(F.col("kind").isin("EXIT_TOO_EARLY", "TRAILING_PAYOUT"))
        .select(*PARTY, "kind", "account_id")
        .join(asserted.select(*PARTY, "account_id", "doe"), [*PARTY, "account_id"])
        .select(*PARTY, "kind", "doe").distinct()
    )
    later = (
        observations.filter(F.col("source") != rules.ASSERTED_SOURCE)
        .join(after, PARTY).filter(F.col("obs_date") > F.col("doe"))
        .select(*PARTY, "kind", F.lit(0).alias("cite_no"), citation().alias("citation"))
    )

    def month_cite(source, number, tail=""):
        return F.concat(F.lit(source + "@"), F.date_format(month_from_no(number), "yyyy-MM"),
                        F.lit(tail))

    missing = gap_months(days).withColumn(
        "cite_no", F.row_number().over(Window.partitionBy(*PARTY).orderBy("month")))
    gap_cited = missing.filter(F.col("cite_no") <= rules.GAP_CITATIONS).select(
        *PARTY, F.lit("CONTRIBUTION_GAP").alias("kind"), "cite_no",
        month_cite(rules.TAX_SOURCE, F.col("month")).alias("citation"))
    gap_bounds = missing.filter(F.col("cite_no") == 1).select(
        *PARTY, F.lit("CONTRIBUTION_GAP").alias("kind"),
        F.explode(F.array(
            F.struct(F.lit(rules.GAP_CITATIONS + 1).alias("cite_no"),
                     month_cite(rules.FUND_SOURCE, F.col("fund_first"), " (first)").alias("citation")),
            F.struct(F.lit(rules.GAP_CITATIONS + 2).alias("cite_no"),
                     month_cite(rules.FUND_SOURCE, F.col("fund_last"), " (last)").alias("citation")),
        )).alias("c")).select(*PARTY, "kind", "c.*")

    return (
        last3.join(kinds("MISSING_EXIT"), PARTY)
        .unionByName(first3.join(kinds("JOIN_SUSPECT", "ORPHAN_ACCOUNT"), PARTY))
        .unionByName(later).unionByName(gap_cited).unionByName(gap_bounds)
        .select(*PARTY, "kind", "cite_no", "citation")
    )


def overlap_evidence(asserted, windows, as_of) -> DataFrame:
    """The citations of overlaps, on record or by a correction: both bounds."""
    on_record = cut_lineage(adjacent_overlaps(asserted_intervals(asserted, as_of))).select(
        "*", F.lit("SERVICE_OVERLAP").alias("kind"), F.lit("asserted").alias("basis"))
    corrected = adjacent_overlaps(corrected_timeline(asserted, windows, as_of)).join(
        on_record.select("member_key", "party_key", "party_key_2"),
        ["member_key", "party_key", "party_key_2"], "left_anti").select(
        "*", F.lit("CORRECTION_CONFLICT").alias("kind"), F.lit("corrected").alias("basis"))
    return on_record.unionByName(corrected).select(
        *PARTY, "kind", F.explode(F.array(
            F.struct(F.lit(1).alias("cite_no"), F.concat(
                "basis", F.lit(":"), "party_key", F.lit("[.."),
                F.col("a_end").cast("string"), F.lit("]")).alias("citation")),
            F.struct(F.lit(2).alias("cite_no"), F.concat(
                F.lit("asserted:"), "party_key_2", F.lit("["),
                F.col("b_start").cast("string"), F.lit("..]")).alias("citation")),
        )).alias("c")).select(*PARTY, "kind", "c.*")


# ---------------------------------------------- evidence without the findings

# observations of one party, source and day that a party's row can hold
PLAIN_OBSERVATIONS = 2


def party_evidence(observations: DataFrame) -> DataFrame:
    """One row per party: its envelope and, by time, its independent observations (``seen``), for a plain party.

    A party is plain if no day of a source has more than ``PLAIN_OBSERVATIONS``, and all have a date and a place and no
    note. Its row is bounded by the calendar, as are the rows of any other party, which keeps no observations here.
    Counts and extremes per day are taken before the shuffle; of two observations of a day they are all there is to know.
    """
    per_day = observations.filter(F.col("source") != rules.ASSERTED_SOURCE).groupBy(*PARTY, "source", "obs_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("ord").alias("n_ord"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.min("amount").alias("low"), F.max("amount").alias("high"), F.count("amount").alias("n_amounts"),
        F.max(F.coalesce(F.col("note"), F.lit("")) != "").alias("noted"))
    plain = ((F.col("n") <= PLAIN_OBSERVATIONS) & (F.col("n_ord") == F.col("n")) & ~F.col("noted")
             & F.col("obs_date").isNotNull())

    def one(ord, amount):
        return F.struct("obs_date", F.col(ord).alias("ord"), "source", F.col(amount).alias("amount"))
    # which of a day's two observations has which amount plays no part
    both = F.when(F.col("n") == 1, F.array(one("first_ord", "low"))).otherwise(F.array(
        one("first_ord", "low"), F.struct("obs_date", F.col("last_ord").alias("ord"), "source", F.when(
            F.col("n_amounts") == 2, F.col("high")).alias("amount"))))
    return per_day.select(*PARTY, "obs_date", plain.alias("plain"), F.when(plain, both).alias("both")).repartition(*PARTY).groupBy(*PARTY).agg(
        F.min("obs_date").alias("earliest"), F.max("obs_date").alias("latest"), F.min("plain").alias("plain"),
        F.collect_list("both").alias("days"),
    ).select(*PARTY, "earliest", "latest", "plain",
             F.when(F.col("plain"), F.sort_array(F.flatten("days"))).alias("seen"))


def evidence_of_all(observations: DataFrame, asserted: DataFrame, as_of) -> DataFrame:
    """``finding_evidence`` of ``all_findings``, from one row per party with its evidence and its record.

    Plain parties with at most one record, of a known account, are settled in their row. All others, and only they, go
    through the detectors.
    """
    key = F.struct("ord", "account_id", "doj", "doe")
    records = asserted.groupBy(*PARTY).agg(
        F.count(F.lit(1)).alias("n_records"), F.max(key).alias("last"), F.min("ord").alias("ord"),
    ).select(*PARTY, "n_records", "last.account_id", "last.doj", "last.doe", "ord")
    known = F.col("n_records").isNull() | ((F.col("n_records") == 1) & F.col("account_id").isNotNull())
    parties = cut_lineage(party_evidence(observations).join(records, PARTY, "full").withColumn(
        "plain", F.coalesce("plain", F.lit(True)) & known))

    others = cut_lineage(parties.filter(~F.col("plain")).select(*PARTY))
    crowded = cut_lineage(observations.join(others, PARTY, "left_semi"))
    recorded = cut_lineage(asserted.join(others, PARTY, "left_semi"))
    days = cut_lineage(evidence_days(crowded))
    windows = support_windows(days)
    found = cut_lineage(
        record_findings(crowded, days, windows, recorded, as_of).unionByName(orphan_findings(windows, recorded)))

    # a party's last record holds its place among all, as in latest_record
    on_record = parties.filter(F.col("n_records").isNotNull()).select(*PARTY, "account_id", "doj", "doe", "ord")
    envelopes = parties.filter(F.col("earliest").isNotNull()).select(*PARTY, "earliest", "latest")
    return (
        plain_evidence(parties.filter(F.col("plain") & F.col("earliest").isNotNull()), as_of)
        .unionByName(record_evidence(found, crowded, days, recorded))
        .unionByName(overlap_evidence(on_record, envelopes, as_of))
    )


def plain_evidence(parties: DataFrame, as_of) -> DataFrame:
    """The citations of everything but overlaps, each party by its own row (``seen``, record if any)."""
    def cited(kind, number, source, day, tail=""):
        return F.struct(kind.alias("kind"), number.cast("int").alias("cite_no"), source.alias("source"), day.alias("day"),
                        F.lit(tail).alias("tail"))

    def seen_at(kind, number, x):
        return cited(F.lit(kind) if isinstance(kind, str) else kind, number, x["source"], x["obs_date"])

    def months_of(source):
        return F.array_distinct(F.transform(F.filter("seen", lambda x: x["source"] == source), lambda x: month_no(x["obs_date"])))

    def gap_at(number, source, month, tail=""):
        return cited(F.lit("CONTRIBUTION_GAP"), number, F.lit(source), month_from_no(month), tail)

    none = F.array().cast("array<struct<kind:string,cite_no:int,source:string,day:date,tail:string>>")
    kept = F.coalesce(F.col("n_records"), F.lit(0)) == 1
    told = parties.select(
        *PARTY, "seen", "doe", kept.alias("kept"),
        (kept & F.col("doe").isNull()
         & (month_no(F.lit(as_of)) - month_no("latest") >= rules.STALE_EXIT_MONTHS)).alias("no_exit"),
        (kept & (months_apart("doj", "earliest") > rules.JOIN_GAP_MONTHS)).alias("late_join"),
        F.filter("seen", lambda x: x["obs_date"] > F.col("doe")).alias("tail"),
        months_of(rules.FUND_SOURCE).alias("fund"), months_of(rules.TAX_SOURCE).alias("tax"))
    # the settlement of exit_facts: a short tail without fund payments that breaks the pattern of payments before it
    told = told.withColumn("paid", F.sort_array(F.transform(
        F.filter("seen", lambda x: x["amount"].isNotNull() & (x["obs_date"] <= F.col("doe"))), lambda x: x["amount"])))
    told = told.select(
        "*", F.array_min("fund").alias("fund_first"), F.array_max("fund").alias("fund_last"),
        F.array_min(F.transform("tail", lambda x: x["amount"])).alias("tail_low"),
        F.array_max(F.transform("tail", lambda x: x["amount"])).alias("tail_high"),
        (~F.exists("tail", lambda x: x["source"] == rules.FUND_SOURCE) & (F.size(F.array_distinct(F.transform(
            "tail", lambda x: month_no(x["obs_date"])))) <= rules.SETTLEMENT_TAIL_MONTHS)).alias("short"),
        F.try_element_at("paid", (F.floor(F.size("paid") / 2) + 1).cast("int")).alias("usual"))
    allowed = F.col("usual") * F.lit(rules.SETTLEMENT_DEVIATION).cast("decimal(3,2)")
    settled = F.coalesce(
        F.col("short") & (F.col("usual") > 0)
        & ((F.col("tail_high") - F.col("usual") > allowed) | (F.col("usual") - F.col("tail_low") > allowed)), F.lit(False))
    told = told.withColumn("missing", F.sort_array(F.filter(
        F.array_except("tax", "fund"), lambda m: (m > F.col("fund_first")) & (m < F.col("fund_last")))))
    after = F.when(settled, "TRAILING_PAYOUT").otherwise("EXIT_TOO_EARLY")
    first, last = F.slice("seen", 1, 3), F.slice(F.reverse("seen"), 1, 3)
    # an outer explode, as a plain one is filtered by a second evaluation of its array
    cites = told.select(*PARTY, F.explode_outer(F.concat(
        F.when(F.col("no_exit"), F.transform(last, lambda x, i: seen_at("MISSING_EXIT", -i - 1, x))).otherwise(none),
        F.when(F.col("late_join"), F.transform(first, lambda x, i: seen_at("JOIN_SUSPECT", i + 1, x))).otherwise(none),
        F.when(~F.col("kept"), F.transform(first, lambda x, i: seen_at("ORPHAN_ACCOUNT", i + 1, x))).otherwise(none),
        F.when(F.size("tail") > 0, F.transform("tail", lambda x: seen_at(after, F.lit(0), x))).otherwise(none),
        F.when(F.size("missing") > 0, F.concat(
            F.transform(F.slice("missing", 1, rules.GAP_CITATIONS), lambda m, i: gap_at(i + 1, rules.TAX_SOURCE, m)),
            F.array(gap_at(F.lit(rules.GAP_CITATIONS + 1), rules.FUND_SOURCE, F.col("fund_first"), " (first)"),
                    gap_at(F.lit(rules.GAP_CITATIONS + 2), rules.FUND_SOURCE, F.col("fund_last"), " (last)"))
        )).otherwise(none),
    )).alias("c")).filter(F.col("c.kind").isNotNull()).select(*PARTY, "c.*")
    months_only = (F.col("kind") == "CONTRIBUTION_GAP") | F.col("source").isin(rules.MONTH_STAMPED_SOURCES)
    shown = F.when(months_only, F.substring(F.col("day").cast("string"), 1, 7)).otherwise(F.col("day").cast("string"))
    return cites.select(*PARTY, "kind", "cite_no", F.concat("source", F.lit("@"), shown, "tail").alias("citation"))
