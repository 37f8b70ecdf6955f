"""Evidence shape: envelopes, runs, citations and timelines.

``evidence_days`` is the base of everything here. It reduces observations with
a map-side aggregate to one row per member, party, source and day, so that
later per-party work is bounded by the calendar however many rows a party has.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora import rules
from corrobora.functions.dates import month_from_no, month_no, stamp
from corrobora.operators.spread import busy_keys

PARTY = ["member_key", "party_key"]


def evidence_days(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*PARTY, "source", "obs_date").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("ord").alias("first_ord"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def party_rows(observations: DataFrame, asserted: DataFrame, merged=None) -> DataFrame:
    """One row per party: its days of evidence and its records, as lists (``days``, ``records``; null if there are none).

    ``days`` is what ``evidence_days`` has of the party, in order, with the last ``ord``, the number of amounts and whether
    every observation of the day has a place (``placed``), so a row is bounded by the calendar. A last ``ord`` or greatest
    amount is null if it is the first or least as well, as it nearly always is (``last_of``). Observations cross the
    network once, to their party. Only parties with very many are reduced to days before they do, as no task should read
    them all; they are found in a sample. ``merged`` is done to the rows of a party when they are together and may give
    each the number of times it counts (``copies``).
    """
    if merged is None:
        observations = observations.select(*PARTY, "source", "obs_date", "ord", "amount")
    busy = busy_keys(observations, PARTY, ["source", "obs_date", "ord"])

    def day_facts(rows):
        return _day_facts(rows if merged is None else merged(rows))
    if busy is None:
        return with_records(_in_rows(day_facts(observations.repartition(*PARTY))), asserted)
    rest = day_facts(observations.join(busy, PARTY, "left_anti").repartition(*PARTY))
    reduced = day_facts(observations.join(busy, PARTY, "left_semi")).repartition(*PARTY)
    return with_records(_in_rows(rest).unionByName(_in_rows(reduced)), asserted)


def with_records(parties: DataFrame, asserted: DataFrame) -> DataFrame:
    """``party_rows`` with the records of another table in place."""
    records = asserted.groupBy(*PARTY).agg(F.collect_list(F.struct("ord", "account_id", "doj", "doe")).alias("records"))
    return parties.select(*PARTY, "days").join(records, PARTY, "full")


def _day_facts(observations):
    copies = F.col("copies") if "copies" in observations.columns else F.lit(1).cast("bigint")

    def number(column):
        return F.sum(F.when(F.col(column).isNotNull(), copies).otherwise(0))
    return observations.groupBy(*PARTY, "source", "obs_date").agg(
        F.sum(copies).alias("n_obs"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        number("amount").alias("n_amounts"), number("ord").alias("n_ord"))


def _in_rows(days):
    def other(last, first):
        return F.when(F.col(last) != F.col(first), F.col(last)).alias(last)
    return days.groupBy(*PARTY).agg(F.sort_array(F.collect_list(F.struct(
        "obs_date", "source", "n_obs", "first_ord", other("last_ord", "first_ord"), "min_amount",
        other("max_amount", "min_amount"), "n_amounts", (F.col("n_ord") == F.col("n_obs")).alias("placed")))).alias("days"))


def last_of(day, last, first):
    """The last ``ord`` or greatest amount of an element of ``days``."""
    return F.coalesce(day[last], day[first])


def days_in(parties: DataFrame) -> DataFrame:
    """``evidence_days`` back from ``party_rows``; nothing is moved."""
    return parties.filter(F.col("days").isNotNull()).select(*PARTY, F.explode_outer("days").alias("d")).select(
        *PARTY, "d.source", "d.obs_date", "d.n_obs", "d.first_ord", "d.min_amount",
        last_of(F.col("d"), "max_amount", "min_amount").alias("max_amount"))


def sources_in(parties: DataFrame) -> DataFrame:
    """The sources of each party of ``party_rows`` with any evidence."""
    return parties.filter(F.col("days").isNotNull()).select(
        *PARTY, F.array_distinct(F.transform("days", lambda d: d["source"])).alias("sources"))


def party_windows(parties: DataFrame, asserted_source=rules.ASSERTED_SOURCE) -> DataFrame:
    """A4 of ``party_rows``; nothing is moved."""
    days = F.col("days") if asserted_source is None else F.filter("days", lambda d: d["source"] != asserted_source)
    seen = parties.select(*PARTY, days.alias("seen")).filter(F.size("seen") > 0)

    def of(column):
        return F.transform("seen", lambda d: d[column])
    return seen.select(
        *PARTY, F.array_min(of("obs_date")).alias("earliest"), F.array_max(of("obs_date")).alias("latest"),
        F.array_sort(F.array_compact(F.array_distinct(of("source")))).alias("sources"),
        F.aggregate(of("n_obs"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_obs"),
        F.array_min(of("first_ord")).alias("first_ord"),
    ).withColumn("n_sources", F.size("sources"))


def support_windows(days: DataFrame, asserted_source=rules.ASSERTED_SOURCE) -> DataFrame:
    """A4: envelope of the independent evidence per member and party."""
    independent = days if asserted_source is None else days.filter(
        F.col("source") != asserted_source)
    return independent.groupBy(*PARTY).agg(
        F.min("obs_date").alias("earliest"),
        F.max("obs_date").alias("latest"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum("n_obs").alias("n_obs"),
        F.min("first_ord").alias("first_ord"),
    ).withColumn("n_sources", F.size("sources"))


def confidence(sources: Column) -> Column:
    """Chance that not all of these sources are wrong about presence."""
    misses = [
        F.when(F.array_contains(sources, name), F.lit(1.0 - presence)).otherwise(F.lit(1.0))
        for name, presence in rules.PRESENCE.items() if name != rules.ASSERTED_SOURCE
    ]
    return F.round(F.lit(1.0) - reduce(lambda a, b: a * b, misses), 4)


def evidence_confidence(windows: DataFrame) -> DataFrame:
    """A5: corroboration over distinct sources, not volume within one."""
    return windows.select(*PARTY, "n_sources", confidence(F.col("sources")).alias("confidence"))


def confidence_word(n_sources) -> Column:
    """P8."""
    n = F.col(n_sources) if isinstance(n_sources, str) else n_sources
    return F.when(n >= 3, "High").when(n == 2, "Medium").otherwise("Low")


def runs(df: DataFrame, keys, unit: Column) -> DataFrame:
    """Gaps and islands over an integer calendar unit: first, last and size of each run."""
    distinct_units = df.select(*keys, unit.alias("unit")).distinct()
    island = F.col("unit") - F.row_number().over(Window.partitionBy(*keys).orderBy("unit"))
    return (
        distinct_units.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"),
             F.count(F.lit(1)).alias("n_units"))
        .drop("_island")
    )


def month_runs(days: DataFrame, keys=(*PARTY, "source"), day="obs_date") -> DataFrame:
    """Contiguous months; a run ends on the last day of its last month."""
    return runs(days, keys, month_no(day)).select(
        *keys,
        month_from_no("first_unit").alias("run_start"),
        F.last_day(month_from_no("last_unit")).alias("run_end"),
        F.col("n_units").alias("n_months"),
    )


def day_runs(df: DataFrame, keys, day) -> DataFrame:
    """W2 with the day as the unit."""
    return runs(df, keys, F.unix_date(day)).select(
        *keys,
        F.date_from_unix_date(F.col("first_unit").cast("int")).alias("run_start"),
        F.date_from_unix_date(F.col("last_unit").cast("int")).alias("run_end"),
        F.col("n_units").alias("n_days"),
    )


def citation() -> Column:
    shown = F.when(
        F.col("source").isin(rules.MONTH_STAMPED_SOURCES), F.date_format("obs_date", "yyyy-MM")
    ).otherwise(F.date_format("obs_date", "yyyy-MM-dd"))
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "",
                  F.concat(F.lit(" ("), F.col("note"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.col("source"), F.lit("@"), shown, note)


def _cited(observations, n, ordering, direction):
    ranked = observations.filter(F.col("source") != rules.ASSERTED_SOURCE).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*PARTY).orderBy(*ordering)))
    # the rank filter is pushed below the shuffle, so a hot party sends n rows per task
    return ranked.filter(F.col("_rank") <= n).select(
        *PARTY,
        (F.col("_rank") if direction > 0 else -F.col("_rank")).alias("cite_no"),
        "obs_date",
        stamp("obs_date", "source", rules.MONTH_STAMPED_SOURCES).alias("stamp"),
        citation().alias("citation"),
    )


def cite_first(observations: DataFrame, n=3) -> DataFrame:
    """The n earliest observations of each party, numbered 1.."""
    return _cited(observations, n, [F.asc("obs_date"), F.asc("ord"), F.asc("source"), F.asc("note")], 1)


def cite_last(observations: DataFrame, n=3) -> DataFrame:
    """The n latest observations of each party, numbered ..-1."""
    return _cited(observations, n, [F.desc("obs_date"), F.desc("ord"), F.desc("source"), F.desc("note")], -1)


def timeline_segments(days: DataFrame, asserted: DataFrame, as_of) -> DataFrame:
    """One track per source plus the asserted track, on a whole-year axis per party."""
    record = latest_record(asserted).select(*PARTY, "doj", "doe")
    tracks = (
        month_runs(days.filter(F.col("source").isin(rules.TRACKS)))
        .join(record, PARTY, "left")
        .select(*PARTY, "source", "run_start", "run_end",
                F.coalesce(F.col("run_end") > F.col("doe"), F.lit(False)).alias("after_exit"))
    )
    seen = days.select(*PARTY).distinct()
    asserted_track = record.join(seen, PARTY, "left_semi").select(
        *PARTY, F.lit("ASSERTED").alias("source"), F.col("doj").alias("run_start"),
        F.coalesce("doe", F.lit(as_of)).alias("run_end"), F.lit(False).alias("after_exit"))
    axis = (
        days.groupBy(*PARTY).agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))
        .join(record, PARTY, "left")
        .select(*PARTY,
                F.trunc(F.least("lo", "doj"), "YEAR").alias("axis_start"),
                F.make_date(F.year(F.greatest("hi", "doe")), F.lit(12), F.lit(31)).alias("axis_end"))
    )
    return tracks.unionByName(asserted_track).join(axis, PARTY)


def latest_record(asserted: DataFrame) -> DataFrame:
    """One record per member and party: the last one given, at the position of the first."""
    return asserted.groupBy(*PARTY).agg(
        F.max_by(F.struct("account_id", "doj", "doe"), F.struct("ord", "account_id", "doj", "doe")).alias("_last"),
        F.min("ord").alias("ord"),
    ).select(*PARTY, "_last.account_id", "_last.doj", "_last.doe", "ord")


def reconstruct(days: DataFrame, asserted: DataFrame, checked: DataFrame) -> DataFrame:
    """What the record should say per party, from the evidence.

    ``checked`` holds one row per member whose record could be tested at all.
    """
    windows = support_windows(days, asserted_source=None)
    joined = (
        windows.join(latest_record(asserted).withColumn("_known", F.lit(True)), PARTY, "left")
        .join(checked.select("member_key").distinct().withColumn("_checked", F.lit(True)),
              "member_key", "left")
    )
    verdict = (
        F.when(F.col("_known").isNull() & F.col("_checked").isNotNull(), "unlinked")
        .when(F.col("_known").isNull(), "unchecked")
        .when(F.col("doe").isNull(), "exit_missing")
        .when(F.col("doe") < F.col("latest"), "exit_wrong")
        .when(F.col("doj") > F.col("earliest"), "join_wrong")
        .otherwise("agrees")
    )
    return joined.withColumn("verdict", verdict).select(
        *PARTY, "account_id",
        F.col("doj").alias("asserted_doj"), F.col("doe").alias("asserted_doe"),
        F.col("earliest").alias("first_seen"), F.col("latest").alias("last_seen"),
        F.when(F.col("verdict") != "agrees", F.last_day("latest")).alias("exit_best"),
        "sources", "n_sources", confidence_word("n_sources").alias("confidence"), "verdict",
    )


def self_exit_window(reconstructed: DataFrame, as_of) -> DataFrame:
    """When a member may mark an open exit without help."""
    waited = month_no(F.lit(as_of)) - month_no("last_seen")
    opens = month_from_no(month_no("last_seen") + rules.SELF_EXIT_WAIT_MONTHS)
    ready = waited >= rules.SELF_EXIT_WAIT_MONTHS
    return reconstructed.filter(F.col("verdict") == "exit_missing").select(
        *PARTY, "last_seen", "exit_best", "confidence",
        ready.alias("ready"), F.when(~ready, opens).alias("wait_until"))
