"""Mixing sources to target weights with hash-threshold histograms.

Every document has a point in [0, 2^60) that depends on its id only. A source takes each of its documents
``whole`` times and those with a point up to its threshold once more. The threshold comes from nested histograms:
tokens are summed by source and the leading bits of the point, the bucket in which the budget runs out is found from
the running sums, and only that bucket is divided again. No documents are sorted, and the work on one source,
however large, is a map-side sum followed by at most one row per bucket.

Null and empty cases: a null text has size 0; a null source is a source of its own and comes last; documents with a
null id take their point from the text. Rows with the same id share their point, so they come or stay away together;
in a tie the whole group counts as one step of the running sum. A source whose documents are all empty has target 0.
An empty table gives an empty result. Other columns of the input play no part and may have any name.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.tables import SPACE, packed, unpacked, whole_text
from corrobora.session import cut_lineage

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5          # of all words together
MOST = 2             # times a document is taken at most
BITS = 60            # of a point
STEP = 12            # bits that one histogram resolves
LEVELS = 2           # histograms before the last bucket is resolved by single points


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def point_of(doc_id="doc_id", text="text") -> Column:
    """The leading 60 bits of the MD5 of the id."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target, whole, rest) from rows (source, n): one row per source and bucket or fewer.

    Sources are in order of code points, null last. Filled up like vessels: in order of size over weight, a source is
    full if its share of what the fuller ones leave is above ``most`` times its size; the rest share by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("n").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onwards = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    full = F.lit(float(most)) * F.col("source_size")
    left = F.col("budget") - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    capped = (
        weighed.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("is_full", full * F.sum("weight").over(onwards) < F.col("weight") * left)
    )
    remaining = F.col("budget") - F.sum(F.when(F.col("is_full"), full).otherwise(F.lit(0.0))).over(everything)
    open_weight = F.sum(F.when(F.col("is_full"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("is_full"), full).otherwise(F.least(full, remaining * F.col("weight") / open_weight))
    return (
        capped.select("source", "source_size", target.alias("target"))
        .withColumn("whole", F.when(F.col("source_size") > 0,
                                    F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
                    .otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def mixing_plan(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target, whole, threshold) from rows (source, size, point)."""
    shift = BITS - STEP
    bucket = F.shiftright("point", shift)
    counts = cut_lineage(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")))
    targets = cut_lineage(source_targets(counts, weights, share, most))
    # what is still undecided of each source: the range of points of one bucket, and the words wanted from it
    undecided = targets.select("source", F.lit(0).cast("long").alias("bucket_before"), "rest")
    for level in range(LEVELS):
        if level:
            shift -= STEP
            bucket = F.shiftright("point", shift)
            inside = sized.join(undecided, (sized["source"].eqNullSafe(undecided["source"]))
                                & (F.shiftright("point", shift + STEP) == F.col("bucket_before")))
            counts = inside.groupBy(sized["source"], bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        undecided = cut_lineage(boundary(counts, undecided))
    inside = sized.join(undecided, (sized["source"].eqNullSafe(undecided["source"]))
                        & (F.shiftright("point", shift) == F.col("bucket_before")))
    points = inside.groupBy(sized["source"], "point", "rest").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("source").orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    nearer = F.coalesce(F.sum("n").over(running), F.lit(0)) + F.col("n") / 2 <= F.col("rest")
    last = points.withColumn("nearer", nearer).filter("nearer").groupBy("source").agg(F.max("point").alias("last"))
    named = undecided.select(F.col("source").alias("s"), F.shiftleft("bucket_before", shift).alias("start"))
    cuts = named.join(last, named["s"].eqNullSafe(last["source"]), "left").select(
        "s", F.coalesce("last", F.col("start") - 1).alias("threshold"))
    return targets.join(cuts, targets["source"].eqNullSafe(cuts["s"]), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold"))


def boundary(counts: DataFrame, undecided: DataFrame) -> DataFrame:
    """The bucket of each source in which the wanted words run out, and what is wanted from inside it."""
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    told = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    wanted = undecided.select(F.col("source").alias("s"), "rest")
    return (
        told.join(wanted, told["source"].eqNullSafe(wanted["s"]))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        .select("source", F.col("bucket").alias("bucket_before"), (F.col("rest") - F.col("before")).alias("rest"))
    )


def source_plan(sized: DataFrame, weights, share, most) -> DataFrame:
    """The plan as a written table, one row a source: Spark then knows its size, and documents stay where they are if
    that is small enough to be sent to them."""
    return cut_lineage(mixing_plan(sized, weights, share, most)).withColumnRenamed("source", "s")


def times_taken() -> Column:
    return F.col("whole") + (F.col("point") <= F.col("threshold")).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in(whole_text()).alias("size"), point_of().alias("point"))


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken (words, repeats counted)."""
    sized = cut_lineage(sized_rows(docs))
    plan = source_plan(sized, weights, share, most)
    return (
        sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
        .withColumn("times", times_taken())
        .select("doc_id", "source", "size", "source_size", "target", "times",
                (F.col("times") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their own columns only."""
    plan = source_plan(cut_lineage(sized_rows(docs).drop("doc_id")), weights, share, most)
    rows = docs.select(packed(docs).alias("doc"), F.col("source").alias("source"), point_of().alias("point"))
    chosen = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).filter(times_taken() > 0)
    return unpacked(chosen.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), times_taken()))))


def sql(weights=WEIGHTS, share=SHARE, most=MOST, docs="documents") -> str:
    """The same in one statement that sorts: for comparison."""
    weigh = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(weights))
    return f"""
WITH mix_sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || text, '')), 1, {BITS // 4}))::BIGINT AS point
  FROM {docs}),
mix_sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weigh} END AS weight
  FROM mix_sized GROUP BY source),
mix_filling AS (
  SELECT *, {share} * sum(source_size) OVER () AS budget,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    coalesce(sum({most}.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled
  FROM mix_sources),
mix_full AS (
  SELECT *, {most}.0 * source_size * open_weight < weight * (budget - filled) AS is_full FROM mix_filling),
mix_targets AS (
  SELECT source, source_size,
    (CASE WHEN is_full THEN {most}.0 * source_size ELSE least({most}.0 * source_size,
      (budget::DOUBLE - sum(CASE WHEN is_full THEN {most}.0 * source_size ELSE 0 END) OVER ()::DOUBLE) * weight::DOUBLE
      / sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER ()::DOUBLE) END)::DOUBLE AS target
  FROM mix_full),
mix_whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {most})::BIGINT ELSE 0 END AS whole
  FROM mix_targets),
mix_points AS (
  SELECT source, point, sum(size) AS n FROM mix_sized GROUP BY source, point),
mix_running AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY point
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mix_points),
mix_cuts AS (
  SELECT w.source, max(r.point) FILTER (WHERE r.before + r.n / 2.0 <= w.target - w.whole * w.source_size) AS cut
  FROM mix_whole w JOIN mix_running r ON w.source IS NOT DISTINCT FROM r.source GROUP BY w.source),
mix_times AS (
  SELECT d.*, w.source_size, w.target, w.whole + (d.point <= coalesce(c.cut, -1))::BIGINT AS times
  FROM mix_sized d JOIN mix_whole w ON d.source IS NOT DISTINCT FROM w.source
  JOIN mix_cuts c ON d.source IS NOT DISTINCT FROM c.source)"""
