"""Ordered computations that keep a hot key off a single task.

A plain window over ``keys`` sends every row of one key to one task. The
functions here split each key into order-preserving buckets first, do the row
work per bucket, and carry only one summary row per bucket across the key.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.session import cut_lineage

# rows per bucket, about: rows of one bucket fit a task, and so do the buckets of one key
BUCKET_ROWS = 1 << 20
# sampled rows per bucket: sizes of buckets stay within about a factor of two
SAMPLES = 32


def position_in_group(df: DataFrame, keys, bucket: Column, order, name="position") -> DataFrame:
    """row_number over ``keys`` ordered by (bucket, order), counted bucket by bucket."""
    rows = df.withColumn("_bucket", bucket)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_before", "_inside")
    )


def order_buckets(df: DataFrame, keys, order, name="_span", rows_per_bucket=BUCKET_ROWS) -> DataFrame:
    """Adds ``name``, a bucket number that never falls along ``order`` within ``keys``; about ``rows_per_bucket`` rows each.

    Rows are sampled by a hash of the order itself, one in ``rows_per_bucket / SAMPLES`` of every key alike, so no count
    is needed first, reruns agree, and a small key has no or few splitters. A key of n rows collects
    ``SAMPLES * n / rows_per_bucket`` sampled orders. Rows of equal order can't be parted: ``order`` should nearly tell
    the rows of a key apart. Nulls come first, as in a sort.
    """
    splitters = _splitters(df, keys, order, rows_per_bucket)
    return _in_buckets(df.join(splitters, list(keys), "left"), order, name).drop("_splitters")


def _splitters(df, keys, order, rows_per_bucket) -> DataFrame:
    sampled = df.select(*keys, F.struct(*order).alias("_place"), F.xxhash64(*keys, *order).alias("_hash")).filter(
        F.pmod("_hash", F.lit(max(1, rows_per_bucket // SAMPLES))) == 0)
    return sampled.groupBy(*keys).agg(F.filter(
        F.sort_array(F.collect_set("_place")), lambda _, k: (k + 1) % SAMPLES == 0).alias("_splitters"))


def _in_buckets(df, order, name) -> DataFrame:
    passed = F.filter("_splitters", lambda splitter: splitter < F.struct(*order))
    return df.withColumn(name, F.when(F.col("_splitters").isNull(), 0).otherwise(F.size(passed)))


def position_in_order(df: DataFrame, keys, order, name="position", rows_per_bucket=BUCKET_ROWS, totals=None) -> DataFrame:
    """row_number over ``keys`` in the whole ``order``, in buckets cut at sampled quantiles.

    Only keys with splitters have more than one bucket. Their splitters and the counts of their buckets are written, a
    few rows that Spark knows to be few, so the rows themselves cross the network once, for the numbering. ``totals`` (name
    -> condition) adds to every row how many rows of its key meet a condition, in the same pass.
    """
    totals = totals or {}
    splitters = cut_lineage(_splitters(df, keys, order, rows_per_bucket).filter(F.size("_splitters") > 0))
    if splitters.isEmpty():
        whole = Window.partitionBy(*keys)
        return df.select(
            "*", F.row_number().over(whole.orderBy(*order)).cast("bigint").alias(name),
            *[F.count_if(condition).over(whole).alias(total) for total, condition in totals.items()])
    rows = _in_buckets(df.join(splitters, list(keys), "left"), order, "_span")
    across = Window.partitionBy(*keys)
    before = across.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        rows.filter(F.col("_splitters").isNotNull()).groupBy(*keys, "_span").agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(condition).alias(f"_{total}") for total, condition in totals.items()])
        .select(*keys, "_span", F.sum("_n").over(before).alias("_before"),
                *[F.sum(f"_{total}").over(across).alias(f"_{total}") for total in totals]))
    inside = Window.partitionBy(*keys, "_span")
    numbered = rows.drop("_splitters").select(
        "*", F.row_number().over(inside.orderBy(*order)).alias("_inside"),
        *[F.count_if(condition).over(inside).alias(total) for total, condition in totals.items()])
    numbered = numbered.join(offsets, [*keys, "_span"], "left").withColumn(
        name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
    return numbered.withColumns({total: F.coalesce(f"_{total}", total) for total in totals}).drop(
        "_span", "_before", "_inside", *[f"_{total}" for total in totals])


def busy_keys(df: DataFrame, keys, place, rows=BUCKET_ROWS) -> DataFrame | None:
    """Keys with about ``rows`` rows or more, as a written table of a few rows; None if there are none.

    One row in ``rows / SAMPLES`` is taken by a hash of keys and ``place``, which should nearly tell the rows of a key apart.
    """
    sampled = df.filter(F.pmod(F.xxhash64(*keys, *place), F.lit(max(1, rows // SAMPLES))) == 0)
    busy = cut_lineage(
        sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= SAMPLES).select(*keys).dropna())
    return None if busy.isEmpty() else busy


def following_row(df: DataFrame, keys, bucket: Column, order, payload: Column, name) -> DataFrame:
    """lead(payload) over ``keys`` ordered by (bucket, order), bucket by bucket.

    The last row of a bucket takes the first row of the next non-empty bucket.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_payload", payload)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    heads = rows.groupBy(*keys, "_bucket").agg(
        F.min_by("_payload", F.struct(*order)).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    links = heads.select(*keys, "_bucket", F.lead("_head").over(across).alias("_next_head"))
    return (
        rows.withColumn("_next", F.lead("_payload").over(inside))
        .join(links, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_next", "_next_head"))
        .drop("_bucket", "_payload", "_next", "_next_head")
    )


def best_before(df: DataFrame, keys, bucket: Column, order, payload: Column, name) -> DataFrame:
    """max(payload) over the rows of ``keys`` before this one in the order of (bucket, order), bucket by bucket.

    One row per bucket, its maximum, crosses the key.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_payload", payload)
    earlier = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_bucket").agg(F.max("_payload").alias("_top"))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_bucket", F.max("_top").over(across).alias("_carried"))
    return (
        rows.withColumn("_own", F.max("_payload").over(earlier))
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn(name, F.greatest("_own", "_carried"))
        .drop("_bucket", "_payload", "_own", "_carried")
    )


def upper_median(df: DataFrame, keys, value, name="median") -> DataFrame:
    """Element ``n div 2`` (0-based) of the sorted values of each key, exactly.

    Equal values are counted first, then the bucket holding the wanted rank is
    found from bucket counts, and only that bucket is put in order. No task
    holds more than one bucket of one key, or one count per bucket.
    """
    cells = (
        df.groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_value") / 1000))
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    buckets = (
        cells.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
        .withColumn("_upto", F.sum("_in_bucket").over(
            across.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.floor(F.sum("_in_bucket").over(whole) / 2))
        .filter((F.col("_upto") > F.col("_rank"))
                & (F.col("_upto") - F.col("_in_bucket") <= F.col("_rank")))
        .select(*keys, "_bucket",
                (F.col("_rank") - (F.col("_upto") - F.col("_in_bucket"))).alias("_rank"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value")
    return (
        cells.join(buckets, [*keys, "_bucket"])
        .withColumn("_upto", F.sum("_n").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_upto") > F.col("_rank"))
                & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
        .select(*keys, F.col("_value").alias(name))
    )


def totals_as_of(events: DataFrame, asks: DataFrame, keys, day, counters) -> DataFrame:
    """For every distinct (keys, day) asked: sums of ``counters`` over events up to that day.

    Events and asks are reduced to one row per key and day before the running
    sum, so one key holds at most as many rows as the calendar has days, and no
    event is ever paired with an ask.
    """
    rows = events.select(*keys, day, *counters, F.lit(None).cast("boolean").alias("_asked")).unionByName(
        asks.select(*keys, day, F.lit(True).alias("_asked")), allowMissingColumns=True)
    timeline = rows.groupBy(*keys, day).agg(*[F.sum(c).alias(c) for c in counters], F.max("_asked").alias("_asked"))
    upto = (
        Window.partitionBy(*keys).orderBy(day)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        timeline.select(
            *keys, day, "_asked",
            *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in counters])
        .filter(F.col("_asked"))
        .drop("_asked")
    )
