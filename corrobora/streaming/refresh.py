"""Findings kept up to date while evidence arrives."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora.contracts import CONTRACTS
from corrobora.operators.detectors import FINDING_COLUMNS, all_findings
from corrobora.operators.envelopes import PARTY, party_rows
from corrobora.session import cut_lineage

COMPACT_AFTER = 8  # deltas of a bucket
#: state is dealt by these: a busy member's bucket is written by several tasks, and equal rows meet in one
DEALT = ["bucket", "party_key", "source"]


def evidence_stream(spark: SparkSession, path: str) -> DataFrame:
    """New observation files as a stream, however late; each row keeps the file it came in."""
    return spark.readStream.schema(CONTRACTS["observations"]).parquet(path).withColumn(
        "file", F.col("_metadata.file_path"))


def row_copies(evidence: DataFrame) -> DataFrame:
    """The distinct rows of ``evidence`` and, as ``copies``, how often each counts.

    A row of one file that comes again in another counts once; equal rows inside one file all count. The counts of two
    parts of the evidence merge by their maximum, so they can be kept as state.
    """
    columns = [c for c in evidence.columns if c != "file"]
    # dealt once, so that neither count moves the rows again
    dealt = evidence.repartition(*DEALT) if set(DEALT) <= set(columns) else evidence
    in_file = dealt.groupBy("file", *columns).agg(F.count(F.lit(1)).alias("copies"))
    return in_file.groupBy(*columns).agg(F.max("copies").alias("copies"))


def merged_copies(parts: DataFrame) -> DataFrame:
    columns = [c for c in parts.columns if c != "copies"]
    return parts.groupBy(*columns).agg(F.max("copies").alias("copies"))


def repeated(counted: DataFrame) -> DataFrame:
    """Each row as often as it counts."""
    columns = [c for c in counted.columns if c != "copies"]
    return counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def without_repeats(evidence: DataFrame) -> DataFrame:
    """A row of one file that comes again in another counts once; equal rows inside one file all count."""
    return repeated(row_copies(evidence))


def bucket_state(spark: SparkSession, store: str, batch_id: int, buckets: list[int]) -> tuple[DataFrame, list[int]]:
    """(state rows of ``buckets`` as of a batch, unmerged; the buckets whose parts should be put together).

    Of each bucket only its last base and the deltas behind it are read.
    """
    index = spark.read.parquet(f"{store}/index").filter(
        (F.col("batch") < batch_id) & F.col("bucket").isin(buckets))
    based = index.groupBy("bucket").agg(F.max(F.when(F.col("compacted"), F.col("batch"))).alias("base"))
    late = index.join(based, "bucket").filter(F.col("base").isNull() | (F.col("batch") > F.col("base")))
    told = {r.bucket: r.base for r in based.collect()}  # a row for each bucket at most
    waiting = {r.bucket: r["count"] for r in late.groupBy("bucket").count().collect()}
    wanted = F.lit(False)
    for bucket in buckets:
        base = told.get(bucket)
        part = (F.col("kind") == "delta") & (F.col("batch") <= batch_id)
        if base is not None:
            part = part & (F.col("batch") > base) | (F.col("kind") == "base") & (F.col("batch") == base)
        wanted = wanted | (F.col("bucket") == bucket) & part
    rows = spark.read.parquet(f"{store}/evidence").filter(wanted).drop("batch", "kind")
    return rows, [b for b in buckets if waiting.get(b, 0) + 1 >= COMPACT_AFTER]


def touched_rows(state: DataFrame, touched: DataFrame, asserted: DataFrame) -> DataFrame:
    """``party_rows`` of the members in ``touched``, from unmerged ``state``.

    State rows cross the network once, to their party, where they are matched with the parties of these members, merged
    and reduced to days.
    """
    record = asserted.join(touched, "member_key", "left_semi")
    named = state.filter(F.col("party_key").isNotNull())
    parties = cut_lineage(named.select(*PARTY).distinct().join(touched, "member_key", "left_semi"))
    told = party_rows(named.join(parties, PARTY, "left_semi"), record, merged_copies)
    unnamed = state.filter(F.col("party_key").isNull())
    if unnamed.isEmpty():
        return told
    # a row without a party can be matched by its member alone and meets no record
    return told.unionByName(party_rows(
        unnamed.join(touched, "member_key", "left_semi"), record.filter(F.lit(False)), merged_copies))


def refresh_findings_stream(stream: DataFrame, store: str, asserted: DataFrame, as_of, checkpoint: str,
                            buckets=64):
    """Recompute the findings of the members each batch touches, and nobody else's.

    ``store`` keeps the evidence as mergeable state: distinct rows with the number of times each counts, by bucket of
    member. A batch adds a delta to the buckets it touches and reads back those buckets only, their base and the deltas
    since; after ``COMPACT_AFTER`` deltas a bucket gets a new base, so neither the rows read nor the number of files
    grow with the number of batches. Older parts may be removed by the folder's retention. Each table has a folder per
    batch, so a batch that is run again overwrites its own files and reads nothing it wrote before. ``current_findings``
    reads of each member what its latest batch found, which may be nothing. ``buckets`` should grow with the population.
    The record (``asserted``) is the one given when the stream starts.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64("member_key"), F.lit(buckets)).cast("int")
    spark.range(1).selectExpr("-1 bucket", "false compacted").write.mode("ignore").parquet(f"{store}/index/batch=-1")

    def refresh(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        place = f"{store}/evidence/batch={batch_id}"
        (row_copies(batch.withColumn("bucket", bucket))
         .write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{place}/kind=delta"))
        fresh = spark.read.parquet(f"{place}/kind=delta")
        fresh.select("member_key").distinct().write.mode("overwrite").parquet(f"{store}/members/batch={batch_id}")
        touched = spark.read.parquet(f"{store}/members/batch={batch_id}")
        # bucket numbers only, at most as many as there are buckets
        changed = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
        state, due = bucket_state(spark, store, batch_id, changed)
        if due:
            (merged_copies(state.filter(F.col("bucket").isin(due)).repartition(*DEALT))
             .write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{place}/kind=base"))
        state = state.drop("bucket")
        # the rows of parties hold all but a few answers, for which observations are put together again
        evidence = repeated(merged_copies(state.join(touched, "member_key", "left_semi")))
        (all_findings(evidence, asserted, as_of, parties=touched_rows(state, touched, asserted))
         .write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/findings/batch={batch_id}"))
        (spark.createDataFrame([(b, b in due) for b in changed], "bucket int, compacted boolean").coalesce(1)
         .write.mode("overwrite").parquet(f"{store}/index/batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_findings(spark: SparkSession, store: str) -> DataFrame:
    """The findings of every member as of the latest batch that touched it.

    All findings of the last batch are current; of those before, members that no later batch touched are looked up.
    """
    members, findings = spark.read.parquet(f"{store}/members"), spark.read.parquet(f"{store}/findings")
    last = members.agg(F.max("batch")).first()[0]
    earlier = cut_lineage(
        members.groupBy("member_key").agg(F.max("batch").alias("batch")).filter(F.col("batch") < last))
    return findings.filter(F.col("batch") == last).unionByName(
        findings.filter(F.col("batch") < last).join(earlier, ["member_key", "batch"], "left_semi")
    ).select(*FINDING_COLUMNS)
