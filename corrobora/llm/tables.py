"""What the operators of this folder share: reading tables, packing rows, Arrow batches."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corrobora.llm.words import slices_of
from corrobora.session import cut_lineage

#: White space between words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
SLICE_ROWS = 512  # of an Arrow batch that are worked on at once
SLICE_BYTES = 1 << 22
TEXTS_OF_ID = 4   # different texts of one labelled id that a fit may use


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark only: the folder may be in a store that Python can't read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(text="text") -> Column:
    """The text of a row; a null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no column an operator adds can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, struct: str = "doc") -> DataFrame:
    return df.select(*[F.col(f"{struct}.`{f.name}`") for f in df.schema[struct].dataType.fields])


def labelled_rows(rows: DataFrame, few: DataFrame, label: str, shown: Column, most: int) -> DataFrame:
    """``rows`` of the labelled ids ``few`` (doc_id, label; bounded), with the label: one row per id, label and hash of
    ``shown``, at most ``TEXTS_OF_ID`` per id and label and ``most`` per label, by hash. The result is written.

    Ids and hashes are chosen before any text moves, so a labelled id in a large part of the rows is a few rows per task.
    """
    hashed = rows.withColumn("shown", F.xxhash64(shown))
    met = hashed.select("doc_id", "shown").join(F.broadcast(few), "doc_id").distinct()
    own = Window.partitionBy("doc_id", label).orderBy(F.xxhash64("shown"), "shown")
    every = Window.partitionBy(label).orderBy("place", F.xxhash64("doc_id", "shown"), "doc_id", "shown")
    chosen = cut_lineage(
        met.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= TEXTS_OF_ID)
        .withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= most).select("doc_id", "shown", label))
    found = hashed.join(F.broadcast(chosen), ["doc_id", "shown"])
    return cut_lineage(found.dropDuplicates(["doc_id", "shown", label]).drop("shown"))


def in_batches(df: DataFrame, work, schema: str, texts=None, most_bytes=SLICE_BYTES) -> DataFrame:
    """``work(batch) -> batch`` over slices of Arrow record batches, partition by partition.

    Slices share the batch's memory; what ``work`` makes of one goes out before the next one starts. A slice also ends
    after ``most_bytes`` of the column ``texts``, if that is given.
    """
    def run(batches):
        for batch in batches:
            if texts is None:
                slices = (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))
            else:
                slices = slices_of(batch, texts, 16 * SLICE_ROWS, most_bytes)
            for part in slices:
                yield work(part)
            pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)
