"""Documents to training tokens in five stages, each written as Parquet before the next one reads it.

1. toxicity: documents predicted toxic go.
2. near_duplicates: one document of each class of near copies stays.
3. secrets: credentials are replaced by marks.
4. mixing: sources are brought to their target weights; a document of a source short of words comes twice.
5. byte_bpe: the texts become token ids; the ids decode to the same bytes.

Each stage works on all rows its predecessor kept. Nulls, empty texts, repeated rows and empty tables are treated as the
operators say; an empty table runs through to an empty result.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora.llm import bytebpe, minhash, mixing, secrets, toxicity
from corrobora.llm.tables import table
from corrobora.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of a document is its source, the repository its source and language."""
    return secrets.redacted(docs, "source", F.concat_ws("/", "source", "lang"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian uint32), ids_sha256, decoded_sha256, round_trip."""
    told = bytebpe.encoded(docs, keep=("doc_id", "source"))
    return told.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       "decoded_sha256", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Compression distances, signatures and tokenizers are no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
