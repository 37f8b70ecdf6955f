"""The queries of this folder beside their SQL."""

from pyspark.sql import functions as F

from corrobora.llm import (
    bytebpe, collocations, lexical, minhash, mixing, pii, quality, rabitq, secrets, tokencounts, tokenfiles, topk, toxicity)
from corrobora.llm.tables import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, folder) -> DataFrame`` and, if it has one, its SQL counterpart."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_secret_scans")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    docs = docs.withColumn("repository", F.concat_ws("/", "source", "lang"))
    return secrets.digest(secrets.secret_spans(docs, "source", "repository"))


@query("op2_minhash_near_dedup")
def op2(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_token_files")
def op3(spark, folder):
    files = tokenfiles.new_folder(spark)
    tokenfiles.write_token_files(table(spark, folder, "documents"), files)
    return tokenfiles.token_places(tokenfiles.read_token_files(spark, files))


@query("op4_token_counts")
def op4(spark, folder):
    return tokencounts.token_counts(table(spark, folder, "documents"))


@query("op5_quality_cotraining")
def op5(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_source_mixing", mixing.sql() + """
SELECT doc_id, size, source_size, target, times * size AS taken FROM mix_times""")
def op6(spark, folder):
    return mixing.mixed_sizes(table(spark, folder, "documents")).drop("source", "times")


@query("op7_exact_top_k", topk.SQL)
def op7(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_toxicity")
def op8(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_embedding_near_dedup", rabitq.SQL)
def op9(spark, folder):
    return rabitq.near_vectors(table(spark, folder, "embeddings"))


@query("op10_byte_bpe")
def op10(spark, folder):
    return bytebpe.encoded(table(spark, folder, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256", "round_trip")


@query("op13_pii_boosting")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    return pii.digest(pii.personal_spans(docs, pii.trained(docs)))


@query("op11_lexical_search", lexical.sql())
def op11(spark, folder):
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_collocations", collocations.sql())
def op12(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
