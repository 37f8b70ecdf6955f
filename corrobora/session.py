"""Session building and lineage cutting."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="corrobora", master=None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session, whose executors are this machine, may do without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corrobora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder once and go on from there.

    A lost executor then costs a re-read, and later plans see a plain scan with
    column pruning and known sizes instead of everything that led here. Such tables stay until the folder is cleared, so
    they are packed closely.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/corrobora-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
