"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("legajo")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a private one only in local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, which cuts the lineage."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """As ``stored``, in buckets of the keys: joins and groupings that name them need no exchange.

    There are as many buckets as shuffle partitions, so rows that already lie by the keys are
    written where they are.  The catalog knows the table only until it is opened.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    table = f"stored_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartition(buckets, *keys)
    laid.write.bucketBy(buckets, *keys).option("path", folder).format("parquet").saveAsTable(table)
    opened = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # a table with a path of its own keeps its files
    return opened


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins run inside keep rows where they lie if both sides lie by some of the join's keys.

    Without it Spark deals both sides anew by all keys.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
