"""Streaming forms over the driver tables, drained once into a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators.registry import content_hash
from legajo.plans.bindings import table
from legajo.plans.catalog import TWINS, register
from legajo.plans.progress_queries import progress_events
from legajo.session import shared_folder
from legajo.streaming import intake
from legajo.streaming import progress as live


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # a pattern, as a stream takes a plain path for that of a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register("streamed_progress_report", "K1 K2 K3 K4 A15 A16", TWINS["progress_report"])
def streamed_progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress report from the stateful stream, equal to the batch form."""
    folder = shared_folder(spark, "stream")
    report = live.stream_report(progress_events(table_stream(spark, sf_dir, "events")))
    live.write_log(report, f"{folder}/log", f"{folder}/state", every=None).awaitTermination()
    return spark.read.schema(live.REPORT).json(f"{folder}/log")


@register(
    "streamed_registrations",
    "K5 C2",
    """SELECT source AS case_id, sha256(text) AS file_hash, min(doc_id) AS document_id FROM documents GROUP BY 1, 2""",
)
def streamed_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents registered as they stream in, once per case and content."""
    folder = shared_folder(spark, "stream")
    arrivals = table_stream(spark, sf_dir, "documents").select(
        F.col("source").alias("case_id"),
        content_hash("text").alias("file_hash"),
        F.col("doc_id").alias("document_id"),
    )
    intake.register_stream(arrivals, f"{folder}/store", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/store")


@register(
    "streamed_file_registrations",
    "K5 C1 C2 A1",
    """SELECT DISTINCT concat('case=', s_nationkey) AS case_id,
  sha256(concat('rating ', CAST(floor(s_acctbal / 1000) AS BIGINT), chr(10))) AS file_hash FROM supplier""",
)
def streamed_file_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found as they appear, several to a micro-batch, registered once per case and content."""
    folder = shared_folder(spark, "stream")
    notes = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("case"),
        F.concat(F.lit("rating "), F.floor(F.col("s_acctbal") / 1000)).alias("value"),
    )
    tasks = max(8, notes.count() // 500)  # a fixed number, as small rows would all be put in one
    (
        notes.repartition(tasks)
        .write.option("maxRecordsPerFile", 1)
        # tasks put their files in place themselves; names are the same if one runs again
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy("case")
        .text(f"{folder}/uploads")
    )
    arrivals = intake.arriving_files(spark, f"{folder}/uploads", "upload", files_per_trigger=10_000)
    intake.register_stream(arrivals, f"{folder}/store", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/store").select("case_id", "file_hash")


@register(
    "streamed_expiring_keys",
    "C9 K6",
    """WITH RECURSIVE stored AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
  UNION ALL SELECT s.user_id, s.event_type, min(e.ts) FROM stored s JOIN events e
    ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.ts > s.ts + INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS stored_us FROM stored""",
)
def streamed_expiring_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries the expiring dedupe stores over the whole stream."""
    folder = shared_folder(spark, "stream")
    events = table_stream(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    keys = ["user_id", "event_type"]
    intake.expiring_dedupe(events, keys, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return intake.stored_entries(spark, f"{folder}/rows", events.schema).select(
        *keys, F.unix_micros("ts").alias("stored_us")
    )
