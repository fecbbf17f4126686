"""Stored tables: Parquet logs with last-write-wins reads, JSON indexes, examples.

A store is an append-only log.  Writers only append; readers take the last row
per key, which is one aggregation; ``compact`` writes the same rows to a new
folder now and then.  Nothing is rewritten in place, so a lost executor or a
retried job cannot damage what is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators.registry import content_hash
from legajo.schemas import STORED_TABLES


# --- logs -------------------------------------------------------------------------
def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(STORED_TABLES[table]).parquet(path)


def latest_rows(log: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Last write per key."""
    values = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(at)).alias("_last"))
    return last.select(*keys, "_last.*")


def compact(log: DataFrame, keys: Sequence[str], at: str, target: str) -> None:
    """Write the current rows to a new folder; the old log stays until readers switch."""
    latest_rows(log, keys, at).write.mode("errorifexists").parquet(target)


# --- OCR results ----------------------------------------------------------------------
def ocr_store_rows(results: DataFrame) -> DataFrame:
    """Result rows with empty parts in place of missing ones."""
    empty = {
        "raw_text": F.lit(""),
        "key_value_pairs": F.create_map().cast("map<string,string>"),
        "metadata": F.create_map().cast("map<string,string>"),
        "errors": F.array().cast("array<string>"),
    }
    return results.withColumns(
        {c: F.coalesce(F.col(c), e) for c, e in empty.items() if c in results.columns}
    )


def write_ocr_store(results: DataFrame, path: str) -> None:
    """Rows under the first two characters of their content hash.

    Ranges on (hash, id) give each task few prefixes, and copies of one content
    still spread over many tasks.
    """
    (
        results.withColumn("hash_prefix", F.substring("file_hash", 1, 2))
        .repartitionByRange("hash_prefix", "file_hash", "document_id")
        .write.mode("append")
        .partitionBy("hash_prefix")
        .parquet(path)
    )


def read_ocr_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored OCR JSON files, one document each."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .json(path)
        .withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    )


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with the SHA-256 of their bytes; the bytes are not kept."""
    return (
        spark.read.format("binaryFile")
        .load(folder)
        .select("path", "length", "modificationTime", content_hash("content").alias("file_hash"))
    )


# --- extractions -------------------------------------------------------------------------
def extraction_store_rows(
    answers: DataFrame, fields: str = "fields", known: Sequence[str] = ("document_type",)
) -> DataFrame:
    """Typed columns for the known keys of a map, every other key into ``extra``."""
    def is_other(key, value):  # noqa: ARG001
        return ~key.isin(list(known))

    return answers.select(
        "document_id",
        F.coalesce(F.try_element_at(fields, F.lit("document_type")), F.lit("desconocido")).alias(
            "document_type"
        ),
        F.map_filter(fields, is_other).alias("extra"),
    )


# --- runs, analyses, replay -----------------------------------------------------------------
def append_with_id(rows: DataFrame, path: str, name: str) -> None:
    """Plain inserts under generated ids (runs, analyses)."""
    append_rows(rows.withColumn(name, F.uuid()), path)


def redacted_options(options: DataFrame, column: str = "options") -> DataFrame:
    """Replay options without the key of the outside service."""
    return options.withColumn(
        column,
        F.transform_values(
            column, lambda k, v: F.when(k == "api_key", F.lit("***redacted***")).otherwise(v)
        ),
    )


# --- case index and examples --------------------------------------------------------------------
def write_case_index(index: DataFrame, path: str) -> None:
    index.write.mode("append").json(path)


def read_case_index(
    spark: SparkSession, path: str, schema: str, case_id: str | None = None
) -> DataFrame:
    index = spark.read.schema(schema).json(path)
    return index.filter(F.col("case_id") == case_id) if case_id else index


def golden_examples(
    spark: SparkSession, path: str, schema: str, list_name: str
) -> DataFrame:
    """Examples of a JSON document whose named list holds them, one row each."""
    document = spark.read.schema(schema).option("multiLine", "true").json(path)
    return document.select(F.inline(list_name))
