"""Document identity: content hashes, registration, reuse of earlier results.

Copies of one content may be a third of all rows, so every "earliest" or
"newest" is an aggregate that combines before the shuffle, never a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.text import ColumnLike, as_column, safe_name
from legajo.operators.scaling import running_last


def content_hash(content: ColumnLike) -> Column:
    return F.sha2(as_column(content), 256)


def register_documents(
    arrivals: DataFrame, existing: DataFrame, order: str = "document_id"
) -> DataFrame:
    """One row per (case_id, file_hash): its registered id and whether it is new.

    An existing registration keeps its id; otherwise the earliest arrival gives it.
    Both inputs: case_id, file_hash, document_id (and the order column).
    """
    both = arrivals.select(
        "case_id", "file_hash", "document_id", F.col(order).alias("_at"), F.lit(True).alias("_new")
    ).unionByName(
        existing.select(
            "case_id", "file_hash", "document_id", F.col(order).alias("_at"),
            F.lit(False).alias("_new"),
        )
    )
    return both.groupBy("case_id", "file_hash").agg(
        F.min_by("document_id", F.struct("_new", "_at")).alias("document_id"),
        F.min("_new").alias("is_new"),
        F.count_if("_new").alias("n_arrivals"),
    )


def arrival_ids(arrivals: DataFrame, registered: DataFrame) -> DataFrame:
    """The registered id of every arrival."""
    ids = registered.select(
        "case_id", "file_hash", F.col("document_id").alias("registered_id"), "is_new"
    )
    return arrivals.join(ids, ["case_id", "file_hash"])


def by_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact key lookup: wanted keys with the stored row or nulls."""
    return wanted.join(rows, list(keys), "left")


def replace_by_key(
    stored: DataFrame, written: DataFrame, keys: Sequence[str], at: str
) -> DataFrame:
    """Last write per key over what is stored and what was written."""
    both = stored.unionByName(written)
    values = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(at)).alias("_last"))
    return last.select(*keys, "_last.*")


def newest_by_hash(documents: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """For each content hash the document whose OCR result is newest."""
    place = F.struct("processed_at", -F.col("document_id"))
    return (
        documents.select("document_id", "file_hash")
        .join(ocr_results.select("document_id", "processed_at"), "document_id")
        .groupBy("file_hash")
        .agg(F.max_by("document_id", place).alias("shared_id"))
    )


def resolve_ocr(documents: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """Own result, else one of any case with the same content, else a miss."""
    own = ocr_results.select("document_id", F.col("document_id").alias("own_id"))
    shared = newest_by_hash(documents, ocr_results)
    return (
        documents.join(own, "document_id", "left")
        .join(shared, "file_hash", "left")
        .select(
            *documents.columns,
            F.coalesce("own_id", "shared_id").alias("result_id"),
            F.when(F.col("own_id").isNotNull(), "own")
            .when(F.col("shared_id").isNotNull(), "global")
            .otherwise("miss")
            .alias("hit_kind"),
        )
    )


def copied_results(resolved: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """Result rows to add: shared results under the id of the document that hit them."""
    hits = resolved.filter("hit_kind = 'global'").select(
        F.col("document_id").alias("_new_id"), F.col("result_id").alias("document_id")
    )
    return ocr_results.join(hits, "document_id").drop("document_id").withColumnRenamed(
        "_new_id", "document_id"
    )


def mark_ocr_success(documents: DataFrame, ocr_results: DataFrame) -> DataFrame:
    flags = ocr_results.select("document_id", F.lit(True).alias("_stored")).distinct()
    return (
        documents.join(flags, "document_id", "left")
        .withColumn("ocr_success", F.col("_stored").isNotNull())
        .drop("_stored")
    )


def reuse_groups(documents: DataFrame, key: Column, order: str = "document_id") -> DataFrame:
    """Documents that share one extraction: the first does the work for all."""
    return documents.groupBy(key.alias("reuse_key")).agg(
        F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_documents")
    )


def lookup_with_fallback(
    wanted: DataFrame, by_hash: DataFrame, by_name: DataFrame
) -> DataFrame:
    """Stored by content hash, else by raw or sanitised file name.

    ``by_hash``: file_hash; ``by_name``: name.  Adds found_by (hash, name, none).
    """
    hashes = by_hash.select("file_hash").distinct().withColumn("_hash_hit", F.lit(True))
    names = by_name.select("name").distinct()
    raw = names.select(F.col("name").alias("filename"), F.lit(True).alias("_raw_hit"))
    safe = names.select(F.col("name").alias("_safe"), F.lit(True).alias("_safe_hit"))
    return (
        wanted.join(hashes, "file_hash", "left")
        .join(raw, "filename", "left")
        .withColumn("_safe", safe_name("filename"))
        .join(safe, "_safe", "left")
        .withColumn(
            "found_by",
            F.when(F.col("_hash_hit"), "hash")
            .when(F.col("_raw_hit") | F.col("_safe_hit"), "name")
            .otherwise("none"),
        )
        .drop("_hash_hit", "_raw_hit", "_safe_hit", "_safe")
    )


def expiring_lookup(
    accesses: DataFrame,
    keys: Sequence[str],
    at: str,
    is_write: Column,
    order: Sequence[str],
    hours: int = 24,
) -> DataFrame:
    """Hit when the key's newest write is at most ``hours`` old, as of each access.

    As-of lookup by day pieces, so one busy key spreads over its days.
    """
    written = F.when(is_write, F.col(at))
    found = running_last(
        accesses, keys, F.to_date(at), order, {"entry_at": written}
    ).filter(~is_write)
    age = F.col(at) - F.col("entry_at")
    return found.withColumn(
        "hit",
        F.coalesce(age <= F.expr(f"INTERVAL {hours} HOURS"), F.lit(False)),
    )
