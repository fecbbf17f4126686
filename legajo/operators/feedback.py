"""Feedback on reports: validation, storage, corrections and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import FEEDBACK_LABELS, FEEDBACK_STATUSES
from legajo.functions.text import is_blank


# --- validation -------------------------------------------------------------------
def valid_item() -> Column:
    """An item names a field and has one of the two statuses."""
    return F.coalesce(
        ~is_blank("field") & F.col("status").isin(FEEDBACK_STATUSES), F.lit(False)
    )


def split_payloads(
    items: DataFrame, payload: Sequence[str] = ("payload_id",)
) -> tuple[DataFrame, DataFrame]:
    """Items of clean payloads, and items of payloads with any bad item."""
    bad = items.groupBy(*payload).agg(F.bool_and(valid_item()).alias("_ok")).filter("NOT _ok")
    keys = bad.select(*[F.col(p).alias(f"_bad_{p}") for p in payload])
    same = F.lit(True)
    for p in payload:  # a null key is a payload of its own
        same = same & F.col(p).eqNullSafe(F.col(f"_bad_{p}"))
    return items.join(keys, same, "left_anti"), items.join(keys, same, "left_semi")


# --- storage ------------------------------------------------------------------------
def replace_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new payload replaces every stored row of its case; incomplete items drop."""
    usable = incoming.filter(~is_blank("field") & ~is_blank("status"))
    kept = stored.join(incoming.select("case_id").distinct(), "case_id", "left_anti")
    return kept.unionByName(usable)


def case_feedback(stored: DataFrame, case_ids: Sequence[str] | None = None) -> DataFrame:
    """Stored feedback under its public names, newest first inside a case."""
    rows = stored.filter(F.col("case_id").isin(list(case_ids))) if case_ids else stored
    return rows.select(
        "case_id",
        "field",
        F.col("original_value").alias("originalValue"),
        F.col("corrected_value").alias("newValue"),
        "status",
        "created_at",
    ).orderBy("case_id", F.desc("created_at"))


# --- statistics ----------------------------------------------------------------------
def feedback_statistics(stored: DataFrame) -> DataFrame:
    """Counts by status and accuracy, per case and overall (scope 'global')."""
    confirmed = F.count_if(F.col("status") == "confirmed")
    corrected = F.count_if(F.col("status") == "corrected")
    total = F.count(F.lit(1))
    grouped = stored.groupingSets([["case_id"], []], "case_id").agg(
        F.grouping("case_id").alias("_all"),
        total.alias("total"),
        confirmed.alias("confirmed"),
        corrected.alias("corrected"),
    )
    rate = F.coalesce(F.try_divide(F.col("confirmed") * 100.0, F.col("total")), F.lit(0.0))
    return grouped.select(
        F.when(F.col("_all") == 1, F.lit("global")).otherwise(F.col("case_id")).alias("scope"),
        "total",
        "confirmed",
        "corrected",
        F.round(rate, 2).alias("accuracy"),
    )


# --- corrections -----------------------------------------------------------------------
def label_field(label: str) -> Column:
    """Field of a report label: first of the known labels contained either way."""
    given = F.lower(F.col(label))
    result = F.lit(None).cast("string")
    for known, field in reversed(list(FEEDBACK_LABELS.items())):
        low = known.lower()
        hit = given.contains(low) | F.lit(low).contains(given)
        result = F.when(hit, F.lit(field)).otherwise(result)
    return result


def corrections(items: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Last non-empty final value per (case, field)."""
    return (
        items.filter(~is_blank("final_value"))
        .withColumn("field", label_field("label"))
        .filter("field IS NOT NULL")
        .groupBy("case_id", "field")
        .agg(F.max_by("final_value", F.struct(*order)).alias("final_value"))
    )


def apply_corrections(wide: DataFrame, corrected: DataFrame) -> DataFrame:
    """Wide cases with corrected values; at most one entry per known field and case."""
    changes = corrected.groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "final_value"))).alias("_changes")
    )
    fields = [c for c in wide.columns if c in FEEDBACK_LABELS.values()]
    return (
        wide.join(changes, "case_id", "left")
        .withColumns(
            {f: F.coalesce(F.try_element_at("_changes", F.lit(f)), F.col(f)) for f in fields}
        )
        .drop("_changes")
    )
