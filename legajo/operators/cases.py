"""Case register: ids, resolution, status, bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import CASE_STATUSES
from legajo.functions.text import is_blank
from legajo.operators.scaling import dense_ordinals


def case_label(year: str, seq: str) -> Column:
    return F.format_string("CASE-%d-%04d", F.col(year), F.col(seq))


def parse_case_id(case_id: str) -> tuple[Column, Column]:
    """Year and number of a given id, null where it has another shape."""
    parts = F.split(F.col(case_id), "-")
    return (
        F.get(parts, 1).try_cast("int").alias("year"),
        F.get(parts, 2).try_cast("int").alias("seq"),
    )


def number_cases(
    arrivals: DataFrame, existing: DataFrame, order: Sequence[str], year: str = "year"
) -> DataFrame:
    """Next ids of each year for arrivals in order, after the highest existing one.

    Years are few and huge, hence ``dense_ordinals`` instead of a window.
    """
    highest = existing.groupBy(year).agg(F.max("seq").alias("_highest"))
    numbered = dense_ordinals(arrivals, [year], order, "_n")
    return (
        numbered.join(highest, year, "left")
        .withColumn("seq", (F.col("_n") + F.coalesce("_highest", F.lit(0))).cast("int"))
        .withColumn("case_id", case_label(year, "seq"))
        .drop("_n", "_highest")
    )


def create_if_absent(
    arrivals: DataFrame, existing: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Rows to add: given ids not yet present (parsed), and new ids for the rest.

    ``arrivals`` has a nullable case_id and a year for rows without one.
    """
    given = arrivals.filter(F.col("case_id").isNotNull()).join(
        existing.select("case_id"), "case_id", "left_anti"
    )
    year, seq = parse_case_id("case_id")
    given = given.withColumns({"year": year, "seq": seq})
    known = existing.select("year", "seq").unionByName(given.select("year", "seq"))
    fresh = number_cases(
        arrivals.filter(F.col("case_id").isNull()).drop("case_id"), known, order
    )
    return given.unionByName(fresh)


def latest_case(cases: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """Newest case per path or title."""
    return (
        cases.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by("case_id", F.struct(at, "case_id")).alias("case_id"))
    )


def resolve_cases(arrivals: DataFrame, cases: DataFrame) -> DataFrame:
    """Match on path, then on title; what is left must be created."""
    by_path = latest_case(cases, "base_path").withColumnRenamed("case_id", "_by_path")
    by_title = latest_case(cases, "title").withColumnRenamed("case_id", "_by_title")
    return (
        arrivals.join(by_path, "base_path", "left")
        .join(by_title, "title", "left")
        .select(
            *arrivals.columns,
            F.coalesce("_by_path", "_by_title").alias("case_id"),
            F.when(F.col("_by_path").isNotNull(), "path")
            .when(F.col("_by_title").isNotNull(), "title")
            .otherwise("create")
            .alias("matched_by"),
        )
    )


def list_cases(
    cases: DataFrame, limit: int | None = None, status: str | None = None, at: str = "created_at"
) -> DataFrame:
    """Newest cases first, all of them unless a limit is given."""
    chosen = cases.filter(F.col("status") == status) if status else cases
    ordered = chosen.orderBy(F.desc(at), F.desc("case_id"))
    return ordered if limit is None else ordered.limit(limit)


def update_status(
    cases: DataFrame, updates: DataFrame, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Cases after their valid updates, and the rejected updates.

    The last valid status wins; a null note keeps the note before it.
    """
    valid = F.col("status").isin(CASE_STATUSES)
    place = F.struct(*order)
    last = (
        updates.filter(valid)
        .groupBy("case_id")
        .agg(
            F.max_by("status", place).alias("_status"),
            F.max_by("notes", F.when(F.col("notes").isNotNull(), place)).alias("_notes"),
        )
    )
    updated = (
        cases.join(last, "case_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "notes": F.coalesce("_notes", "notes"),
            }
        )
        .drop("_status", "_notes")
    )
    return updated, updates.filter(~F.coalesce(valid, F.lit(False)))


def case_bundle(
    documents: DataFrame, analyses: DataFrame, consolidated: DataFrame
) -> DataFrame:
    """Everything a report of a case reads, in long form with its sort key.

    Inputs have case_id, item_id, at and detail.  Documents sort by time,
    analyses by time descending, the consolidated record stands alone; readers
    order by (case_id, section, sort_at) and never hold a case in one row.
    """
    seconds = F.col("at").cast("double")
    parts = [
        documents.select(
            "case_id", F.lit("1_documents").alias("section"), seconds.alias("sort_at"),
            F.col("item_id").cast("string").alias("item_id"), "detail",
        ),
        analyses.select(
            "case_id", F.lit("2_analyses").alias("section"), (-seconds).alias("sort_at"),
            F.col("item_id").cast("string").alias("item_id"), "detail",
        ),
        consolidated.select(
            "case_id", F.lit("3_consolidated").alias("section"), F.lit(0.0).alias("sort_at"),
            F.col("item_id").cast("string").alias("item_id"), "detail",
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latest_status(states: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last state of each process; works the same on a stream in update mode."""
    values = [c for c in states.columns if c != key]
    last = states.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return last.select(key, "_last.*")


# --- index of stored cases ------------------------------------------------------------
def split_title(title: str, order: str = "claim_first") -> tuple[Column, Column]:
    """(claim_number, insured_name) of `a - b`; a title without ` - ` names the insured."""
    column = F.col(title)
    parts = F.split(column, " - ", 2)
    two = F.size(parts) == 2
    first, second = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    claim, insured = (first, second) if order == "claim_first" else (second, first)
    return (
        F.when(two, claim).otherwise(F.lit("")).alias("claim_number"),
        F.when(two, insured).otherwise(column).alias("insured_name"),
    )


def case_index(documents: DataFrame, at: str = "created_at") -> DataFrame:
    """One index row per case: title parts, document count, last processing time.

    The document list of a case is its rows in the documents table.
    """
    claim, insured = split_title("case_title")
    return (
        documents.groupBy("case_id", "case_title")
        .agg(F.count(F.lit(1)).alias("total_documents"), F.max(at).alias("processed_at"))
        .select("case_id", "case_title", claim, insured, "total_documents", "processed_at")
    )


def case_listing(index: DataFrame) -> DataFrame:
    """Display title, document total and processed flag of each stored case."""
    insured, claim = F.col("insured_name"), F.col("claim_number")
    has_insured, has_claim = ~is_blank(insured), ~is_blank(claim)
    title = (
        F.when(has_insured & has_claim, F.concat(insured, F.lit(" - "), claim))
        .when(has_insured, insured)
        .when(has_claim, F.concat(F.lit("Reclamo "), claim))
        .otherwise(F.coalesce("case_title", "case_id"))
    )
    total = F.when(
        F.coalesce("total_documents", F.lit(0)) == 0, F.coalesce("n_listed", F.lit(0))
    ).otherwise(F.col("total_documents"))
    return index.select(
        "case_id",
        title.alias("title"),
        total.alias("document_count"),
        "processed_at",
        (F.coalesce("processed_at", F.lit("")) != "").alias("is_processed"),
    )
