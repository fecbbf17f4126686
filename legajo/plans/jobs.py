"""Whole jobs: table in, tables out, for all cases at once."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import REQUIRED_FIELDS
from legajo.operators import consolidate as con
from legajo.operators import extract as ext
from legajo.operators import report as rep
from legajo.operators import validate as chk
from legajo.session import stored
from legajo.sources import snapshots


class CaseTables(NamedTuple):
    """Tables of a case run; all are lazy."""

    extractions: DataFrame
    violations: DataFrame
    consolidated: DataFrame
    decisions: DataFrame
    conflicts: DataFrame
    wide: DataFrame
    reports: DataFrame


def run_cases(
    documents: DataFrame,
    fields: Sequence[str] = REQUIRED_FIELDS,
    order: Sequence[str] = ("doc_seq",),
    profile: str = "class",
    guided: bool = False,
) -> CaseTables:
    """From wide raw extractions to decisions, wide cases and report rows."""
    cleaned = (
        con.mask_fields(ext.guided_values(documents, fields), fields, "none", "none")
        if guided
        else ext.clean_extractions(documents, fields)
    )
    checked = chk.validate_extractions(cleaned, fields)
    decided = con.consolidate(cleaned, fields, order, profile, values=True)
    consolidated = decided.drop(*[f"value_{f}" for f in fields])
    wide = con.wide_cases(decided, fields)
    return CaseTables(
        extractions=cleaned,
        violations=chk.violations(checked, ["case_id", "source_document"]),
        consolidated=consolidated,
        decisions=con.decisions(consolidated),
        conflicts=con.conflicts(consolidated),
        wide=wide,
        reports=rep.report_rows(wide),
    )


Key = str | Sequence[str]


def key_list(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_stored(
    documents: DataFrame, results: DataFrame, key: Key = "document_id"
) -> tuple[DataFrame, DataFrame]:
    """Documents with a stored OCR result, and those without."""
    key = key_list(key)
    known = results.select(*key).distinct()
    return documents.join(known, key, "left_semi"), documents.join(known, key, "left_anti")


def replay_cases(
    documents: DataFrame,
    results: DataFrame,
    fields: Sequence[str] = REQUIRED_FIELDS,
    order: Sequence[str] = ("doc_seq",),
    key: Key = "document_id",
) -> tuple[CaseTables, DataFrame]:
    """Case run from stored OCR rows (with ``pairs``), plus the missing documents."""
    ready = documents.join(results, key_list(key))
    _, missing = split_stored(documents, results, key)
    extracted = ext.fields_from_pairs(ready, "pairs", fields)
    return run_cases(extracted, fields, order), missing


#: Log of the replayed cases: the digest of the rows that a run replayed.
REPLAYED = "case_id STRING, n_rows BIGINT, low DECIMAL(38,0), high DECIMAL(38,0), run BIGINT"


def case_digests(rows: DataFrame) -> DataFrame:
    """(case_id, n_rows, low, high): equal for equal multisets of rows, in whatever order.

    Sums of two hashes per row combine before the shuffle, so no case is sorted or held.
    Columns may be nested, but hold no maps.
    """
    columns = sorted(c for c in rows.columns if c != "case_id")
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias("low"),
        F.sum(F.xxhash64(F.lit("high"), *columns).cast("decimal(20,0)"))
        .cast("decimal(38,0)")
        .alias("high"),
    )


def beside_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows with the columns of their case in ``cases`` (one row per ``_case``), null where it lacks.

    Null is a case.  An equality on its own leaves rows that lie by case where they are, which
    a null-safe one does not, so the one row of the null case comes beside it.
    """
    columns = [c for c in cases.columns if c != "_case"]
    whole = F.struct(F.lit(True).alias("_found"), *columns)
    named = cases.filter("_case IS NOT NULL").select("_case", whole.alias("_named"))
    unnamed = cases.filter("_case IS NULL").select(F.lit(True).alias("_null"), whole.alias("_unnamed"))
    joined = rows.join(named, F.col("case_id") == F.col("_case"), "left").join(
        F.broadcast(unnamed), F.col("case_id").isNull() == F.col("_null"), "left"  # a one-row side
    )
    return joined.withColumn("_of_case", F.coalesce("_named", "_unnamed")).select(
        *rows.columns, "_of_case.*"
    )


def replay_changed(
    documents: DataFrame,
    results: DataFrame,
    path: str,
    fields: Sequence[str] = REQUIRED_FIELDS,
    order: Sequence[str] = ("doc_seq",),
    key: Key = "document_id",
) -> tuple[int, DataFrame]:
    """Replay only cases whose documents or results changed since they were last replayed.

    Reports are kept in a replacing table below ``path``, digests in a log that is
    written after them: a run that dies in between replays the same cases again and
    puts the same reports in place.  A case that has no stored result any more keeps its
    report.  A ``key`` that names case_id too keeps documents and results that lie by case
    there.  Returns the run's number and the reports of all cases, with the run that made each.
    """
    spark = documents.sparkSession
    log_path = f"{path}/replayed"
    spark.createDataFrame([], REPLAYED).write.mode("append").parquet(log_path)
    log = spark.read.schema(REPLAYED).parquet(log_path)
    run = (log.agg(F.max("run")).first()[0] or 0) + 1
    digest = F.struct("n_rows", "low", "high")
    last = log.groupBy(F.col("case_id").alias("_case")).agg(F.max_by(digest, "run").alias("last"))
    now = case_digests(documents.join(results, key_list(key)))
    changed = stored(
        beside_cases(now, last)
        .filter(~digest.eqNullSafe(F.col("last")))
        .select("case_id", "n_rows", "low", "high", F.lit(run).cast("bigint").alias("run")),
        "changed-cases",
    )
    cases = changed.select(F.col("case_id").alias("_case"))
    again = beside_cases(documents, cases).filter("_found").drop("_found")
    reports = replay_cases(again, results, fields, order, key)[0].reports.withColumn(
        "run", F.lit(run).cast("bigint")
    )
    if run == 1:
        snapshots.create(spark, f"{path}/reports")
    snapshots.replace_cases(reports, f"{path}/reports")
    changed.write.mode("append").parquet(log_path)
    return run, snapshots.read(spark, f"{path}/reports", reports.schema)
