"""Report rows, run metrics and report statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import NOT_SPECIFIED
from legajo.functions.text import ColumnLike, as_column, is_blank
from legajo.functions.values import report_date


def policy_term(term: ColumnLike) -> tuple[Column, Column]:
    """Start and end of `a a b` or `a - b`; one date alone is the start."""
    column = as_column(term)
    by_word, by_dash = F.split(column, " a ", 2), F.split(column, " - ", 2)
    parts = F.when(F.size(by_word) == 2, by_word).otherwise(by_dash)
    two = F.size(parts) == 2
    return (
        F.when(two, F.trim(F.get(parts, 0))).otherwise(column),
        F.when(two, F.trim(F.get(parts, 1))),
    )


def report_amount(amount: ColumnLike) -> Column:
    """Numbers as `$1,234.56`, text as it is, nothing or zero as 0.00."""
    column = as_column(amount)
    number = column.try_cast("double")
    return F.when(
        column.isNull() | (column.cast("string") == "") | (F.coalesce(number, F.lit(1.0)) == 0),
        F.lit("0.00"),
    ).otherwise(F.concat(F.lit("$"), F.format_number(number, 2)))


def report_text_amount(amount: ColumnLike) -> Column:
    column = as_column(amount)
    return F.when(is_blank(column), F.lit("0.00")).otherwise(column)


def risk_band(score: ColumnLike, upper: bool = True) -> Column:
    value = F.coalesce(as_column(score).try_cast("double"), F.lit(0.0))
    names = ("BAJO", "MEDIO", "ALTO") if upper else ("bajo", "medio", "alto")
    return F.when(value < 0.3, names[0]).when(value < 0.6, names[1]).otherwise(names[2])


def report_rows(wide: DataFrame) -> DataFrame:
    """Report columns of each case.

    A column that the case table lacks shows the default; a null stays null.
    """
    present = set(wide.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in present else F.lit(NOT_SPECIFIED)

    def date(name: str) -> Column:
        return report_date(name) if name in present else F.lit(NOT_SPECIFIED)

    if "vigencia" in present and "vigencia_inicio" not in present:
        start, end = policy_term("vigencia")
    else:
        start = F.col("vigencia_inicio") if "vigencia_inicio" in present else F.lit(None)
        end = F.col("vigencia_fin") if "vigencia_fin" in present else F.lit(None)
    columns = {
        "numero_siniestro": F.col("numero_siniestro")
        if "numero_siniestro" in present
        else F.col("case_id"),
        "nombre_asegurado": given("nombre_asegurado"),
        "numero_poliza": given("numero_poliza"),
        "vigencia_desde": report_date(start.cast("string")),
        "vigencia_hasta": report_date(end.cast("string")),
        "domicilio_poliza": given("domicilio_poliza"),
        "bien_reclamado": given("bien_reclamado"),
        "monto_reclamacion": report_text_amount("monto_reclamacion")
        if "monto_reclamacion" in present
        else F.lit("0.00"),
        "tipo_siniestro": given("tipo_siniestro"),
        "fecha_ocurrencia": date("fecha_ocurrencia"),
        "fecha_reclamacion": date("fecha_reclamacion"),
        "lugar_hechos": given("lugar_hechos"),
        "ajuste": given("ajuste"),
    }
    if "fraud_score" in present:
        columns["fraud_score"] = F.coalesce("fraud_score", F.lit(0.0))
        columns["risk_level"] = risk_band("fraud_score")
    return wide.select("case_id", *[c.alias(n) for n, c in columns.items()])


def percent_text(part: Column, whole: Column) -> Column:
    rate = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return F.format_string("%.1f%%", F.round(rate * 100, 1))


def run_metrics(
    per_case: DataFrame, documents: str = "n_documents", results: str = "n_results",
    extracted: str = "n_extracted",
) -> DataFrame:
    """Success and completion rates of each case run."""
    return per_case.select(
        "case_id",
        percent_text(F.col(results), F.col(documents)).alias("ocr_success_rate"),
        percent_text(F.col(extracted), F.col(results)).alias("extraction_success_rate"),
        percent_text(F.col("fields_filled"), F.col("fields_total")).alias(
            "fields_completion_rate"
        ),
        F.col("n_conflicts").alias("conflicts_resolved"),
        F.col("mean_confidence").alias("average_confidence"),
    )


def report_statistics(processes: DataFrame, reports: DataFrame) -> DataFrame:
    """Processes by status and stored MiB."""
    states = processes.agg(
        F.count_if(F.col("status") == "processing").alias("currently_processing"),
        F.count_if(F.col("status") == "completed").alias("completed_today"),
        F.count_if(F.col("status") == "error").alias("errors_today"),
    )
    stored = reports.agg(
        F.count(F.lit(1)).alias("total_reports_generated"),
        F.round(F.sum("size_bytes") / (1024.0 * 1024.0), 6).alias("storage_used_mb"),
    )
    # two one-row sides
    return stored.crossJoin(F.broadcast(states))


def stored_cases(consolidated: DataFrame, results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Case record by id: the consolidated one, else the results one; nulls as ''."""
    both = consolidated.withColumn("_rank", F.lit(1)).unionByName(
        results.withColumn("_rank", F.lit(2)), allowMissingColumns=True
    )
    best = both.groupBy("case_id").agg(F.min_by(F.struct(*fields), F.col("_rank")).alias("_best"))
    return best.select(
        "case_id", *[F.coalesce(F.col(f"_best.{f}"), F.lit("")).alias(f) for f in fields]
    )
