"""Consolidation over the claims view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import consolidate as con
from legajo.plans.bindings import (
    CLAIM_FIELDS,
    CLAIM_ORDER,
    claim_cases,
    claim_documents,
)
from legajo.plans.catalog import register
from legajo.plans.claims_sql import ALL_CELLS, DECIDED, OPTIONS


def _consolidated(spark: SparkSession, sf_dir: str, profile: str = "class") -> DataFrame:
    return con.consolidate(claim_documents(spark, sf_dir), CLAIM_FIELDS, CLAIM_ORDER, profile)


def _options(spark: SparkSession, sf_dir: str, profile: str | None = "class") -> DataFrame:
    return con.options(claim_documents(spark, sf_dir), CLAIM_FIELDS, CLAIM_ORDER, profile)


_DECISION_COLUMNS = """case_id, field, value, source_document, confidence, reasoning, n_options"""


@register(
    "case_consolidation",
    "H1 H2 H3 H4 F8",
    DECIDED("class") + f"SELECT {_DECISION_COLUMNS} FROM decided",
)
def case_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision per (case, field) that has at least one usable option."""
    rows = con.decisions(_consolidated(spark, sf_dir)).filter("n_options > 0")
    return rows.drop("n_seen")


@register(
    "case_consolidation_field_profile",
    "H2 H4",
    DECIDED("field") + f"SELECT {_DECISION_COLUMNS} FROM decided",
)
def case_consolidation_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = con.decisions(_consolidated(spark, sf_dir, "field")).filter("n_options > 0")
    return rows.drop("n_seen")


@register(
    "case_consolidation_per_field_profile",
    "H14",
    DECIDED("yaml") + f"SELECT {_DECISION_COLUMNS} FROM decided",
)
def case_consolidation_per_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that differ from field to field."""
    rows = con.decisions(_consolidated(spark, sf_dir, "yaml")).filter("n_options > 0")
    return rows.drop("n_seen")


@register(
    "field_options",
    "H1 F8",
    OPTIONS("class")
    + """SELECT case_id, field, value, priority, source_document, document_type FROM options""",
)
def field_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable values in long form with the rank of their source type."""
    return _options(spark, sf_dir).drop(*CLAIM_ORDER)


@register(
    "conflict_options",
    "H7",
    OPTIONS("class")
    + """,
chosen AS (SELECT *, count(*) OVER (PARTITION BY case_id, field) AS n_options,
    first_value(value) OVER w AS selected,
    concat('Seleccionado de ', first_value(source_document) OVER w, ' (', first_value(document_type) OVER w,
           ') por mayor prioridad') AS reasoning
  FROM options WINDOW w AS (PARTITION BY case_id, field ORDER BY priority, ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT case_id, field, value, source_document, document_type, priority, selected, reasoning
FROM chosen WHERE n_options > 1""",
)
def conflict_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option of every conflict, beside what was chosen and why."""
    chosen = con.conflicts(_consolidated(spark, sf_dir))
    return con.conflict_options(_options(spark, sf_dir), chosen).drop(*CLAIM_ORDER)


@register(
    "wide_cases",
    "H8 H9",
    DECIDED("class")
    + """
SELECT CAST(o.o_orderkey AS VARCHAR) AS case_id,
       max(CASE WHEN field = 'numero_siniestro' THEN value END) AS numero_siniestro,
       max(CASE WHEN field = 'nombre_asegurado' THEN value END) AS nombre_asegurado,
       max(CASE WHEN field = 'monto_reclamacion' THEN value END) AS monto_reclamacion,
       max(CASE WHEN field = 'numero_poliza' THEN value END) AS numero_poliza,
       max(CASE WHEN field = 'fecha_ocurrencia' THEN value END) AS fecha_ocurrencia,
       max(CASE WHEN field = 'fecha_reclamacion' THEN value END) AS fecha_reclamacion,
       round(coalesce(sum(confidence), 0) / 6, 6) AS mean_confidence
FROM orders o LEFT JOIN decided d ON CAST(o.o_orderkey AS VARCHAR) = d.case_id
GROUP BY o.o_orderkey""",
)
def wide_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case, empty cases included."""
    full = con.with_empty_cases(
        claim_cases(spark, sf_dir), _consolidated(spark, sf_dir), CLAIM_FIELDS
    )
    total = F.aggregate(F.map_values("confidences"), F.lit(0.0), lambda acc, c: acc + c)
    return (
        con.wide_cases(full, CLAIM_FIELDS)
        .withColumn("mean_confidence", F.round(total / len(CLAIM_FIELDS), 6))
        .drop("sources", "confidences")
    )


@register(
    "case_context",
    "H12",
    ALL_CELLS
    + """,
types AS (SELECT case_id, array_to_string(list_sort(list(DISTINCT document_type)), ', ') AS document_types
          FROM cells GROUP BY case_id),
seen AS (SELECT case_id, field, min(field_order) AS field_order, count(value) AS n FROM cells
         GROUP BY case_id, field HAVING count(value) > 0),
counts AS (SELECT case_id, string_agg(concat(field, '=', n), ', ' ORDER BY field_order) AS field_counts
           FROM seen GROUP BY case_id)
SELECT case_id, document_types, field_counts FROM types JOIN counts USING (case_id)""",
)
def case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.case_context(_consolidated(spark, sf_dir))


@register(
    "consolidation_metrics",
    "H13",
    DECIDED("class")
    + """,
cases AS (SELECT DISTINCT case_id FROM cells)
SELECT c.case_id, CAST(count(d.value) AS INTEGER) AS fields_filled, 6 AS fields_total,
       CAST(count(CASE WHEN d.n_options > 1 THEN 1 END) AS INTEGER) AS n_conflicts,
       round(coalesce(sum(d.confidence), 0) / 6, 6) AS mean_confidence
FROM cases c LEFT JOIN decided d ON c.case_id = d.case_id GROUP BY c.case_id""",
)
def consolidation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.consolidation_metrics(_consolidated(spark, sf_dir))


@register(
    "decisions_without_priority",
    "H5 H6",
    OPTIONS("class")
    + """,
ruled AS (SELECT *, CASE
  WHEN field IN ('numero_siniestro', 'fecha_ocurrencia', 'fecha_reclamacion', 'monto_reclamacion')
       AND contains(lower(source_document), 'denuncia') THEN 1
  WHEN field IN ('nombre_asegurado', 'numero_poliza') AND contains(lower(source_document), 'poliza') THEN 1
  WHEN field = 'numero_siniestro' AND contains(lower(source_document), 'poliza') THEN 2
  WHEN field IN ('nombre_asegurado', 'numero_poliza') AND contains(lower(source_document), 'denuncia') THEN 2
  WHEN field = 'monto_reclamacion' AND contains(lower(source_document), 'factura') THEN 2
  WHEN field = 'fecha_ocurrencia' AND contains(lower(source_document), 'peritaje') THEN 2
  WHEN field = 'monto_reclamacion' AND contains(lower(source_document), 'peritaje') THEN 3
  END AS rule
  FROM (SELECT * REPLACE (concat(document_type, '_', source_document) AS source_document) FROM options)),
by_value AS (SELECT case_id, field, value, count(*) AS n, min(ordinal) AS first_ordinal,
    arg_min(source_document, ordinal) AS first_source,
    min({'rule': rule, 'ordinal': ordinal, 'source': source_document}) FILTER (rule IS NOT NULL) AS best
  FROM ruled GROUP BY case_id, field, value),
by_field AS (SELECT case_id, field, CAST(sum(n) AS BIGINT) AS n_options,
    min({'less': -n, 'ordinal': first_ordinal, 'value': value, 'source': first_source}) AS common,
    min({'rule': best.rule, 'ordinal': best.ordinal, 'value': value, 'source': best.source})
      FILTER (best IS NOT NULL) AS ruled
  FROM by_value GROUP BY case_id, field),
picked AS (SELECT case_id, field, n_options, ruled.rule AS rule,
    CASE WHEN ruled IS NOT NULL THEN ruled.value ELSE common.value END AS value,
    CASE WHEN ruled IS NOT NULL THEN ruled.source ELSE common.source END AS source_document
  FROM by_field)
SELECT case_id, field, value, source_document,
       CASE WHEN n_options = 1 THEN 1.0 WHEN rule IS NOT NULL THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence,
       CASE WHEN n_options = 1 THEN concat('Único valor de ', source_document)
            WHEN rule IS NOT NULL THEN concat('Seleccionado de ', source_document, ' por regla de prioridad legacy')
            ELSE concat('Valor más común entre ', n_options, ' documentos') END AS reasoning,
       n_options
FROM picked""",
)
def decisions_without_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-name rules first, then the most common value."""
    named = claim_documents(spark, sf_dir).withColumn(
        "source_document", F.concat_ws("_", "document_type", "source_document")
    )
    rows = con.options(named, CLAIM_FIELDS, CLAIM_ORDER, profile=None)
    return con.resolve_without_priority(rows, CLAIM_ORDER)


@register(
    "adjusted_decisions",
    "H10",
    DECIDED("class")
    + """,
adjustments AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS case_id, 'nombre_asegurado' AS field,
                       c_name AS new_value
                FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT d.case_id, d.field,
       CASE WHEN d.value IS NOT NULL AND a.new_value IS NOT NULL THEN a.new_value ELSE d.value END AS value,
       d.confidence
FROM decided d LEFT JOIN adjustments a ON d.case_id = a.case_id AND d.field = a.field""",
)
def adjusted_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with an optional table of adjustments applied."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    adjustments = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.lit("nombre_asegurado").alias("field"),
        F.col("c_name").alias("new_value"),
    )
    rows = con.decisions(_consolidated(spark, sf_dir)).filter("n_options > 0")
    return con.apply_adjustments(rows, adjustments).select(
        "case_id", "field", "value", "confidence"
    )
