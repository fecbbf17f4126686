"""Findings over the claims view and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import consolidate as con
from legajo.operators import findings as fnd
from legajo.operators import requests as req
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_ORDER, claim_documents, table
from legajo.plans.catalog import register
from legajo.plans.claims_sql import ALL_CELLS, DECIDED, DOCUMENTS


def _all_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every document, whatever its type may supply."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CLAIM_FIELDS])
    return (
        claim_documents(spark, sf_dir)
        .select("case_id", "source_document", *CLAIM_ORDER, F.inline(cells))
        .filter("value IS NOT NULL")
    )


@register(
    "cross_document_discrepancies",
    "I4",
    ALL_CELLS
    + """, given AS (SELECT * FROM cells WHERE value IS NOT NULL),
per_value AS (SELECT case_id, field, value, count(*) AS n_documents, arg_min(source_document, ordinal) AS source_b FROM given GROUP BY ALL),
base AS (SELECT case_id, field, arg_min(value, ordinal) AS value_a, arg_min(source_document, ordinal) AS source_a,
    count(DISTINCT value) AS n FROM given GROUP BY case_id, field)
SELECT case_id, field, value_a, source_a, value AS value_b, source_b, n_documents
FROM per_value JOIN base USING (case_id, field) WHERE n > 1 AND value <> value_a""",
)
def cross_document_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ from the first one of the same field in the case."""
    return fnd.discrepancies(_all_options(spark, sf_dir), CLAIM_ORDER)


@register(
    "discrepant_documents",
    "I4",
    ALL_CELLS
    + """, given AS (SELECT * FROM cells WHERE value IS NOT NULL),
base AS (SELECT case_id, field, arg_min(value, ordinal) AS value_a FROM given GROUP BY case_id, field)
SELECT case_id, field, value, source_document FROM given JOIN base USING (case_id, field) WHERE value <> value_a""",
)
def discrepant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind every differing value."""
    return fnd.discrepant_rows(_all_options(spark, sf_dir), CLAIM_ORDER).select(
        "case_id", "field", "value", "source_document"
    )


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst answers as JSON text, with numbers, quoted numbers, true and broken text."""
    score = F.round(F.col("o_totalprice") / 500000, 4)
    state = F.col("o_orderstatus")
    shown = (
        F.when(state == "F", score.cast("decimal(10,4)").cast("string"))
        .when(state == "O", F.concat(F.lit('"'), score.cast("decimal(10,4)"), F.lit('"')))
        .otherwise(F.lit("true"))
    )
    indicator = F.concat(
        F.lit('{"description":"prioridad '), "o_orderpriority", F.lit('","weight":0.5,"doc_refs":[0,2]}')
    )
    indicators = F.concat(
        F.lit("["),
        F.when(F.col("o_orderpriority") == "1-URGENT", indicator).otherwise(""),
        F.lit("]"),
    )
    inconsistency = F.concat(
        F.lit('[{"field":"fecha","value_a":"'), F.col("o_orderdate").cast("date").cast("string"),
        F.lit('","value_b":null,"severity":"alta","affected_docs":[1]}]'),
    )
    body = F.concat(
        F.lit('{"fraud_score": '), shown, F.lit(',"fraud_indicators":'), indicators,
        F.lit(',"inconsistencies":'), inconsistency,
        F.lit(',"external_validations":[{"type":"repuve","description":"x","result":"ok","is_critical":false}]}'),
    )
    answer = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.substring(body, 1, 15))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.substring(body, 1, 40))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.replace(body, shown, F.lit('"NaN"')))
        .otherwise(body)
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), answer.alias("answer")
    )


@register(
    "risk_bands",
    "I2 I7",
    """WITH scored AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id,
    CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM') THEN 0.0 WHEN o_orderstatus = 'F' THEN CAST(CAST(round(o_totalprice / 500000, 4) AS DECIMAL(10,4)) AS DOUBLE)
         WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS fraud_score FROM orders)
SELECT case_id, fraud_score, CASE WHEN fraud_score < 0.3 THEN 'BAJO' WHEN fraud_score < 0.6 THEN 'MEDIO' ELSE 'ALTO' END AS risk_level,
  CASE WHEN fraud_score < 0.3 THEN 'bajo' WHEN fraud_score < 0.6 THEN 'medio' ELSE 'alto' END AS risk_label FROM scored""",
)
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each answer (0 when unusable) and its band."""
    return fnd.risk_rows(fnd.normal_answers(_answers(spark, sf_dir)))


@register(
    "answer_findings",
    "I3",
    """WITH usable AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
  FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED'))
SELECT case_id, 'indicator' AS kind, concat('prioridad ', o_orderpriority) AS detail, unnest([0, 2]) AS doc_index FROM usable WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT case_id, 'inconsistency', concat('fecha alta ', day), 1 FROM usable
UNION ALL SELECT case_id, 'validation', 'repuve ok', NULL FROM usable""",
)
def answer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of the answers: indicators, inconsistencies, validations."""
    return fnd.finding_rows(fnd.normal_answers(_answers(spark, sf_dir)))


@register(
    "case_payloads",
    "I1",
    DOCUMENTS
    + """SELECT case_id, ordinal - 1 AS doc_index, document_type, CAST(length(source_document) AS INTEGER) AS text_length FROM docs""",
)
def case_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact document rows of an analysis request, indexed inside the case."""
    documents = claim_documents(spark, sf_dir).withColumn("raw_text", F.col("source_document"))
    return req.case_payload(documents, CLAIM_ORDER)


@register(
    "document_analyses",
    "I5 I6 I8",
    """WITH lines AS (SELECT doc_id, text, string_split(text, E'\\n') AS l, lang FROM documents),
points AS (SELECT doc_id, lang, text, list_filter(list_concat(l[1:1], CASE WHEN len(l) > 1 THEN l[2:] ELSE [] END),
    lambda t: length(t) > 0) AS p, list_filter(l, lambda t: contains(t, '$')) AS a FROM lines)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_points, md5(array_to_string(p, '|')) AS points_md5,
  array_to_string(list_concat(list_concat(list_transform(a, lambda x: 'content/medium'),
    CASE WHEN contains(lower(text), 'nicht') THEN ['visual/high'] ELSE [] END),
    CASE WHEN lang = 'es' THEN ['contextual/high'] ELSE [] END), ',') AS alerts FROM points""",
)
def document_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report points and alerts assembled per document."""
    lines = F.split("text", "\n")
    content = F.array(
        F.struct(
            F.lit("titulo").alias("name"), F.get(lines, 0).alias("text"),
            F.lit(None).cast("array<string>").alias("items"),
        ),
        F.struct(
            F.lit("parrafos").alias("name"), F.lit(None).cast("string").alias("text"),
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("items"),
        ),
    )
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        content.alias("content"),
        F.filter(lines, lambda x: x.contains("$")).alias("anomalies"),
        F.when(F.lower("text").contains("nicht"), F.lit("Posible ALTERACIÓN")).alias("visual"),
        F.when(F.col("lang") == "es", F.lit("hay inconsistencias")).alias("contextual"),
    )
    analysed = fnd.document_analyses(rows)
    marks = F.transform("alerts", lambda a: F.concat_ws("/", a["type"], a["severity"]))
    return analysed.select(
        "doc_id",
        F.size("report_points").alias("n_points"),
        F.md5(F.array_join("report_points", "|")).alias("points_md5"),
        F.array_join(marks, ",").alias("alerts"),
    )


@register(
    "merged_model_decisions",
    "H11",
    DECIDED("class")
    + """, every AS (SELECT DISTINCT case_id FROM cells), fields AS (SELECT DISTINCT field FROM cells),
answered AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'numero_poliza' AS field, concat('POL-', o_custkey) AS v FROM orders WHERE o_orderstatus = 'F')
SELECT e.case_id, f.field, CASE WHEN n_options > 1 AND v IS NOT NULL THEN v ELSE d.value END AS value,
  CASE WHEN n_options > 1 AND v IS NOT NULL THEN 0.7 ELSE coalesce(d.confidence, 0) END::DOUBLE AS confidence,
  CASE WHEN n_options > 1 AND v IS NOT NULL THEN 'elegido fuera' ELSE d.reasoning END AS reasoning, coalesce(n_options, 0) AS n_options
FROM every e CROSS JOIN fields f LEFT JOIN decided d ON e.case_id = d.case_id AND f.field = d.field
LEFT JOIN answered a ON e.case_id = a.case_id AND f.field = a.field""",
)
def merged_model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts decided by a model where it answered, by rule elsewhere."""
    cases = con.consolidate(claim_documents(spark, sf_dir), CLAIM_FIELDS, CLAIM_ORDER)
    answered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.lit("numero_poliza").alias("field"),
        F.concat(F.lit("POL-"), "o_custkey").alias("model_value"),
        F.lit("modelo").alias("model_source"),
        F.lit(0.7).alias("model_confidence"),
        F.lit("elegido fuera").alias("model_reasoning"),
    )
    return req.merge_model_decisions(cases, answered).select(
        "case_id", "field", "value", "confidence", "reasoning", "n_options"
    )
