"""Feedback: labels of documents stand for confirmed or corrected fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import consolidate as con
from legajo.operators import feedback as fbk
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_ORDER, claim_documents, table
from legajo.plans.catalog import register
from legajo.plans.claims_sql import DECIDED


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of payloads (source, lang); a toxic document has no status."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("case_id"),
        F.concat_ws("/", "source", "lang").alias("payload_id"),
        F.col("doc_id").alias("created_at"),
        F.concat(F.lit("campo_"), "lang").alias("field"),
        F.col("n_chars").cast("string").alias("original_value"),
        F.when(F.col("quality") == 0, F.concat(F.lit("v"), "n_chars")).alias("corrected_value"),
        F.when(F.col("toxic") == 1, F.lit(None))
        .when(F.col("quality") == 1, F.lit("confirmed"))
        .otherwise(F.lit("corrected"))
        .alias("status"),
    )


_ITEMS = """WITH items AS (SELECT source AS case_id, concat(source, '/', lang) AS payload_id, l.doc_id AS created_at,
    concat('campo_', lang) AS field, CAST(n_chars AS VARCHAR) AS original_value,
    CASE WHEN quality = 0 THEN concat('v', n_chars) END AS corrected_value,
    CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'confirmed' ELSE 'corrected' END AS status
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
bad AS (SELECT DISTINCT payload_id FROM items WHERE status IS NULL)
"""


@register(
    "feedback_payloads",
    "G12",
    _ITEMS
    + """SELECT payload_id, created_at, field, status, payload_id NOT IN (SELECT payload_id FROM bad) AS accepted FROM items""",
)
def feedback_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bad item rejects its whole payload."""
    good, bad = fbk.split_payloads(_items(spark, sf_dir))
    return good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("accepted", F.lit(False))
    ).select("payload_id", "created_at", "field", "status", "accepted")


@register(
    "stored_feedback",
    "J5 J6",
    _ITEMS
    + """, incoming AS (SELECT * FROM items WHERE field IN ('campo_de', 'campo_fr')),
kept AS (SELECT * FROM items WHERE field NOT IN ('campo_de', 'campo_fr') AND case_id NOT IN (SELECT case_id FROM incoming))
SELECT case_id, field, original_value AS "originalValue", corrected_value AS "newValue", status, created_at
FROM (SELECT * FROM kept UNION ALL SELECT * FROM incoming WHERE status IS NOT NULL)""",
)
def stored_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German and French items arrive later and replace what their cases held."""
    items = _items(spark, sf_dir)
    later = F.col("field").isin("campo_de", "campo_fr")
    return fbk.case_feedback(fbk.replace_feedback(items.filter(~later), items.filter(later))).select(
        "case_id", "field", "originalValue", "newValue", "status", "created_at"
    )


@register(
    "feedback_statistics",
    "J7",
    _ITEMS
    + """, valid AS (SELECT * FROM items WHERE status IS NOT NULL)
SELECT coalesce(case_id, 'global') AS scope, count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed,
  count(*) FILTER (status = 'corrected') AS corrected,
  round(count(*) FILTER (status = 'confirmed') * 100.0 / count(*), 2) AS accuracy
FROM valid GROUP BY GROUPING SETS ((case_id), ())""",
)
def feedback_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fbk.feedback_statistics(_items(spark, sf_dir).filter("status IS NOT NULL"))


@register(
    "corrected_cases",
    "H16",
    DECIDED("class")
    + """, wide AS (SELECT case_id, max(CASE WHEN field = 'nombre_asegurado' THEN value END) AS insured,
    max(CASE WHEN field = 'numero_poliza' THEN value END) AS policy FROM decided GROUP BY case_id),
every AS (SELECT DISTINCT c.case_id, insured, policy FROM cells c LEFT JOIN wide w ON c.case_id = w.case_id),
given AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, c_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT e.case_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE insured END AS nombre_asegurado,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN concat('POL ', o_orderpriority) ELSE policy END AS numero_poliza
FROM every e LEFT JOIN given g ON e.case_id = g.case_id""",
)
def corrected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide cases with the corrections of the feedback form applied."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    cells = F.array(
        F.struct(
            F.lit(0).alias("pos"), F.lit("Nombre del asegurado:").alias("label"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("final_value"),
        ),
        F.struct(
            F.lit(1).alias("pos"), F.lit("número de póliza").alias("label"),
            F.when(urgent, F.lit("primero")).alias("final_value"),
        ),
        F.struct(
            F.lit(2).alias("pos"), F.lit("NÚMERO DE PÓLIZA (final)").alias("label"),
            F.when(urgent, F.concat(F.lit("POL "), "o_orderpriority")).otherwise("").alias(
                "final_value"
            ),
        ),
    )
    items = joined.select(F.col("o_orderkey").cast("string").alias("case_id"), F.inline(cells))
    wide = con.wide_cases(
        con.consolidate(claim_documents(spark, sf_dir), CLAIM_FIELDS, CLAIM_ORDER), CLAIM_FIELDS
    )
    return fbk.apply_corrections(wide, fbk.corrections(items)).select(
        "case_id", "nombre_asegurado", "numero_poliza"
    )
