"""Report rows over the claims view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.values import report_date
from legajo.operators import consolidate as con
from legajo.operators import report as rep
from legajo.plans.bindings import (
    CLAIM_COLUMNS,
    CLAIM_FIELDS,
    CLAIM_ORDER,
    RICH_FIELDS,
    as_claims,
    claim_documents,
    claim_items,
    rich_claim_documents,
    table,
)
from legajo.plans.catalog import register
from legajo.plans.claims_sql import DECIDED
from legajo.plans.jobs import replay_changed, run_cases, split_stored
from legajo.session import joined_in_place, shared_folder, stored, stored_by

_WIDE = (
    DECIDED("class")
    + """, wide AS (SELECT case_id, max(CASE WHEN field = 'numero_siniestro' THEN value END) AS claim,
    max(CASE WHEN field = 'nombre_asegurado' THEN value END) AS insured, max(CASE WHEN field = 'numero_poliza' THEN value END) AS policy,
    max(CASE WHEN field = 'monto_reclamacion' THEN value END) AS amount, max(CASE WHEN field = 'fecha_ocurrencia' THEN value END) AS occurred,
    max(CASE WHEN field = 'fecha_reclamacion' THEN value END) AS claimed FROM decided GROUP BY case_id),
every AS (SELECT DISTINCT c.case_id, w.* EXCLUDE (case_id) FROM cells c LEFT JOIN wide w ON c.case_id = w.case_id)
"""
)


@register(
    "report_rows",
    "J1",
    _WIDE
    + """SELECT case_id, claim AS numero_siniestro, insured AS nombre_asegurado, policy AS numero_poliza,
  'NO ESPECIFICADO' AS vigencia_desde, 'NO ESPECIFICADO' AS vigencia_hasta, 'NO ESPECIFICADO' AS domicilio_poliza,
  'NO ESPECIFICADO' AS bien_reclamado, coalesce(amount, '0.00') AS monto_reclamacion, 'NO ESPECIFICADO' AS tipo_siniestro,
  coalesce(strftime(CAST(occurred AS DATE), '%d/%m/%Y'), 'NO ESPECIFICADO') AS fecha_ocurrencia,
  coalesce(strftime(CAST(claimed AS DATE), '%d/%m/%Y'), 'NO ESPECIFICADO') AS fecha_reclamacion,
  'NO ESPECIFICADO' AS lugar_hechos, 'NO ESPECIFICADO' AS ajuste FROM every""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report columns of every case with defaults for absent fields."""
    cases = con.consolidate(claim_documents(spark, sf_dir), CLAIM_FIELDS, CLAIM_ORDER)
    return rep.report_rows(con.wide_cases(cases, CLAIM_FIELDS).drop("sources", "confidences"))


@register(
    "policy_terms",
    "H15",
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS vigencia_desde,
  CASE WHEN o_orderstatus = 'P' THEN 'NO ESPECIFICADO' ELSE strftime(CAST(o_orderdate AS DATE) + 365, '%d/%m/%Y') END AS vigencia_hasta,
  concat('$', format('{:,.2f}', o_totalprice)) AS shown_amount FROM orders""",
)
def policy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term texts split into start and end, amounts for display."""
    day = F.col("o_orderdate").cast("date")
    first, last = day.cast("string"), F.date_add(day, 365).cast("string")
    term = (
        F.when(F.col("o_orderstatus") == "F", F.concat(first, F.lit(" a "), last))
        .when(F.col("o_orderstatus") == "O", F.concat(first, F.lit(" - "), last))
        .otherwise(first)
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", term.alias("term"))
    start, end = rep.policy_term("term")
    return orders.select(
        "o_orderkey",
        report_date(start).alias("vigencia_desde"),
        report_date(end).alias("vigencia_hasta"),
        rep.report_amount("o_totalprice").alias("shown_amount"),
    )


@register(
    "stored_cases",
    "A13 A18",
    _WIDE
    + """SELECT e.case_id, coalesce(CASE WHEN o_orderstatus = 'P' THEN policy ELSE insured END, '') AS nombre_asegurado
FROM every e JOIN orders ON e.case_id = CAST(o_orderkey AS VARCHAR)""",
)
def stored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated record by case, the results record where that is missing."""
    fields = ["nombre_asegurado", "numero_poliza"]
    wide = con.wide_cases(
        con.consolidate(claim_documents(spark, sf_dir), fields, CLAIM_ORDER), fields
    )
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("string").alias("case_id")
    )
    consolidated = wide.join(pending, "case_id", "left_anti").select("case_id", "nombre_asegurado")
    results = wide.select("case_id", F.col("numero_poliza").alias("nombre_asegurado"))
    return rep.stored_cases(consolidated, results, ["nombre_asegurado"])


@register("full_case_run", "J9 F7 H9 J1")
def full_case_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy extractions through cleaning, consolidation and report rows."""
    tables = run_cases(rich_claim_documents(spark, sf_dir), RICH_FIELDS, CLAIM_ORDER)
    return tables.reports


_REPLAYED = (
    DECIDED("class").replace(
        "ON l_orderkey = o_orderkey)", "ON l_orderkey = o_orderkey WHERE l_linenumber <= 6)"
    )
    + """, wide AS (SELECT case_id, max(CASE WHEN field = 'numero_siniestro' THEN value END) AS claim,
    max(CASE WHEN field = 'nombre_asegurado' THEN value END) AS insured, max(CASE WHEN field = 'numero_poliza' THEN value END) AS policy,
    max(CASE WHEN field = 'monto_reclamacion' THEN value END) AS amount, max(CASE WHEN field = 'fecha_ocurrencia' THEN value END) AS occurred,
    max(CASE WHEN field = 'fecha_reclamacion' THEN value END) AS claimed FROM decided GROUP BY case_id),
ready AS (SELECT case_id, max(l_linenumber) AS top, min(l_linenumber) AS bottom FROM docs GROUP BY case_id),
gone AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_linenumber > 6 GROUP BY 1)
"""
)


@register(
    "resumed_replay",
    "J9 A13 A18",
    _REPLAYED
    + """SELECT r.case_id, claim AS numero_siniestro, insured AS nombre_asegurado, policy AS numero_poliza,
  coalesce(CAST(CAST(amount AS DOUBLE) AS VARCHAR), '0.00') AS monto_reclamacion,
  coalesce(strftime(CAST(occurred AS DATE), '%d/%m/%Y'), 'NO ESPECIFICADO') AS fecha_ocurrencia,
  coalesce(strftime(CAST(claimed AS DATE), '%d/%m/%Y'), 'NO ESPECIFICADO') AS fecha_reclamacion,
  CASE WHEN top > 3 THEN 2 ELSE 1 END AS run, coalesce(n, 0) AS n_missing
FROM ready r LEFT JOIN wide w ON r.case_id = w.case_id LEFT JOIN gone g ON r.case_id = g.case_id""",
)
def resumed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases replayed from stored results, and only the changed ones again after more results."""
    # joined once; what follows names the case, so no document leaves its bucket again
    items = stored_by(claim_items(spark, sf_dir).select(*CLAIM_COLUMNS), ["case_id"], "claim-items")
    claims = as_claims(items).withColumn(
        "document_id", F.concat_ws("/", "case_id", "source_document")
    )
    key = ["case_id", "document_id"]
    documents = claims.drop(*CLAIM_FIELDS)
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in CLAIM_FIELDS])

    def results(last: int) -> DataFrame:
        return claims.filter(F.col("l_linenumber") <= last).select(
            *key, F.filter(pairs, lambda p: p["value"].isNotNull()).alias("pairs")
        )

    path = shared_folder(spark, "replay")
    with joined_in_place(spark):
        replay_changed(documents, results(3), path, CLAIM_FIELDS, CLAIM_ORDER, key)
        _, reports = replay_changed(documents, results(6), path, CLAIM_FIELDS, CLAIM_ORDER, key)
        _, missing = split_stored(documents, results(6), key)
        lacking = stored(
            missing.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_missing")), "lacking"
        )
    return (
        reports.select("case_id", *CLAIM_FIELDS, "run")
        .join(lacking, "case_id", "left")
        .fillna(0, ["n_missing"])
    )
