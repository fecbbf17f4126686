"""Views of the driver tables as claim data.

orders are cases, lineitem rows are their documents, events are progress and
access logs, documents are OCR texts (their source is the case).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: type given to a lineitem document by l_partkey % 6
CLAIM_TYPES = [
    "informe_preliminar_del_ajustador",
    "poliza_de_la_aseguradora",
    "carta_de_reclamacion_formal_a_la_aseguradora",
    "carpeta_de_investigacion",
    "poliza",
    "otro",
]
CLAIM_FIELDS = [
    "numero_siniestro",
    "nombre_asegurado",
    "numero_poliza",
    "monto_reclamacion",
    "fecha_ocurrencia",
    "fecha_reclamacion",
]
# columns that order the documents of a case; unique together in every case
CLAIM_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two_decimals(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def _day(column: str) -> Column:
    return F.col(column).cast("date").cast("string")


def claim_source() -> Column:
    """File name of a lineitem document."""
    return F.concat(
        F.lit("doc_"), F.col("l_linenumber"), F.lit("_"), F.col("l_partkey"), F.lit("_"),
        F.col("l_suppkey"), F.lit("_"), _two_decimals("l_extendedprice"), F.lit(".pdf"),
    )


def _with_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items beside their order, with the ``case_id`` both are joined on.

    The join key is the text that names a case, so grouping by case needs no
    second exchange.  Both tables grow with the data; the hint keeps the join a
    sort-merge join, whose order the grouping takes over too.
    """
    named = items.withColumn("case_id", F.col("l_orderkey").cast("string"))
    keyed = orders.withColumn("_case", F.col("o_orderkey").cast("string"))
    return named.join(keyed.hint("merge"), F.col("case_id") == F.col("_case"))


def claim_documents(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per document with its six extracted fields, in case order columns.

    ``extra`` names further columns of the line items to keep.
    """
    return as_claims(claim_items(spark, sf_dir), extra)


def claim_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items beside their order: what the claims view is made of."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return _with_orders(items, orders)


#: Columns of ``claim_items`` that ``as_claims`` reads.
CLAIM_COLUMNS = ["case_id", "l_orderkey", *CLAIM_ORDER, "l_returnflag", "o_custkey", "o_orderdate"]


def as_claims(items: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The claims view over rows of ``claim_items``."""
    kind = F.element_at(
        F.array(*[F.lit(t) for t in CLAIM_TYPES]), (F.col("l_partkey") % 6 + 1).cast("int")
    )
    return items.select(
        "case_id",
        *CLAIM_ORDER,
        claim_source().alias("source_document"),
        kind.alias("document_type"),
        F.lpad(F.col("l_orderkey").cast("string"), 14, "0").alias("numero_siniestro"),
        F.concat(F.lit("CUSTOMER "), F.col("o_custkey")).alias("nombre_asegurado"),
        F.concat(F.lit("POL-"), F.col("l_suppkey")).alias("numero_poliza"),
        F.when(F.col("l_returnflag") != "A", _two_decimals("l_extendedprice")).alias(
            "monto_reclamacion"
        ),
        _day("l_shipdate").alias("fecha_ocurrencia"),
        _day("o_orderdate").alias("fecha_reclamacion"),
        *extra,
    )


def claim_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id")
    )


# fields of the richer claims view, beyond CLAIM_FIELDS
RICH_FIELDS = [
    *CLAIM_FIELDS, "vigencia_inicio", "vigencia_fin", "bien_reclamado", "tipo_siniestro",
]


def rich_claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim documents with messy values, so that every rule can fail."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    kind = F.element_at(
        F.array(*[F.lit(t) for t in CLAIM_TYPES]), (F.col("l_partkey") % 6 + 1).cast("int")
    )
    grouped = F.format_number("l_extendedprice", 2)
    latin = F.translate(grouped, ",.", ".,")
    flag, status = F.col("l_returnflag"), F.col("o_orderstatus")
    shipped, ordered = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    return _with_orders(items, orders).select(
        "case_id",
        *CLAIM_ORDER,
        claim_source().alias("source_document"),
        kind.alias("document_type"),
        F.concat(F.lit("SIN-"), F.lpad(F.col("l_orderkey").cast("string"), 14, "0")).alias(
            "numero_siniestro"
        ),
        F.when(status == "P", F.lit("AB"))
        .otherwise(F.concat(F.lit("CUSTOMER "), F.col("o_custkey")))
        .alias("nombre_asegurado"),
        F.concat(F.when(status == "O", "pol_").otherwise("POL-"), F.col("l_suppkey")).alias(
            "numero_poliza"
        ),
        F.when(flag == "A", F.concat(F.lit("$ "), grouped, F.lit(" MXN")))
        .when((flag == "N") & (F.col("l_linenumber") == 1), F.lit("N/A"))
        .when(flag == "N", latin)
        .otherwise(F.concat(F.lit("-"), _two_decimals("l_extendedprice")))
        .alias("monto_reclamacion"),
        F.when(flag == "A", F.concat(F.lit(" "), shipped.cast("string"), F.lit(" ")))
        .when(flag == "N", F.date_format(shipped, "d/M/yyyy"))
        .otherwise(
            F.concat(
                F.date_format(shipped, "dd"), F.lit("-"),
                F.element_at(
                    F.array(*[F.lit(m) for m in (
                        "ENE", "FEB", "MAR", "ABR", "MAY", "JUN",
                        "JUL", "AGO", "SEP", "OCT", "NOV", "DIC",
                    )]),
                    F.month(shipped),
                ),
                F.lit("-"), F.year(shipped),
            )
        )
        .alias("fecha_ocurrencia"),
        ordered.cast("string").alias("fecha_reclamacion"),
        F.date_format(F.date_sub(ordered, 180), "dd/MM/yyyy").alias("vigencia_inicio"),
        F.date_format(F.date_add(ordered, 185), "dd/MM/yyyy").alias("vigencia_fin"),
        F.concat(
            F.lit("lote "), F.col("l_linenumber"), F.lit(" de mercancia  tarifa "),
            F.col("o_orderpriority"),
        ).alias("bien_reclamado"),
        F.when(flag == "A", "Choque frontal")
        .when(flag == "N", "incendio en bodega")
        .otherwise("Robo de bulto por entero en ruta")
        .alias("tipo_siniestro"),
    )


RICH_SQL = """WITH rich AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l.*, o_custkey, o_orderdate,
    concat('doc_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_',
           CAST(l_extendedprice AS DECIMAL(18,2)), '.pdf') AS source_document,
    list_extract(['informe_preliminar_del_ajustador', 'poliza_de_la_aseguradora',
      'carta_de_reclamacion_formal_a_la_aseguradora', 'carpeta_de_investigacion', 'poliza', 'otro'],
      CAST(l_partkey % 6 + 1 AS INTEGER)) AS document_type,
    concat('SIN-', lpad(CAST(l_orderkey AS VARCHAR), 14, '0')) AS numero_siniestro,
    CASE WHEN o_orderstatus = 'P' THEN 'AB' ELSE concat('CUSTOMER ', o_custkey) END AS nombre_asegurado,
    concat(CASE WHEN o_orderstatus = 'O' THEN 'pol_' ELSE 'POL-' END, l_suppkey) AS numero_poliza,
    CASE WHEN l_returnflag = 'A' THEN concat('$ ', format('{:,.2f}', l_extendedprice), ' MXN')
         WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'N/A'
         WHEN l_returnflag = 'N' THEN translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
         ELSE concat('-', CAST(l_extendedprice AS DECIMAL(18,2))) END AS monto_reclamacion,
    CASE WHEN l_returnflag = 'A' THEN concat(' ', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ' ')
         WHEN l_returnflag = 'N' THEN strftime(l_shipdate, '%-d/%-m/%Y')
         ELSE concat(strftime(l_shipdate, '%d'), '-',
              list_extract(['ENE', 'FEB', 'MAR', 'ABR', 'MAY', 'JUN', 'JUL', 'AGO', 'SEP', 'OCT', 'NOV', 'DIC'],
                           CAST(month(l_shipdate) AS INTEGER)), '-', year(l_shipdate)) END AS fecha_ocurrencia,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fecha_reclamacion,
    strftime(CAST(o_orderdate AS DATE) - 180, '%d/%m/%Y') AS vigencia_inicio,
    strftime(CAST(o_orderdate AS DATE) + 185, '%d/%m/%Y') AS vigencia_fin,
    concat('lote ', l_linenumber, ' de mercancia  tarifa ', o_orderpriority) AS bien_reclamado,
    CASE WHEN l_returnflag = 'A' THEN 'Choque frontal' WHEN l_returnflag = 'N' THEN 'incendio en bodega'
         ELSE 'Robo de bulto por entero en ruta' END AS tipo_siniestro
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
"""
