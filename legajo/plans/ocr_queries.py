"""OCR tables: documents are texts, events carry pairs, orders are scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import ocr
from legajo.plans.bindings import table
from legajo.plans.catalog import register


@register(
    "canonical_ocr_rows",
    "B1 B12",
    """SELECT doc_id AS document_id, text, CASE WHEN lang = 'en' THEN 'es' ELSE lang END AS language,
  CASE WHEN source = 'src1' THEN 7 ELSE 1 END AS page_count,
  concat(source, '.pdf') AS source_name, CAST(CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS INTEGER) AS n_pairs, false AS success
FROM documents""",
)
def canonical_ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack or rename parts brought to one shape."""
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        "text",
        F.when(F.col("lang") != "fr", F.create_map(F.lit("k"), F.col("source"))).alias("key_values"),
        F.when(
            F.col("source") == "src1",
            F.create_map(
                F.lit("file_name"), F.concat("source", F.lit(".pdf")), F.lit("page_count"), F.lit("7")
            ),
        )
        .otherwise(F.create_map(F.lit("file_name"), F.concat("source", F.lit(".pdf"))))
        .alias("metadata"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("language"),
    )
    rows = ocr.canonical_rows(raw)
    return rows.select(
        "document_id", "text", "language", "page_count",
        F.col("metadata")["source_name"].alias("source_name"),
        F.size("key_value_pairs").alias("n_pairs"), "success",
    )


@register(
    "merged_pairs",
    "B2 B3",
    """WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)
SELECT event_id, 'evento' AS key, CASE WHEN event_type = 'click' THEN 'Segundo' ELSE event_type END AS value FROM p
UNION ALL SELECT event_id, 'valor_total', v FROM p
UNION ALL SELECT event_id, 'k', k FROM p""",
)
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two readings merged with precedence, one row per key."""
    props = F.map_entries(F.from_json("props", "map<string,string>"))
    events = table(spark, sf_dir, "events").withColumn(
        "v", F.col("value").cast("decimal(18,2)").cast("string")
    )

    def pair(key: str, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    fields = F.array(
        pair("Evento:", F.col("event_type")),
        pair("", F.lit("sin clave")),
        pair(
            " EVENTO ", F.when(F.col("event_type") == "click", F.lit("  Segundo ")).otherwise("  ")
        ),
    )
    pairs = F.concat(
        F.array(
            pair("evento", F.lit("no debe ganar")), pair("Valor Total:", F.col("v")),
            pair("valor total", F.lit("tampoco")),
        ),
        F.transform(props, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
    )
    merged = events.select("event_id", ocr.merged_pairs(fields, pairs).alias("pairs"))
    # explode alone adds a filter on the map, which builds it once more
    return merged.select("event_id", F.explode_outer("pairs").alias("key", "value")).filter(
        "key IS NOT NULL"
    )


_ENTITY_SQL = """WITH found AS (SELECT doc_id, 'Email' AS category, unnest(regexp_extract_all(text, '\\S+@\\S+')) AS content,
    generate_subscripts(regexp_extract_all(text, '\\S+@\\S+'), 1) - 1 AS pos FROM documents
  UNION ALL SELECT doc_id, 'Currency', unnest(regexp_extract_all(text, '[0-9.]+\\$+')),
    generate_subscripts(regexp_extract_all(text, '[0-9.]+\\$+'), 1) + 9999 FROM documents
  UNION ALL SELECT doc_id, 'PhoneNumber', unnest(regexp_extract_all(text, '[0-9]+[-.][0-9]+[-.][0-9.-]+')),
    generate_subscripts(regexp_extract_all(text, '[0-9]+[-.][0-9]+[-.][0-9.-]+'), 1) + 19999 FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content ORDER BY pos, category) AS r FROM found)
SELECT doc_id AS document_id, CAST(pos AS INTEGER) AS pos, content, category,
  CASE category WHEN 'Currency' THEN trim(replace(replace(content, '$', ''), ',', ''))
    WHEN 'PhoneNumber' THEN regexp_replace(content, '\\D', '', 'g') ELSE content END AS normalized
FROM ranked WHERE r = 1"""


@register("distinct_entities", "B4 B5 B11", _ENTITY_SQL)
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every whole text, first per content, normalised by category."""
    documents = table(spark, sf_dir, "documents")
    # fixed values: category, pattern, first position
    kinds = [
        ("Email", r"\S+@\S+", 0),
        ("Currency", r"[0-9.]+\$+", 10000),
        ("PhoneNumber", r"[0-9]+[-.][0-9]+[-.][0-9.-]+", 20000),
    ]
    lists = [
        F.transform(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            _entity(category, first),
        )
        for category, pattern, first in kinds
    ]
    entities = documents.select(
        F.col("doc_id").alias("document_id"), F.inline(F.concat(*lists))
    )
    return ocr.distinct_entities(entities).drop("confidence")


def _entity(category: str, first: int):
    def build(content, position):
        return F.struct(
            (position + first).alias("pos"), content.alias("content"),
            F.lit(category).alias("category"), F.lit(0.9).alias("confidence"),
        )

    return build


@register(
    "table_rows",
    "B6",
    """WITH cells AS (SELECT o_custkey, o_orderkey, 0 AS col, o_orderpriority AS text FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 2, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey AS document_id, o_orderkey AS row_index, o_orderkey = 0 AS is_header,
  concat(max(CASE WHEN col = 0 THEN text END), '||', coalesce(max(CASE WHEN col = 2 THEN text END), '')) AS row_values
FROM cells GROUP BY o_custkey, o_orderkey""",
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to rows: the orders of a customer as one table with a missing column."""
    orders = table(spark, sf_dir, "orders")
    cells = F.filter(
        F.array(
            F.struct(F.lit(0).alias("column_index"), F.col("o_orderpriority").alias("text")),
            F.struct(
                F.lit(2).alias("column_index"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("text"),
            ),
        ),
        lambda c: c["text"].isNotNull(),
    )
    rows = orders.select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("row_index"),
        F.lit(3).alias("column_count"), F.inline(cells),
    )
    built = ocr.table_rows(rows, ["document_id"])
    return built.withColumn("row_values", F.array_join("row_values", "|"))


_SCORES = """WITH means AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'O' THEN 1 - l_discount * 6 END) AS page_mean,
    avg(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 - l_tax * 5 END) AS table_mean,
    avg(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'A' THEN 1 - l_tax * 5 END) AS entity_mean FROM lineitem GROUP BY l_orderkey),
scored AS (SELECT o_orderkey AS document_id, CAST(floor(o_totalprice / 300) AS INTEGER) AS text_length,
    coalesce(CASE WHEN o_orderstatus = 'P' THEN 0.95::DOUBLE END, page_mean, 0) AS overall,
    coalesce(table_mean, 0) AS table_detection, coalesce(entity_mean, 0) AS entity_recognition
  FROM orders LEFT JOIN means ON o_orderkey = l_orderkey)
SELECT document_id, round(overall, 6) AS overall,
  CASE WHEN text_length > 1000 THEN 0.9 WHEN text_length > 500 THEN 0.7 WHEN text_length > 100 THEN 0.5 ELSE 0.3 END::DOUBLE AS text_extraction,
  round(table_detection, 6) AS table_detection, round(entity_recognition, 6) AS entity_recognition,
  CASE WHEN round(overall, 9) >= 0.9 THEN 'excellent' WHEN round(overall, 9) >= 0.7 THEN 'good' WHEN round(overall, 9) >= 0.5 THEN 'fair' ELSE 'poor' END AS quality_assessment,
  array_to_string(list_filter([CASE WHEN text_length < 50 THEN 'Texto extraído muy corto, posible problema de calidad' END,
     CASE WHEN round(overall, 9) < 0.5 THEN 'Confianza baja en el reconocimiento' END], lambda e: e IS NOT NULL), ' | ') AS errors,
  text_length >= 50 AND round(overall, 9) >= 0.5 AS success
FROM scored"""


@register("confidence_scores", "B7 B8", _SCORES)
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each order's pages, tables and entities, with the quality gate."""
    open_line = F.col("l_linestatus") == "O"
    parts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.when(open_line, "page")
        .when(F.col("l_returnflag") == "A", "table")
        .otherwise("entity")
        .alias("part"),
        F.when(open_line, 1 - F.col("l_discount") * 6).otherwise(1 - F.col("l_tax") * 5).alias(
            "confidence"
        ),
    )
    documents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0.95)).alias("confidence"),
        F.floor(F.col("o_totalprice") / 300).cast("int").alias("text_length"),
    )
    gated = ocr.quality_gate(ocr.confidence_scores(documents, parts))
    return gated.select(
        "document_id",
        *[F.round(c, 6).alias(c) for c in ("overall", "text_extraction", "table_detection",
                                           "entity_recognition")],
        "quality_assessment",
        F.array_join("errors", " | ").alias("errors"),
        "success",
    )


@register(
    "ocr_models",
    "B9 B10",
    """WITH f AS (SELECT p_partkey, lower(p_name) AS n, CAST(p_retailprice * 60000 AS BIGINT) AS size FROM part)
SELECT p_partkey, CASE WHEN contains(n, 'ine') OR contains(n, 'ife') OR contains(n, 'pasaporte') THEN 'prebuilt-idDocument'
    WHEN contains(n, 'cfdi') OR contains(n, 'factura_sat') THEN 'prebuilt-invoice' ELSE 'prebuilt-document' END AS model,
  size > 52428800 AS too_large, CASE WHEN size > 52428800 THEN '' ELSE n END AS text, size <= 52428800 AS success FROM f""",
)
def ocr_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model by file name; files over the size limit become failed rows."""
    files = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower("p_name").alias("text"),
        (F.col("p_retailprice") * 60000).cast("long").alias("size_bytes"),
        F.lit(0.9).alias("overall"),
        F.array().cast("array<string>").alias("errors"),
        F.lit(True).alias("success"),
        ocr.ocr_model("p_name").alias("model"),
    )
    return ocr.with_error_rows(files).select(
        "p_partkey", "model", (F.size("errors") > 0).alias("too_large"), "text", "success"
    )


@register(
    "case_documents",
    "B13 B14",
    """SELECT d.doc_id AS document_id, source AS case_id, n_chars / 1024.0::DOUBLE AS file_size_kb,
  CASE WHEN l.doc_id IS NOT NULL THEN md5(text) ELSE md5('') END AS text_md5,
  CASE WHEN quality = 1 THEN lang ELSE 'desconocido' END AS document_type
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with OCR text and extraction where stored, defaults elsewhere."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    registered = documents.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("case_id"),
        F.col("n_chars").alias("size_bytes"),
    )
    stored = ocr.documents_with_extraction(
        documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text")),
        labels.select(F.col("doc_id").alias("document_id")),
        "document_id",
    )
    extracted = (
        documents.join(labels.filter("quality = 1"), "doc_id")
        .select(F.col("doc_id").alias("document_id"), F.col("lang").alias("document_type"))
    )
    view = ocr.case_documents(registered, stored, extracted)
    return view.select(
        "document_id", "case_id", "file_size_kb", F.md5("raw_text").alias("text_md5"), "document_type"
    )


@register(
    "case_header",
    "B15",
    """SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_name, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def case_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of every case an order asks for; an unknown case fails."""
    cases = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), "c_name", "c_mktsegment"
    )
    wanted = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("case_id")
    )
    return ocr.case_headers(cases, wanted)


@register(
    "document_summaries",
    "B16",
    """SELECT doc_id AS document_id, coalesce(text, '') AS preview,
  CAST(length(text) AS INTEGER) AS text_length, CAST(len(string_split(text, E'\\n')) AS INTEGER) AS n_tables, 1 AS n_pairs,
  md5(text) AS tables_md5 FROM documents""",
)
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text, lengths, counts and tables."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.split("text", "\n").alias("tables"),
        F.create_map(F.lit("k"), F.col("source")).alias("key_value_pairs"),
    )
    rows = ocr.summary_rows(documents)
    return rows.withColumn("tables_md5", F.md5(F.array_join("tables", "\n"))).drop("tables")
