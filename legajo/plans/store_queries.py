"""Stored tables written to and read back from a new shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.plans.bindings import table
from legajo.plans.catalog import register
from legajo.session import shared_folder
from legajo.sources import files as fil
from legajo.sources import snapshots
from legajo.sources import stores as sto
from legajo.sources import tolerant as tol


@register(
    "stored_ocr_results",
    "A4 A5 A8 A9 C6",
    """SELECT doc_id AS document_id, left(sha256(text), 2) AS hash_prefix,
  CASE WHEN lang = 'fr' THEN md5('') ELSE md5(text) END AS text_md5,
  CASE WHEN l.doc_id IS NOT NULL THEN 2 ELSE 1 END AS processed_at
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def stored_ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by hash prefix, labelled ones again later; last write read."""
    folder = shared_folder(spark, "stream")
    results = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.sha2("text", 256).alias("file_hash"),
        F.when(F.col("lang") != "fr", F.col("text")).alias("raw_text"),
        F.lit(1).alias("processed_at"),
    )
    again = results.join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")),
        "document_id", "left_semi",
    ).withColumn("processed_at", F.lit(2))
    for rows in (results, again):
        sto.write_ocr_store(sto.ocr_store_rows(rows), folder)
    log = (
        spark.read.schema(
            "document_id BIGINT, file_hash STRING, raw_text STRING, processed_at INT, "
            "hash_prefix STRING"
        )
        .parquet(folder)
        .select("document_id", "hash_prefix", F.md5("raw_text").alias("text_md5"), "processed_at")
    )
    return sto.latest_rows(log, ["document_id"], "processed_at")


@register(
    "delimited_documents",
    "A3",
    """SELECT c_custkey, 'id|señal|nombre' AS headers, concat(c_custkey, '|',
    CASE WHEN c_nationkey < 5 THEN '' ELSE c_mktsegment END, '|',
    CASE WHEN c_nationkey % 2 = 0 THEN concat(c_name, ';,1 "q"', chr(10), 'end') ELSE c_name END) AS first_row, 1 AS row_count, 3 AS column_count
FROM customer""",
)
def delimited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited file contents (two encodings, two separators, some quoted) as documents."""
    european = F.col("c_nationkey") < 12
    separator = F.when(european, ";").otherwise(",")
    segment = F.when(F.col("c_nationkey") < 5, "").otherwise(F.col("c_mktsegment"))
    quoted = F.concat(F.lit('"'), "c_name", F.lit(';,1 ""q""\nend"'))
    name = F.when(F.col("c_nationkey") % 2 == 0, quoted).otherwise(F.col("c_name"))
    body = F.concat(
        F.array_join(F.array(F.lit("id"), F.lit("señal"), F.lit("nombre")), "\x01"), F.lit("\n"),
        F.concat_ws("\x01", F.col("c_custkey").cast("string"), segment, name), F.lit("\n"),
    )
    text = F.replace(body, F.lit("\x01"), separator)
    content = F.when(european, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    files = table(spark, sf_dir, "customer").select("c_custkey", content.alias("content"))
    one = F.get("tables", 0)
    cells = F.transform(F.get(one["data_rows"], 0), lambda c: F.coalesce(c, F.lit("")))
    return fil.delimited_documents(files).select(
        "c_custkey",
        F.array_join(one["headers"], "|").alias("headers"),
        F.array_join(cells, "|").alias("first_row"),
        one["row_count"].alias("row_count"),
        one["column_count"].alias("column_count"),
    )


@register(
    "logged_runs",
    "A10 A11 A12 A14",
    """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, '***redacted***' AS api_key, o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'P' THEN 'desconocido' ELSE o_orderstatus END AS document_type, true AS has_id FROM orders""",
)
def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended under generated ids, options redacted, other keys in extra."""
    folder = shared_folder(spark, "stream")
    options = F.map_filter(
        F.create_map(
            F.lit("api_key"), F.lit("secreto"), F.lit("priority"), F.col("o_orderpriority"),
            F.lit("document_type"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        ),
        lambda k, v: v.isNotNull(),
    )
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("document_id"), options.alias("options")
    )
    rows = sto.extraction_store_rows(sto.redacted_options(runs), "options")
    sto.append_with_id(rows, folder, "run_id")
    stored = spark.read.schema(
        "document_id STRING, document_type STRING, extra MAP<STRING, STRING>, run_id STRING"
    ).parquet(folder)
    return stored.select(
        F.col("document_id").alias("case_id"),
        F.col("extra")["api_key"].alias("api_key"),
        F.col("extra")["priority"].alias("priority"),
        "document_type",
        F.col("run_id").isNotNull().alias("has_id"),
    )


@register(
    "replaced_cases",
    "A13 A6 A18",
    """WITH docs AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CAST(l_linenumber AS INTEGER) AS place,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, l_orderkey AS k FROM lineitem),
again AS (SELECT DISTINCT case_id FROM docs WHERE k % 3 = 0 AND place <= 2)
SELECT case_id, place, amount, 'first' AS run FROM docs WHERE case_id NOT IN (SELECT case_id FROM again)
UNION ALL SELECT case_id, place, concat(amount, ' MXN'), 'second' FROM docs WHERE k % 3 = 0 AND place <= 2""",
)
def replaced_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case records written, a third of the cases written again with fewer rows, and read back."""
    path = shared_folder(spark, "cases")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.col("l_linenumber").cast("int").alias("place"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.lit("first").alias("run"),
    )
    snapshots.create(spark, path)
    snapshots.replace_cases(items, path)
    again = items.filter((F.col("case_id").cast("bigint") % 3 == 0) & (F.col("place") <= 2)).withColumns(
        {"amount": F.concat("amount", F.lit(" MXN")), "run": F.lit("second")}
    )
    snapshots.replace_cases(again, path)
    return snapshots.read(spark, path, items.schema)


@register(
    "tolerant_ocr_json",
    "A4 A7",
    """SELECT source AS case_id,
  CASE WHEN lang = 'fr' THEN 'malformed' WHEN doc_id % 7 = 3 THEN 'wrong type' ELSE 'read' END AS state,
  count(*) AS n_records, sum(CASE WHEN lang <> 'fr' AND doc_id % 7 <> 3 THEN length(text) END) AS n_chars,
  count(*) FILTER (WHERE doc_id % 5 = 1 AND lang <> 'fr') AS n_changed FROM documents GROUP BY ALL""",
)
def tolerant_ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR results as JSON of several engine versions, some cut or mistyped, read without loss."""
    folder = shared_folder(spark, "ocr-json")
    documents = table(spark, sf_dir, "documents")
    pages = F.when(F.col("doc_id") % 7 == 3, F.lit("dos")).otherwise(F.lit("2"))
    record = F.struct(
        F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"),
        F.when(F.col("doc_id") % 5 == 1, F.lit("v2")).alias("engine_build"),
    )
    mistyped = F.to_json(F.struct("record.*", pages.alias("page_count")))
    typed = F.to_json(F.struct("record.*", F.lit(2).alias("page_count")))
    text = F.when(F.col("doc_id") % 7 == 3, mistyped).otherwise(typed)
    whole = documents.withColumn("record", record).withColumn("json", text)
    # without its last character the object does not end
    cut = F.when(F.col("lang") == "fr", F.expr("left(json, length(json) - 1)")).otherwise(F.col("json"))
    whole.select(cut.alias("value"), F.col("source").alias("case_id")).write.partitionBy(
        "case_id"
    ).text(folder)
    records = tol.json_records(spark, folder, "document_id BIGINT, raw_text STRING, page_count INT")
    case = F.url_decode(F.regexp_replace(F.regexp_extract("file", "case_id=([^/]*)/", 1), r"\+", "%2B"))
    return (
        records.withColumn("case_id", case)
        .groupBy("case_id", "state")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.sum(F.length("record.raw_text")).alias("n_chars"),
            F.count_if(F.array_contains("unknown_keys", "engine_build")).alias("n_changed"),
        )
    )


@register(
    "tolerant_event_log",
    "A15",
    """WITH lines AS (SELECT user_id, event_type, value, event_id % 11 = 2 AS broken FROM events)
SELECT event_type, count(*) FILTER (NOT broken) AS n_read, count(*) FILTER (broken) AS n_rejected,
  max(user_id) FILTER (NOT broken) AS top_case FROM lines GROUP BY event_type""",
)
def tolerant_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A progress log of JSON lines; lines that a dying writer cut are kept as rejects."""
    folder = shared_folder(spark, "event-log")
    line = F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("user_id").alias("case"), "event_id"))
    cut = F.when(F.col("event_id") % 11 == 2, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    events = table(spark, sf_dir, "events").withColumn("line", line)
    events.select(cut.alias("value")).write.text(folder)
    records = tol.json_records(spark, folder, "stage STRING, case BIGINT, event_id BIGINT")
    read = tol.readable(records).select("stage", "case", F.lit(True).alias("fine"))
    kept = tol.rejected(records).select(
        F.regexp_extract("text", '"stage":"([^"]*)"', 1).alias("stage"),
        F.lit(None).cast("bigint").alias("case"),
        F.lit(False).alias("fine"),
    )
    return (
        read.unionByName(kept)
        .groupBy(F.col("stage").alias("event_type"))
        .agg(
            F.count_if("fine").alias("n_read"),
            F.count_if(~F.col("fine")).alias("n_rejected"),
            F.max("case").alias("top_case"),
        )
    )
