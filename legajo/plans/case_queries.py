"""Case register over orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import cases as cas
from legajo.operators import consolidate as con
from legajo.operators import maintain as mnt
from legajo.operators import organise as org
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_ORDER, claim_documents, table
from legajo.plans.catalog import register
from legajo.plans.claims_sql import DECIDED
from legajo.plans.registry_queries import store_statistics
from legajo.session import stored


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", F.year("o_orderdate").alias("year")
    )


@register(
    "numbered_cases",
    "D1 D2",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS year,
  CAST(row_number() OVER w AS INTEGER) AS seq,
  printf('CASE-%d-%04d', year(o_orderdate), row_number() OVER w) AS case_id
FROM orders WINDOW w AS (PARTITION BY year(o_orderdate)
   ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey)""",
)
def numbered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders hold the first numbers of their year; the rest follow."""
    arrivals = _arrivals(spark, sf_dir)
    order = ["o_orderdate", "o_orderkey"]
    none = arrivals.limit(0).withColumn("seq", F.lit(0))
    first = cas.number_cases(arrivals.filter("o_orderstatus = 'F'"), none, order)
    rest = cas.number_cases(arrivals.filter("o_orderstatus <> 'F'"), first, order)
    return first.unionByName(rest).select("o_orderkey", "year", "seq", "case_id")


@register(
    "resolved_cases",
    "D3 D4",
    """WITH known AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_custkey,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN concat('/claims/', c_custkey) END AS base_path,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN c_name END AS title FROM customer)
SELECT o_orderkey, k.case_id,
  CASE WHEN k.base_path IS NOT NULL THEN 'path' WHEN k.title IS NOT NULL THEN 'title' ELSE 'create' END AS matched_by
FROM orders LEFT JOIN (SELECT * FROM known WHERE base_path IS NOT NULL OR title IS NOT NULL) k ON o_custkey = k.c_custkey""",
)
def resolved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving folders matched to known cases by path, then by title."""
    segment = F.col("c_mktsegment")
    known = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"),
        F.when(
            segment.isin("BUILDING", "MACHINERY"), F.concat(F.lit("/claims/"), "c_custkey")
        ).alias("base_path"),
        F.when(segment == "FURNITURE", F.col("c_name")).alias("title"),
        F.col("c_custkey").alias("created_at"),
    )
    arrivals = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("/claims/"), "o_custkey").alias("base_path"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias(
            "title"
        ),
    )
    return cas.resolve_cases(arrivals, known).select("o_orderkey", "case_id", "matched_by")


@register(
    "listed_cases",
    "D5",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS case_id, o_orderdate AS created_at FROM orders
WHERE o_orderstatus = 'O'""",
)
def listed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open cases, newest first."""
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("case_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return cas.list_cases(rows, status="O").select("case_id", "created_at")


_UPDATES = """WITH updates AS (SELECT o_custkey AS case_id, o_orderdate, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'cancelled' END AS status,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS notes FROM orders)
"""


def _status_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.lit("new").alias("status"),
        F.col("c_mktsegment").alias("notes"),
    )
    state = F.col("o_orderstatus")
    updates = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), "o_orderdate", "o_orderkey",
        F.when(state == "F", "ready").when(state == "O", "processing").otherwise("cancelled")
        .alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("notes"),
    )
    return cases, updates


@register(
    "case_status",
    "D6",
    _UPDATES
    + """, last AS (SELECT case_id, arg_max(status, {d: o_orderdate, k: o_orderkey}) AS status,
    arg_max(notes, {d: o_orderdate, k: o_orderkey}) FILTER (notes IS NOT NULL) AS notes
  FROM updates WHERE status IN ('new', 'processing', 'ready', 'archived') GROUP BY case_id)
SELECT c_custkey AS case_id, coalesce(l.status, 'new') AS status, coalesce(l.notes, c_mktsegment) AS notes
FROM customer LEFT JOIN last l ON c_custkey = l.case_id""",
)
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and notes of each case after all its valid updates."""
    cases, updates = _status_tables(spark, sf_dir)
    return cas.update_status(cases, updates, ["o_orderdate", "o_orderkey"])[0]


@register(
    "rejected_status_updates",
    "D6",
    _UPDATES + "SELECT case_id, o_orderkey, status, notes FROM updates WHERE status = 'cancelled'",
)
def rejected_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, updates = _status_tables(spark, sf_dir)
    rejected = cas.update_status(cases, updates, ["o_orderdate", "o_orderkey"])[1]
    return rejected.select("case_id", "o_orderkey", "status", "notes")


@register(
    "case_bundles",
    "D7",
    DECIDED("class")
    + """, filled AS (SELECT case_id, count(*) AS n FROM decided WHERE value IS NOT NULL GROUP BY case_id),
every AS (SELECT DISTINCT case_id FROM cells)
SELECT case_id, '1_documents' AS section, CAST(epoch(l_shipdate) AS DOUBLE) AS sort_at, source_document AS item_id, document_type AS detail FROM docs
UNION ALL SELECT CAST(user_id AS VARCHAR), '2_analyses', -CAST(epoch_us(ts) AS DOUBLE) / 1000000, CAST(event_id AS VARCHAR), event_type FROM events
UNION ALL SELECT e.case_id, '3_consolidated', 0.0, e.case_id, concat(coalesce(n, 0), '/6') FROM every e LEFT JOIN filled f ON e.case_id = f.case_id""",
)
def case_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, analyses and the consolidated record of every case, in long form."""
    claims = claim_documents(spark, sf_dir)
    documents = claims.select(
        "case_id", F.col("source_document").alias("item_id"),
        F.col("l_shipdate").cast("timestamp").alias("at"), F.col("document_type").alias("detail"),
    )
    analyses = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("item_id"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("detail"),
    )
    metrics = con.consolidation_metrics(con.consolidate(claims, CLAIM_FIELDS, CLAIM_ORDER))
    records = metrics.select(
        "case_id", F.col("case_id").alias("item_id"),
        F.concat("fields_filled", F.lit("/"), "fields_total").alias("detail"),
    )
    return cas.case_bundle(documents, analyses, records)


@register(
    "latest_process_status",
    "D8",
    """SELECT user_id AS process_id, arg_max(event_type, {t: ts, e: event_id}) AS status, max(ts) AS ts FROM events
GROUP BY user_id""",
)
def latest_process_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("process_id"), F.col("event_type").alias("status"), "ts", "event_id"
    )
    return cas.latest_status(events, "process_id", ["ts", "event_id"]).drop("event_id")


_INDEX = """WITH indexed AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN concat(c_custkey, ' - ', c_name) ELSE c_name END AS case_title,
    count(*) AS total_documents, max(o_orderdate) AS processed_at
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
parts AS (SELECT *, CASE WHEN contains(case_title, ' - ') THEN split_part(case_title, ' - ', 1) ELSE '' END AS claim_number,
    CASE WHEN contains(case_title, ' - ') THEN split_part(case_title, ' - ', 2) ELSE case_title END AS insured_name FROM indexed)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    title = F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat("c_custkey", F.lit(" - "), "c_name")
    ).otherwise(F.col("c_name"))
    rows = (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_custkey").cast("string").alias("case_id"), title.alias("case_title"),
            F.col("o_orderdate").alias("created_at"),
        )
    )
    return cas.case_index(rows)


@register(
    "case_index",
    "A6 A7",
    _INDEX
    + "SELECT case_id, case_title, claim_number, insured_name, total_documents, processed_at FROM parts",
)
def case_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index row of every case with its title split."""
    return _index(spark, sf_dir)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (
        _index(spark, sf_dir)
        .withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd"))
        .withColumn("n_listed", F.col("total_documents"))
    )
    return cas.case_listing(index)


@register(
    "case_listing",
    "C14",
    _INDEX
    + """SELECT case_id, CASE WHEN claim_number <> '' THEN concat(insured_name, ' - ', claim_number) ELSE insured_name END AS title,
  total_documents AS document_count, strftime(processed_at, '%Y-%m-%d') AS processed_at, true AS is_processed FROM parts""",
)
def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).orderBy(F.desc("processed_at"))


@register(
    "store_dashboard",
    "J8",
    _INDEX
    + """, listed AS (SELECT case_id, CASE WHEN claim_number <> '' THEN concat(insured_name, ' - ', claim_number) ELSE insured_name END AS title,
    total_documents, strftime(processed_at, '%Y-%m-%d') AS day FROM parts),
stats AS (SELECT greatest((SELECT count(DISTINCT source) FROM documents), (SELECT count(*) FROM customer)) AS a,
   count(*) AS b, round(sum(n_chars) / (1024.0 * 1024.0), 2) AS c FROM documents)
SELECT 'total_cases' AS item, CAST(a AS DOUBLE) AS number FROM stats
UNION ALL SELECT 'total_cached_files', b FROM stats UNION ALL SELECT 'cache_size_mb', c FROM stats
UNION ALL SELECT 'mean_documents', round(avg(total_documents), 1) FROM listed
UNION ALL SELECT * FROM (SELECT concat('case ', case_id, ': ', title), CAST(total_documents AS DOUBLE) FROM listed)""",
)
def store_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the store and its cases."""
    return mnt.store_dashboard(_listing(spark, sf_dir), store_statistics(spark, sf_dir))


@register(
    "final_folders",
    "E27 E28 E29 E30",
    DECIDED("class")
    + """, wide AS (SELECT case_id, max(CASE WHEN field = 'nombre_asegurado' THEN value END) AS insured,
    max(CASE WHEN field = 'monto_reclamacion' THEN value END) AS claim FROM decided GROUP BY case_id),
every AS (SELECT DISTINCT c.case_id, insured, claim FROM cells c LEFT JOIN wide w ON c.case_id = w.case_id),
named AS (SELECT case_id, concat(coalesce(upper(insured), 'DESCONOCIDO'), ' - ',
    CASE WHEN claim IS NULL THEN '20240101000000' ELSE claim END) AS folder FROM every),
taken AS (SELECT folder FROM named GROUP BY folder HAVING count(*) > 2)
SELECT case_id, folder, CASE WHEN slot = 1 THEN folder ELSE concat(folder, '_', slot) END AS final_folder
FROM (SELECT case_id, folder, row_number() OVER (PARTITION BY folder ORDER BY case_id)
      + CASE WHEN folder IN (SELECT folder FROM taken) THEN 1 ELSE 0 END AS slot FROM named)""",
)
def final_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of each case from its decided header fields, made unique."""
    fields = ["nombre_asegurado", "monto_reclamacion"]
    cases = con.wide_cases(
        con.consolidate(claim_documents(spark, sf_dir), fields, CLAIM_ORDER), fields
    )
    stamp = F.lit("20240101000000")
    # written once: counted and numbered below
    folders = stored(
        cases.select("case_id", org.folder_name(*fields, stamp).alias("folder")), "folders"
    )
    existing = folders.groupBy("folder").count().filter("count > 2").select("folder")
    return org.resolve_collisions(folders, existing, ["case_id"])


@register(
    "replayable_cases",
    "J9 B13",
    """WITH docs AS (SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS stored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source AS case_id, count(*) FILTER (stored) AS n_ready, count(*) FILTER (NOT stored) AS n_missing FROM docs GROUP BY source""",
)
def replayable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each case with a stored result, and those that lack one."""
    from legajo.plans.jobs import split_stored

    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("case_id")
    )
    results = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    ready, missing = split_stored(documents, results)
    return (
        ready.withColumn("ready", F.lit(True))
        .unionByName(missing.withColumn("ready", F.lit(False)))
        .groupBy("case_id")
        .agg(F.count_if("ready").alias("n_ready"), F.count_if(~F.col("ready")).alias("n_missing"))
    )
