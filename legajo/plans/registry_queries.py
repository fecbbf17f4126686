"""Identity and reuse over the documents table; the source of a document is its case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import extract as ext
from legajo.operators import maintain as mnt
from legajo.operators import organise as org
from legajo.operators import registry as reg
from legajo.plans.bindings import table
from legajo.plans.catalog import register


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("case_id"),
        F.concat("source", F.lit("_"), "doc_id", F.lit(".pdf")).alias("filename"),
        reg.content_hash("text").alias("file_hash"),
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels have a stored result, processed in id order."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").alias("processed_at"),
        "quality", "toxic",
    )


HASHED = """WITH hashed AS (SELECT doc_id AS document_id, source AS case_id,
    concat(source, '_', doc_id, '.pdf') AS filename, sha256(text) AS file_hash FROM documents)
"""


@register(
    "registered_documents",
    "C1 C2",
    HASHED
    + """SELECT case_id, file_hash,
  coalesce(min(CASE WHEN l.doc_id IS NOT NULL THEN document_id END), min(document_id)) AS document_id,
  count(l.doc_id) = 0 AS is_new, count(*) FILTER (l.doc_id IS NULL) AS n_arrivals
FROM hashed LEFT JOIN labels l ON document_id = l.doc_id GROUP BY case_id, file_hash""",
)
def registered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are registered already; the rest arrive."""
    documents = hashed_documents(spark, sf_dir)
    labelled = stored_results(spark, sf_dir)
    existing = documents.join(labelled, "document_id", "left_semi")
    arrivals = documents.join(labelled, "document_id", "left_anti")
    return reg.register_documents(arrivals, existing)


@register(
    "arrival_ids",
    "C2 C3",
    HASHED
    + """SELECT document_id, min(document_id) OVER (PARTITION BY case_id, file_hash) AS registered_id FROM hashed""",
)
def arrival_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id under which every arriving document is known."""
    documents = hashed_documents(spark, sf_dir)
    registered = reg.register_documents(documents, documents.limit(0))
    return reg.arrival_ids(documents, registered).select("document_id", "registered_id")


@register(
    "resolved_ocr",
    "C4 C5 C7 D9",
    HASHED
    + """, newest AS (SELECT file_hash, max(document_id) AS shared_id FROM hashed JOIN labels ON document_id = doc_id
   GROUP BY file_hash)
SELECT document_id, coalesce(l.doc_id, shared_id) AS result_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'own' WHEN shared_id IS NOT NULL THEN 'global' ELSE 'miss' END AS hit_kind,
  l.doc_id IS NOT NULL AS ocr_success
FROM hashed LEFT JOIN labels l ON document_id = l.doc_id LEFT JOIN newest USING (file_hash)""",
)
def resolved_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the result of each document comes from."""
    documents = hashed_documents(spark, sf_dir)
    results = stored_results(spark, sf_dir)
    resolved = reg.resolve_ocr(documents.select("document_id", "file_hash"), results)
    return reg.mark_ocr_success(resolved, results).drop("file_hash")


@register(
    "copied_results",
    "C5 C6",
    HASHED
    + """, newest AS (SELECT file_hash, max(document_id) AS shared_id FROM hashed JOIN labels ON document_id = doc_id
   GROUP BY file_hash)
SELECT document_id, processed_at, quality, toxic FROM (
  SELECT doc_id AS document_id, doc_id AS processed_at, quality, toxic FROM labels
  UNION ALL SELECT h.document_id, s.doc_id, s.quality, s.toxic
  FROM hashed h JOIN newest USING (file_hash) JOIN labels s ON s.doc_id = shared_id
  WHERE h.document_id NOT IN (SELECT doc_id FROM labels))""",
)
def copied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table after shared results are copied under their new ids."""
    documents = hashed_documents(spark, sf_dir).select("document_id", "file_hash")
    results = stored_results(spark, sf_dir)
    copies = reg.copied_results(reg.resolve_ocr(documents, results), results)
    return reg.replace_by_key(results, copies, ["document_id"], "processed_at")


@register(
    "last_writes",
    "C6",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
FROM events GROUP BY user_id, event_type""",
)
def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins per key, over errors stored first and everything else later."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    stored = events.filter("event_type = 'error'")
    written = events.filter("event_type <> 'error'")
    return reg.replace_by_key(stored, written, ["user_id", "event_type"], "event_id")


@register(
    "reuse_groups",
    "C8",
    """SELECT md5(concat(source, '.pdf', chr(31), coalesce(text, ''))) AS reuse_key, min(doc_id) AS first_id,
  count(*) AS n_documents FROM documents GROUP BY 1""",
)
def reuse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that can share one extraction."""
    documents = table(spark, sf_dir, "documents")
    key = ext.reuse_key(F.concat("source", F.lit(".pdf")), "text")
    return reg.reuse_groups(documents, key, "doc_id")


@register(
    "expiring_lookups",
    "C9",
    """WITH accesses AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS entry_at FROM events)
SELECT event_id, user_id, event_type, coalesce(ts - entry_at <= INTERVAL 24 HOURS, false) AS hit
FROM accesses WHERE event_type <> 'purchase'""",
)
def expiring_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases write an entry per user; other events look it up for 24 hours."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    found = reg.expiring_lookup(
        events, ["user_id"], "ts", F.col("event_type") == "purchase", ["ts", "event_id"]
    )
    return found.select("event_id", "user_id", "event_type", "hit")


@register(
    "store_lookups",
    "C18 C7",
    HASHED
    + """, good AS (SELECT DISTINCT file_hash FROM hashed JOIN labels ON document_id = doc_id WHERE quality = 1),
named AS (SELECT DISTINCT filename FROM hashed JOIN labels ON document_id = doc_id WHERE quality = 0)
SELECT document_id, CASE WHEN g.file_hash IS NOT NULL THEN 'hash' WHEN n.filename IS NOT NULL THEN 'name' ELSE 'none' END AS found_by
FROM hashed h LEFT JOIN good g USING (file_hash) LEFT JOIN named n USING (filename)""",
)
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored by hash, else under a reorganised name."""
    documents = hashed_documents(spark, sf_dir)
    results = stored_results(spark, sf_dir)
    good = documents.join(results.filter("quality = 1"), "document_id", "left_semi")
    named = documents.join(results.filter("quality = 0"), "document_id", "left_semi").select(
        F.col("filename").alias("name")
    )
    return reg.lookup_with_fallback(documents, good, named).select("document_id", "found_by")


@register(
    "reorganised_paths",
    "C15 J4",
    """WITH named AS (SELECT o_orderkey, c_name, o_orderpriority, concat('/in/', o_orderkey, ' ', o_orderpriority, '.pdf') AS path
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey,
  concat(trim(regexp_replace(c_name, '[^a-zA-Z0-9_.-]+', '_', 'g'), '_'), ' - ', o_orderkey, '/',
    trim(regexp_replace(concat(o_orderkey, ' ', o_orderpriority), '[^a-zA-Z0-9_.-]+', '_', 'g'), '_'), '/ocr_results_for_',
    trim(regexp_replace(concat(o_orderkey, ' ', o_orderpriority, '.pdf'), '[^a-zA-Z0-9_.-]+', '_', 'g'), '_'), '.json') AS new_path,
  concat(trim(regexp_replace(c_name, '[^a-zA-Z0-9_.-]+', '_', 'g'), '_'), '_', o_orderkey, '_INFORME.html') AS report_name
FROM named""",
)
def reorganised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned store path and report name per order."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    named = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey",
        F.concat(F.lit("/in/"), "o_orderkey", F.lit(" "), "o_orderpriority", F.lit(".pdf")).alias(
            "path"
        ),
        "c_name",
        F.col("o_orderkey").cast("string").alias("claim"),
    )
    return named.select(
        "o_orderkey",
        org.reorganised_path("c_name", "claim", "path").alias("new_path"),
        org.report_name("c_name", "claim").alias("report_name"),
    )


def _case_id(number: str) -> Column:
    return F.concat(F.lit("C"), F.lpad(F.col(number).cast("string"), 7, "0"))


@register(
    "orphans",
    "C16",
    """WITH valid AS (SELECT DISTINCT concat('C', lpad(CAST(o_custkey AS VARCHAR), 7, '0')) AS case_id FROM orders WHERE o_orderstatus = 'F'),
folders AS (SELECT concat('ACME_', 'C', lpad(CAST(c_custkey AS VARCHAR), 7, '0'), '-final') AS folder,
  concat('C', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS case_id FROM customer)
SELECT 'index' AS kind, case_id AS item FROM folders WHERE case_id NOT IN (SELECT case_id FROM valid)
UNION ALL SELECT 'folder', folder FROM folders WHERE NOT EXISTS (SELECT 1 FROM valid WHERE contains(folder, valid.case_id))""",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows and folders of customers without a finished order."""
    customers = table(spark, sf_dir, "customer")
    cases = (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus = 'F'")
        .select(_case_id("o_custkey").alias("case_id"))
    )
    index = customers.select(_case_id("c_custkey").alias("case_id"))
    folders = index.select(
        F.concat(F.lit("ACME_"), "case_id", F.lit("-final")).alias("folder")
    )
    rows = mnt.orphan_index_rows(index, cases).select(
        F.lit("index").alias("kind"), F.col("case_id").alias("item")
    )
    lost = mnt.orphan_folders(folders, cases).select(
        F.lit("folder").alias("kind"), F.col("folder").alias("item")
    )
    return rows.unionByName(lost)


@register(
    "purged_documents",
    "C17",
    """SELECT doc_id AS document_id, source AS case_id FROM documents
WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) < 0.5)""",
)
def purged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay after the cases of poor quality are purged."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("case_id")
    )
    poor = (
        documents.join(stored_results(spark, sf_dir), "document_id")
        .groupBy("case_id")
        .agg(F.avg("quality").alias("mean"))
        .filter("mean < 0.5")
    )
    return mnt.purge_cases(documents, poor)


@register(
    "store_statistics",
    "C13",
    """SELECT greatest((SELECT count(DISTINCT source) FROM documents), (SELECT count(*) FROM customer)) AS total_cases,
  count(*) AS total_cached_files, round(sum(n_chars) / (1024.0 * 1024.0), 2) AS cache_size_mb FROM documents""",
)
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case, file and size totals of the store."""
    documents = table(spark, sf_dir, "documents")
    index = documents.select(F.col("source").alias("case_id")).distinct()
    folders = table(spark, sf_dir, "customer").select(
        F.concat("c_name", F.lit(" - "), "c_custkey").alias("folder")
    )
    files = documents.select(F.col("n_chars").alias("size_bytes"))
    return mnt.store_statistics(index, folders, files)


@register(
    "discovered_files",
    "A1 A2 A19",
    """WITH listing AS (SELECT doc_id, source, concat(CASE WHEN lang = 'fr' THEN '._' ELSE '' END, doc_id,
    list_extract(['.pdf', '.JPG', '.txt', '.csv'], CAST(n_chars % 4 + 1 AS INTEGER))) AS name, n_chars FROM documents)
SELECT source AS folder,
  count(*) FILTER (name NOT LIKE '._%' AND name NOT LIKE '%.txt') AS n_supported,
  count(*) FILTER (name LIKE '._%' OR name LIKE '%.txt') AS n_unsupported,
  count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM listing GROUP BY source""",
)
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported and unsupported files per folder of a listing."""
    from legajo.sources import files as fil

    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".pdf", ".JPG", ".txt", ".csv")]),
        (F.col("n_chars") % 4 + 1).cast("int"),
    )
    hidden = F.when(F.col("lang") == "fr", F.lit("._")).otherwise(F.lit(""))
    listing = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), hidden, "doc_id", suffix).alias("path"),
        F.col("n_chars").alias("length"),
    )
    return fil.folder_counts(listing)
