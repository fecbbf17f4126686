"""Access counters over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import classify as cls
from legajo.operators import consolidate as con
from legajo.operators import report as rep
from legajo.operators import usage as use
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_ORDER, claim_documents, table
from legajo.plans.catalog import register
from legajo.plans.claims_sql import ALL_CELLS, DECIDED


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an access; signups belong to no case."""
    kind = F.col("event_type")
    hit = kind.isin("view", "purchase")

    def one(condition: Column) -> Column:
        return condition.cast("long")

    return table(spark, sf_dir, "events").select(
        F.when(kind != "signup", F.col("user_id").cast("string")).alias("case_id"),
        "ts",
        "event_id",
        one(kind == "view").alias("ocr_hits"),
        one(kind.isin("error", "signup")).alias("ocr_misses"),
        one(kind == "purchase").alias("extract_hits"),
        one(kind == "click").alias("extract_misses"),
        F.when(hit, F.floor("value")).otherwise(0).cast("long").alias("ms_saved"),
        F.when(hit, F.floor(F.col("value") * 1024)).otherwise(0).cast("long").alias("bytes_saved"),
    )


_ACCESSES = """WITH accesses AS (SELECT CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS case_id, ts,
    (event_type = 'view')::BIGINT AS ocr_hits, (event_type IN ('error', 'signup'))::BIGINT AS ocr_misses,
    (event_type = 'purchase')::BIGINT AS extract_hits, (event_type = 'click')::BIGINT AS extract_misses,
    CASE WHEN event_type IN ('view', 'purchase') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS ms_saved,
    CASE WHEN event_type IN ('view', 'purchase') THEN CAST(floor(value * 1024) AS BIGINT) ELSE 0 END AS bytes_saved
  FROM events)
"""


def _sums(condition: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN {condition} THEN {c} END), 0) AS BIGINT) AS {c}"
        for c in use.COUNTERS
    )


@register(
    "access_counters",
    "C10",
    _ACCESSES
    + f"""SELECT 'global' AS scope, {_sums('true')} FROM accesses
UNION ALL SELECT case_id, {_sums('true')} FROM accesses WHERE case_id IS NOT NULL GROUP BY case_id""",
)
def access_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and savings, global and per case."""
    return use.access_counters(_accesses(spark, sf_dir))


@register(
    "counters_after_resets",
    "C12",
    _ACCESSES
    + f""", resets AS (SELECT 'global' AS scope, max(ts) AS reset_at FROM events WHERE event_type = 'error' AND value > 100
  UNION ALL SELECT CAST(user_id AS VARCHAR), max(ts) FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT 'global' AS scope, {_sums("ts > (SELECT reset_at FROM resets WHERE scope = 'global')")} FROM accesses
UNION ALL SELECT case_id, {_sums('true')} FROM accesses LEFT JOIN resets ON scope = case_id
  WHERE case_id IS NOT NULL AND coalesce(ts > reset_at, true) GROUP BY case_id""",
)
def counters_after_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups reset their user's counters, large errors the global ones."""
    events = table(spark, sf_dir, "events")
    by_case = events.filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("scope"), "ts"
    )
    everywhere = events.filter("event_type = 'error' AND value > 100").select(
        F.lit("global").alias("scope"), "ts"
    )
    return use.counters_after_resets(_accesses(spark, sf_dir), by_case.unionByName(everywhere))


@register(
    "latest_gauges",
    "C11",
    """SELECT CAST(user_id AS VARCHAR) AS scope, event_type AS name, arg_max(value, {t: ts, e: event_id}) AS value
FROM events GROUP BY user_id, event_type""",
)
def latest_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauges = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("name"),
        "value", "ts", "event_id",
    )
    return use.latest_gauges(gauges, ["ts", "event_id"])


@register(
    "field_coverage",
    "E25",
    ALL_CELLS + "SELECT field, count(*) AS n_documents FROM cells WHERE value <> '' GROUP BY field",
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a value for each field."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CLAIM_FIELDS])
    return cls.field_coverage(claim_documents(spark, sf_dir).select(F.inline(cells)))


@register(
    "run_metrics",
    "J2",
    DECIDED("class")
    + """, docs_per AS (SELECT case_id, count(*) AS n_documents, count(*) FILTER (l_returnflag <> 'A') AS n_results,
    count(*) FILTER (l_returnflag = 'N') AS n_extracted FROM docs GROUP BY case_id),
filled AS (SELECT case_id, count(value) AS n, count(*) FILTER (n_options > 1) AS k, sum(confidence) AS c FROM decided GROUP BY case_id)
SELECT d.case_id, printf('%.1f%%', round(n_results * 100.0::DOUBLE / n_documents, 1)) AS ocr_success_rate,
  printf('%.1f%%', round(coalesce(n_extracted * 100.0::DOUBLE / nullif(n_results, 0), 0), 1)) AS extraction_success_rate,
  printf('%.1f%%', round(coalesce(n, 0) * 100.0::DOUBLE / 6, 1)) AS fields_completion_rate,
  CAST(coalesce(k, 0) AS INTEGER) AS conflicts_resolved, round(coalesce(c, 0) / 6, 6) AS average_confidence
FROM docs_per d LEFT JOIN filled f ON d.case_id = f.case_id""",
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, completion and confidence of each case run."""
    claims = claim_documents(spark, sf_dir)
    metrics = con.consolidation_metrics(con.consolidate(claims, CLAIM_FIELDS, CLAIM_ORDER))
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("case_id"))
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.count_if(F.col("l_returnflag") != "A").alias("n_results"),
            F.count_if(F.col("l_returnflag") == "N").alias("n_extracted"),
        )
    )
    return rep.run_metrics(metrics.join(counts, "case_id"))


@register(
    "report_statistics",
    "J3",
    """SELECT (SELECT count(*) FROM documents) AS total_reports_generated,
  (SELECT round(sum(n_chars) / (1024.0 * 1024.0), 6) FROM documents) AS storage_used_mb,
  count(*) FILTER (event_type IN ('signup', 'view')) AS currently_processing,
  count(*) FILTER (event_type IN ('click', 'purchase')) AS completed_today,
  count(*) FILTER (event_type = 'error') AS errors_today
FROM (SELECT user_id, arg_max(event_type, {t: ts, e: event_id}) AS event_type FROM events GROUP BY user_id)""",
)
def report_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by their latest status and the stored volume."""
    from legajo.operators.cases import latest_status

    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id",
        F.when(kind.isin("signup", "view"), "processing")
        .when(kind.isin("click", "purchase"), "completed")
        .otherwise("error")
        .alias("status"),
    )
    reports = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_bytes"))
    return rep.report_statistics(latest_status(events, "user_id", ["ts", "event_id"]), reports)
