"""Progress over the events table: users are cases, event types are stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.fixed_values import STAGE_SECONDS, STAGES
from legajo.functions.text import lookup
from legajo.operators import progress as prg
from legajo.plans.bindings import table
from legajo.plans.catalog import register

# fixed values: stage of each event type, status of each event_id % 3
EVENT_STAGES = {
    "signup": "upload", "view": "ocr", "click": "extract", "purchase": "consolidate",
    "error": "analyze",
}
EVENT_STATUSES = ["started", "running", "done"]


def event_status() -> Column:
    return F.element_at(
        F.array(*[F.lit(s) for s in EVENT_STATUSES]), (F.col("event_id") % 3 + 1).cast("int")
    )


def progress_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("case_id"),
        "event_id",
        lookup(EVENT_STAGES, "event_type").alias("stage"),
        event_status().alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


_EVENTS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'extract'
      WHEN 'purchase' THEN 'consolidate' ELSE 'analyze' END AS stage,
    CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'running' ELSE 'done' END AS status FROM events),
paired AS (SELECT *, max(CASE WHEN status = 'started' THEN ts END) OVER (PARTITION BY case_id, stage
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started_at FROM e),
measured AS (SELECT *, CASE WHEN status = 'done' THEN CAST(epoch_us(ts) - epoch_us(started_at) AS DOUBLE) END AS d FROM paired),
running AS (SELECT *, list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY case_id, stage ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS ds FROM measured),
averaged AS (SELECT *, CASE WHEN len(ds) > 0 THEN
    list_reduce(ds, lambda acc, x: 0.25::DOUBLE * x + 0.75::DOUBLE * acc) END AS avg_us FROM running)
"""


@register(
    "stage_averages",
    "K1",
    _EVENTS
    + """SELECT case_id, stage, count(d) AS n_done, CAST(floor(arg_max(avg_us, {t: ts, e: event_id}) / 1000) AS BIGINT) AS avg_ms
FROM averaged GROUP BY case_id, stage HAVING count(d) > 0""",
)
def stage_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed time of each stage of each case."""
    return prg.final_averages(progress_events(table(spark, sf_dir, "events")))


_LAST = ", ".join(
    f"last_value(CASE WHEN stage = '{s}' THEN avg_us END IGNORE NULLS) OVER w AS avg_{s}"
    for s in STAGES
)
_ETA = " + ".join(
    f"CASE WHEN {i} >= place + CASE WHEN status = 'done' THEN 1 ELSE 0 END "
    f"THEN coalesce(avg_{s}, {STAGE_SECONDS[s]}000000.0::DOUBLE) ELSE 0 END"
    for i, s in enumerate(STAGES)
)


@register(
    "progress_report",
    "K1 K2 K3",
    _EVENTS
    + f""", known AS (SELECT *, {_LAST}, min(ts) OVER (PARTITION BY case_id) AS start,
    CASE stage {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES))} END AS place
  FROM averaged WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT case_id, event_id, stage, status, (epoch_us(ts) - epoch_us(start)) // 1000 AS elapsed_ms,
  CAST(floor(avg_us / 1000) AS BIGINT) AS avg_stage_ms, CAST(floor(({_ETA}) / 1000) AS BIGINT) AS eta_ms
FROM known""",
)
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with elapsed, smoothed and remaining time as of then."""
    return prg.progress_report(progress_events(table(spark, sf_dir, "events"))).drop("ts")
