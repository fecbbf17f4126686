"""Counters of store accesses per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["ocr_hits", "ocr_misses", "extract_hits", "extract_misses", "ms_saved", "bytes_saved"]


def access_counters(accesses: DataFrame, since: Column | None = None) -> DataFrame:
    """Counters for 'global' and for each case; a null case counts only globally.

    ``accesses``: case_id and one long column per counter.
    """
    rows = accesses.filter(since) if since is not None else accesses
    grouped = rows.groupingSets([["case_id"], []], "case_id").agg(
        F.grouping("case_id").alias("_all"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
    return grouped.filter("_all = 1 OR case_id IS NOT NULL").select(
        F.when(F.col("_all") == 1, F.lit("global")).otherwise(F.col("case_id")).alias("scope"),
        *COUNTERS,
    )


def counters_after_resets(accesses: DataFrame, resets: DataFrame, at: str = "ts") -> DataFrame:
    """Counters of accesses after the last reset of each scope.

    ``resets``: scope and the time column.  A reset case without later access
    has no row; a reset global row shows zeros.
    """
    last = resets.groupBy("scope").agg(F.max(at).alias("_reset"))
    everywhere = last.filter("scope = 'global'").agg(F.max("_reset").alias("_global_reset"))
    by_case = last.filter("scope <> 'global'").select(
        F.col("scope").alias("case_id"), F.col("_reset").alias("_case_reset")
    )
    # one-row side; the per-case resets join by key
    marked = accesses.crossJoin(F.broadcast(everywhere)).join(by_case, "case_id", "left")
    in_global = F.coalesce(F.col(at) > F.col("_global_reset"), F.lit(True))
    in_case = F.coalesce(F.col(at) > F.col("_case_reset"), F.lit(True))
    grouped = marked.groupingSets([["case_id"], []], "case_id").agg(
        F.grouping("case_id").alias("_all"),
        F.count_if(in_case).alias("_later"),
        *[
            F.struct(
                F.coalesce(F.sum(F.when(in_global, F.col(c))), F.lit(0)).alias("all"),
                F.coalesce(F.sum(F.when(in_case, F.col(c))), F.lit(0)).alias("case"),
            ).alias(c)
            for c in COUNTERS
        ],
    )
    whole = F.col("_all") == 1
    return grouped.filter(whole | (F.col("case_id").isNotNull() & (F.col("_later") > 0))).select(
        F.when(whole, F.lit("global")).otherwise(F.col("case_id")).alias("scope"),
        *[F.when(whole, F.col(f"{c}.all")).otherwise(F.col(f"{c}.case")).alias(c) for c in COUNTERS],
    )


def latest_gauges(gauges: DataFrame, order: list[str]) -> DataFrame:
    """Timing gauges: the last value of each (scope, name) stands."""
    return gauges.groupBy("scope", "name").agg(
        F.max_by("value", F.struct(*order)).alias("value")
    )
