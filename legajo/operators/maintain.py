"""Store maintenance: orphans, purges and store statistics."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_index_rows(index: DataFrame, cases: DataFrame) -> DataFrame:
    """Index rows whose case no longer exists."""
    return index.join(cases.select("case_id").distinct(), "case_id", "left_anti")


def orphan_folders(folders: DataFrame, cases: DataFrame) -> DataFrame:
    """Folders that contain no known case id anywhere in their name.

    Only names with '-' outside the index count.  Instead of testing every
    folder against every case, the parts of a name that have the length of some
    id are joined to the ids.
    """
    named = folders.filter((F.col("folder") != "case_index") & F.col("folder").contains("-"))
    known_ids = cases.select("case_id").filter("case_id <> ''").distinct()
    # one row: the few lengths ids have
    lengths = known_ids.agg(F.collect_set(F.length("case_id")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("folder"))
    parts = F.flatten(
        F.transform(
            fitting,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("folder") - n + 1),
                lambda start: F.substring(F.col("folder"), start, n),
            ),
        )
    )
    tokens = named.crossJoin(F.broadcast(lengths)).select(
        "folder", F.explode(F.array_distinct(parts)).alias("case_id")
    )
    known = tokens.join(known_ids, "case_id", "left_semi")
    return named.join(known.select("folder").distinct(), "folder", "left_anti")


def purge_cases(table: DataFrame, purged: DataFrame | None) -> DataFrame:
    """Rows that stay after purging the listed cases; None purges everything."""
    if purged is None:
        return table.limit(0)
    return table.join(purged.select("case_id").distinct(), "case_id", "left_anti")


def store_statistics(index: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """Cases (the larger of two counts), files and MiB of the store."""
    by_index = index.agg(F.count(F.lit(1)).alias("n_index"))
    named = (F.length("folder") > 2) & (F.col("folder") != "case_index") & F.col(
        "folder"
    ).contains("-")
    by_folder = folders.agg(F.count_if(named).alias("n_folders"))
    by_file = files.agg(
        F.count(F.lit(1)).alias("total_cached_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_bytes"),
    )
    # three one-row sides
    return (
        by_index.crossJoin(F.broadcast(by_folder))
        .crossJoin(F.broadcast(by_file))
        .select(
            F.greatest("n_index", "n_folders").alias("total_cases"),
            "total_cached_files",
            F.round(F.col("_bytes") / (1024.0 * 1024.0), 2).alias("cache_size_mb"),
        )
    )


def store_dashboard(
    listing: DataFrame, statistics: DataFrame, newest: int | None = None, title: int | None = None
) -> DataFrame:
    """Store totals, mean documents per case and the cases, newest first, as rows.

    ``newest`` limits the cases and ``title`` the characters of their titles.
    """
    totals = listing.agg(F.round(F.avg("document_count"), 1).alias("mean_documents"))
    facts = statistics.crossJoin(F.broadcast(totals)).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("number"))
                    for n in (
                        "total_cases", "total_cached_files", "cache_size_mb", "mean_documents"
                    )
                ]
            )
        )
    )
    ordered = listing.orderBy(F.desc("processed_at"), "case_id")
    shown = F.col("title") if title is None else F.substring("title", 1, title)
    recent = (ordered if newest is None else ordered.limit(newest)).select(
        F.concat(F.lit("case "), "case_id", F.lit(": "), shown).alias("item"),
        F.col("document_count").cast("double").alias("number"),
    )
    return facts.unionByName(recent)
