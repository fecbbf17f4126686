"""Numbering and as-of lookups that stay balanced when one key is huge.

A plain ``row_number().over(partitionBy(key))`` sends a whole key to one task.
The helpers here cut a key into ordered pieces, work inside each piece, and
carry a small summary (one row per piece) from piece to piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import ensure_checkpoint_dir, stored


def same_keys(keys: Sequence[str]) -> Column:
    """Each key equals the column ``_key_`` and its name; null keys are a group too."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return same


def beside_fields(rows: DataFrame, per_field: DataFrame, values: Sequence[str]) -> DataFrame:
    """The rows that have a row of ``per_field`` of their case and field, with its values.

    ``per_field`` holds at most one row per (case_id, field); they go into one map per case,
    an entry per field.  So the join is on the case, and rows dealt by case stay in place.
    """
    entries = F.collect_list(F.struct("field", F.struct(*values)))
    cases = (
        per_field.filter("field IS NOT NULL")
        .groupBy("case_id")
        .agg(F.map_from_entries(entries).alias("_by_field"))
    )
    found = rows.join(cases, "case_id").withColumn(
        "_beside", F.element_at("_by_field", F.col("field"))
    )
    return found.filter("_beside IS NOT NULL").select(*rows.columns, "_beside.*")


def ranged_pieces(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "_piece"
) -> DataFrame:
    """The rows range-partitioned on (group, order), with the number of their range.

    A hot group spreads over many ranges, each of a bounded share of all rows.  Ranges of
    a group follow its order.  The rows are checkpointed, so that every use sees the
    same cuts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*groups, *order).withColumn(name, F.spark_partition_id()).checkpoint()
    )


def dense_ordinals(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row in its group, by the given (unique) order.

    Rows are range-partitioned on (group, order), so a hot group spreads over
    many partitions.  Position = place inside the partition + rows of the group
    in earlier partitions; the second part needs one row per (group, partition).
    The ranged rows are checkpointed because both uses must see the same cuts.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*groups, *order]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
        .checkpoint()
    )
    pieces = ranged.groupBy(*groups, "_piece").agg(
        F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        *[F.col(g).alias(f"_key_{g}") for g in groups],
        F.col("_piece").alias("_key_piece"),
        "_start",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    same_piece = F.col("_piece") == F.col("_key_piece")
    for group in groups:
        same_piece = same_piece & F.col(group).eqNullSafe(F.col(f"_key_{group}"))
    return (
        ranged.join(offsets, same_piece)
        .withColumn(name, F.col("_row") - F.col("_start") + F.col("_before") + 1)
        .select(*df.columns, name)
    )


def ordinals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str = "ordinal",
    together: int = 100_000,
) -> DataFrame:
    """As ``dense_ordinals``, but groups of up to ``together`` rows are numbered where they lie.

    Rows dealt by group already are not shuffled again; only larger groups are ranged.
    """
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    large = stored(
        sizes.filter(F.col("_rows") > together).select(
            *[F.col(g).alias(f"_key_{g}") for g in groups]
        ),
        "large-groups",
    )
    in_order = Window.partitionBy(*groups).orderBy(*order)
    number = F.row_number().over(in_order).cast("bigint")
    if large.isEmpty():
        return df.withColumn(name, number)
    small = df.join(large, same_keys(groups), "left_anti").withColumn(name, number)
    ranged = dense_ordinals(df.join(large, same_keys(groups), "left_semi"), groups, order, name)
    return small.unionByName(ranged)


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Latest non-null value of each expression at or before every row of its key.

    The key is cut by ``bucket`` (monotone in ``order``).  One row per bucket
    carries its last values forward; rows then look only inside their bucket.
    """
    cut = df.withColumn("_bucket", bucket)
    for name, expression in values.items():
        cut = cut.withColumn(f"_in_{name}", expression)
    place = F.struct(*order)
    ends = cut.groupBy(*keys, "_bucket").agg(
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_end_{n}")
            for n in values
        ]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = ends.select(
        *keys,
        "_bucket",
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    named = carries.select(
        *[F.col(k).alias(f"_key_{k}") for k in (*keys, "_bucket")],
        *[f"_carry_{n}" for n in values],
    )
    result = cut.join(named, same_keys([*keys, "_bucket"]))
    for name in values:
        result = result.withColumn(
            name,
            F.coalesce(
                F.last(f"_in_{name}", ignorenulls=True).over(inside), F.col(f"_carry_{name}")
            ),
        )
    return result.select(*df.columns, *values)
