"""Which ranges hold a point, as an equi-join that no long or open range blows up.

Days are numbered from a fixed first day.  A range is cut into blocks whose length and
place are powers of two, two of a length at most; a point lies in one block of every
length.  A point and a range that holds it share exactly one block, so the join on
(key, length, block) finds every pair once.  Both sides grow by a factor that depends on
the number of days only, and points of a busy key spread over blocks by their day.

A key of few ranges needs no blocks: its ranges lie in one array beside each point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.operators.scaling import same_keys

#: Days are numbered from here, up to 2^LEVELS; dates beyond count as open ends.
FIRST_DAY, LEVELS = "1600-01-01", 19
#: Ranges of a key that are held in one array.
FEW = 16


def day_number(at: Column) -> Column:
    return F.date_diff(at, F.lit(FIRST_DAY).cast("date"))


def day_ends(start: Column, end: Column) -> tuple[Column, Column]:
    """The numbers of the first and last day of a range; null is an open end."""
    last = (1 << LEVELS) - 1
    return (
        F.greatest(F.coalesce(day_number(start), F.lit(0)), F.lit(0)),
        F.least(F.coalesce(day_number(end), F.lit(last)), F.lit(last)),
    )


def range_blocks(start: Column, end: Column) -> Column:
    """The blocks (level, block) of the days from start to end; null is an open end."""
    low, high = day_ends(start, end)
    blocks = F.array().cast("array<struct<level:int,block:int>>")

    def step(held: Column, level: Column) -> Column:
        low, high = held["low"], held["high"]
        odd_low = (low < high) & (low % 2 == 1)
        after = low + odd_low.cast("int")
        odd_high = (after < high) & (high % 2 == 1)
        before = high - odd_high.cast("int")

        def block(at: Column) -> Column:
            return F.array(F.struct(level.alias("level"), at.cast("int").alias("block")))

        return F.struct(
            F.shiftright(after, 1).alias("low"),
            F.shiftright(before, 1).alias("high"),
            F.concat(
                held["blocks"],
                F.when(odd_low, block(low)).otherwise(blocks),
                F.when(odd_high, block(before)).otherwise(blocks),
            ).alias("blocks"),
        )

    first = F.struct(
        low.cast("int").alias("low"), (high + 1).cast("int").alias("high"), blocks.alias("blocks")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), first, step)["blocks"]


def covering_counts(
    points: DataFrame,
    ranges: DataFrame,
    point_id: str,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
) -> DataFrame:
    """The points (unique id) with ``n_covering``: the ranges of their key that hold their day.

    Ranges include both ends; a null end is open, a range that ends before it starts
    holds nothing.  A point without a day is in no range.
    """
    names = [f"_key_{k}" for k in keys]
    low, high = day_ends(F.col(start), F.col(end))
    named = ranges.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], start, end)
    counts = named.groupBy(*names).agg(F.count(F.lit(1)).alias("_ranges"))
    few = counts.filter(F.col("_ranges") <= FEW).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
    )
    day = day_number(F.col(at))
    held = (
        named.join(few, same_keys(keys))
        .groupBy(*names)
        .agg(F.collect_list(F.struct(low.alias("low"), high.alias("high"))).alias("_held"))
    )
    covering = F.filter("_held", lambda r: day.between(r["low"], r["high"]))
    n_held = F.when(F.col("_held").isNotNull(), F.size(covering)).otherwise(0).cast("bigint")
    counted = points.join(held, same_keys(keys), "left").select(
        *points.columns, n_held.alias("n_covering")
    )
    many = counts.filter(F.col("_ranges") > FEW)
    if many.isEmpty():
        return counted
    many_keys = many.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)])
    blocks = (
        named.join(many_keys, same_keys(keys), "left_semi")
        .select(*names, F.explode(range_blocks(F.col(start), F.col(end))).alias("_at"))
        .select(
            *names, F.col("_at.level").alias("_key__level"), F.col("_at.block").alias("_key__block")
        )
    )
    placed = (
        points.join(many.drop("_ranges"), same_keys(keys), "left_semi")
        .filter(day.between(0, (1 << LEVELS) - 1))
        .select(
            F.col(point_id).alias("_point"), *keys, day.alias("_day"),
            F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level"),
        )
        .withColumn("_block", F.expr("shiftright(_day, _level)"))
    )
    found = (
        placed.join(blocks, same_keys([*keys, "_level", "_block"]))
        .groupBy("_point")
        .agg(F.count(F.lit(1)).alias("_in_blocks"))
    )
    return counted.join(found, F.col(point_id) == F.col("_point"), "left").select(
        *points.columns, F.coalesce("_in_blocks", "n_covering").alias("n_covering")
    )
