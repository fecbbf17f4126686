"""Progress of case runs: smoothed stage times, remaining time, elapsed time.

All three follow event order inside a case.  Events are range-partitioned by case
and time, so that a case with a third of all events, or of a day's events, spreads
over many pieces of bounded size; between pieces travels one row per (case, stage,
piece).  The smoothed time is a parallel prefix scan: a finished stage is the affine
map ``x -> keep * x + smoothing * duration``, ``SIDE`` maps make a block, a block is
again one affine map, and so on up; every value is folded from the carry of its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.fixed_values import SMOOTHING, STAGE_SECONDS, STAGES
from legajo.operators.scaling import ranged_pieces, running_last, same_keys
from legajo.session import ensure_checkpoint_dir

KEEP = 1.0 - SMOOTHING
#: Rows of a block and blocks of the block above it.
SIDE = 64
PLACE = ["ts", "event_id"]


def in_pieces(events: DataFrame, piece: Column | None = None) -> DataFrame:
    """The events with ``_piece``: ranges of (case, time), or the given column."""
    if piece is not None:
        return events.withColumn("_piece", piece)
    return ranged_pieces(events, ["case_id"], PLACE, "_piece")


def stage_durations(cut: DataFrame) -> DataFrame:
    """Adds duration_us to 'done' events that have an earlier 'started'.

    Needs case_id, stage, status, ts, a unique event_id and the ``_piece`` of each event.
    """
    at = F.unix_micros("ts")
    started = running_last(
        cut,
        ["case_id", "stage"],
        F.col("_piece"),
        PLACE,
        {"started_us": F.when(F.col("status") == "started", at)},
    )
    return started.withColumn(
        "duration_us",
        F.when(F.col("status") == "done", at - F.col("started_us")).cast("double"),
    ).drop("started_us")


def _folded(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda acc, d: acc * KEEP + d * SMOOTHING)


def block_carries(blocks: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(keys, block, carry): the composed maps of all earlier blocks of the key, applied to 0.

    ``blocks`` has the map x -> a x + b of every block from 0; that of block 0 is
    constant.  ``most`` is the largest number of blocks of a key.
    """
    over = F.expr(f"block div {SIDE}")
    before = Window.partitionBy(*keys, "_over").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = blocks.withColumn("_over", over).withColumn(
        "_held", F.collect_list(F.struct("a", "b")).over(before)  # fewer than SIDE
    )
    start = F.lit(0.0)
    if most > SIDE:
        maps = placed.groupBy(*keys, "_over").agg(
            F.sort_array(F.collect_list(F.struct("block", "a", "b"))).alias("maps")
        )
        above = block_carries(
            maps.select(
                *keys,
                F.col("_over").alias("block"),
                F.aggregate("maps", F.lit(1.0), lambda acc, m: acc * m["a"]).alias("a"),
                F.aggregate("maps", F.lit(0.0), lambda acc, m: acc * m["a"] + m["b"]).alias("b"),
            ),
            keys,
            -(-most // SIDE),
        ).select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("block").alias("_key__over"),
            F.col("carry").alias("_start"),
        )
        placed = placed.join(above, same_keys([*keys, "_over"]))
        start = F.col("_start")
    carry = F.aggregate("_held", start, lambda acc, m: acc * m["a"] + m["b"])
    return placed.select(*keys, "block", carry.alias("carry"))


def smoothed(rows: DataFrame, keys: Sequence[str], value: str, name: str, most: int) -> DataFrame:
    """Adds the running smoothed value along ``_ordinal`` (from 1 in each key).

    ``most`` is the number of rows of the largest key.
    """
    cut = rows.withColumn("_block", F.expr(f"(_ordinal - 1) div {SIDE}"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_ordinal")
    held = cut.withColumn("_held", F.collect_list(value).over(inside))  # SIDE at most
    start = F.col("_held")[0]
    if most > SIDE:
        values = F.transform("at", lambda x: x["value"])
        whole = cut.groupBy(*keys, F.col("_block").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("_ordinal", F.col(value).alias("value")))).alias("at")
        )
        opening = F.col("block") == 0
        blocks = whole.select(
            *keys,
            "block",
            F.when(opening, 0.0).otherwise(F.pow(F.lit(KEEP), F.size("at").cast("double"))).alias("a"),
            _folded(values, F.when(opening, values[0]).otherwise(0.0)).alias("b"),
        )
        carries = block_carries(blocks, keys, -(-most // SIDE)).filter("block > 0").select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("block").alias("_key__block"),
            "carry",
        )
        held = held.join(carries, same_keys([*keys, "_block"]), "left")
        start = F.coalesce("carry", start)
    return held.withColumn(name, _folded(F.col("_held"), start)).select(*rows.columns, name)


def smoothed_times(measured: DataFrame) -> DataFrame:
    """Adds avg_us, the running smoothed duration, to events that finish a stage.

    Needs ``duration_us`` and ``_piece``, and is read several times: give it stored.
    """
    keys = ["case_id", "stage"]
    done = measured.filter(F.col("duration_us").isNotNull())
    counts = done.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy(*keys).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_key_{k}") for k in (*keys, "_piece")],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*PLACE)
    numbered = (
        done.withColumn("_place", F.row_number().over(inside))
        .join(offsets, same_keys([*keys, "_piece"]))
        .withColumn("_ordinal", F.col("_place") + F.col("_before"))
        .select(*measured.columns, "_ordinal")
    )
    averaged = smoothed(numbered, keys, "duration_us", "avg_us", most).drop("_ordinal")
    others = measured.filter(F.col("duration_us").isNull())
    return averaged.unionByName(others.withColumn("avg_us", F.lit(None).cast("double")))


def progress_report(events: DataFrame, piece: Column | None = None) -> DataFrame:
    """Every event with elapsed_ms, avg_stage_ms and eta_ms as they were then."""
    # each step reads its input twice (pieces and rows), so both inputs are
    # written once instead of being computed again per reader
    ensure_checkpoint_dir(events.sparkSession)
    measured = stage_durations(in_pieces(events, piece)).checkpoint()
    averaged = smoothed_times(measured).checkpoint()
    known = {
        f"avg_{s}": F.when(F.col("stage") == s, F.col("avg_us")) for s in STAGES
    }
    # stages outside the list have an average of their own but no place in the order
    with_all = running_last(
        averaged,
        ["case_id"],
        F.col("_piece"),
        PLACE,
        known,
    )
    starts = events.groupBy("case_id").agg(F.min("ts").alias("_start"))
    own = F.lit(None).cast("double")
    for stage in STAGES:
        own = F.when(F.col("stage") == stage, F.col(f"avg_{stage}")).otherwise(own)
    return with_all.join(starts, "case_id").select(
        "case_id",
        "event_id",
        "stage",
        "status",
        "ts",
        F.floor((F.unix_micros("ts") - F.unix_micros("_start")) / 1000).alias("elapsed_ms"),
        F.floor(own / 1000).alias("avg_stage_ms"),
        remaining_ms({s: F.col(f"avg_{s}") for s in STAGES}).alias("eta_ms"),
    )


def remaining_ms(averages_us: dict[str, Column]) -> Column:
    """Milliseconds left: averages or default seconds of the stages still to run."""
    position = F.lit(None).cast("int")
    for index, stage in enumerate(STAGES):
        position = F.when(F.col("stage") == stage, index).otherwise(position)
    first_left = position + F.when(F.col("status") == "done", 1).otherwise(0)
    total = F.lit(0.0)
    for index, stage in enumerate(STAGES):
        seconds = F.coalesce(averages_us[stage], F.lit(STAGE_SECONDS[stage] * 1e6))
        total = total + F.when(first_left <= index, seconds).otherwise(0.0)
    return F.when(position.isNotNull(), F.floor(total / 1000))


def final_averages(events: DataFrame, piece: Column | None = None) -> DataFrame:
    """Smoothed milliseconds per (case, stage) after the last event."""
    ensure_checkpoint_dir(events.sparkSession)
    averaged = smoothed_times(stage_durations(in_pieces(events, piece)).checkpoint())
    return averaged.filter("avg_us IS NOT NULL").groupBy("case_id", "stage").agg(
        F.count(F.lit(1)).alias("n_done"),
        F.floor(F.max_by("avg_us", F.struct("ts", "event_id")) / 1000).alias("avg_ms"),
    )
