"""Which events store an entry when entries expire, without walking through a key.

Each entry blocks its key for a while, and the first event behind that stores the next
one: a chain through the events of the key.  Every event gets a successor, the first
event more than the validity later, by one as-of lookup over range pieces.  The chain
from a key's first event is then marked by pointer doubling: tables of the 1st, 2nd,
4th, ... successor, and the marks copied along them from the longest jump down.  A key
with a third of all events is spread like any other; rounds grow with the logarithm of
the chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.operators.scaling import ranged_pieces, running_last, same_keys
from legajo.session import stored


def admitted(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    hours: float = 24,
    last: DataFrame | None = None,
) -> DataFrame:
    """(keys, at) of the events that find no valid entry of their key and store a new one.

    ``last`` has the time of the entry in force, if any, per key (keys, at).  Equal times
    of a key are one event; null keys are keys; null times never store.
    """
    valid = int(hours * 3_600_000_000)
    times = stored(
        events.filter(F.col(at).isNotNull()).select(*keys, F.unix_micros(at).alias("_t")).distinct(),
        "event-times",
    )
    found = stored(_successors(times, keys, valid, last if last is None else last.select(
        *keys, F.unix_micros(at).alias("_t"))), "successors")
    jumps = [_pairs(found.filter("NOT _opening"), keys)]
    while True:
        onward = jumps[-1].select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_t").alias("_key__next"),
            F.col("_next").alias("_far"),
        )
        longer = stored(
            jumps[-1].join(onward, same_keys([*keys, "_next"])).select(
                *keys, "_t", F.col("_far").alias("_next")
            ),
            "jumps",
        )
        if not longer.limit(1).count():
            break
        jumps.append(longer)
    marks = found.filter("_opening AND _next IS NOT NULL").select(*keys, F.col("_next").alias("_t"))
    for jump in reversed(jumps):
        marked = marks.select(
            *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_t").alias("_key__t")
        )
        behind = jump.join(marked, same_keys([*keys, "_t"])).select(*keys, F.col("_next").alias("_t"))
        marks = stored(marks.unionByName(behind), "marks")
    return marks.select(*keys, F.timestamp_micros("_t").alias(at))


def _pairs(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.filter(F.col("_next").isNotNull()).select(*keys, "_t", "_next")


def _successors(
    times: DataFrame, keys: Sequence[str], valid: int, last: DataFrame | None
) -> DataFrame:
    """(keys, _t, _opening, _next): per event, and per key, the first event that may store then.

    Rows lie in falling time, so the last event seen before a question is the earliest
    one later than it; questions go before events of the same time.
    """
    none = F.lit(None).cast("bigint")
    if last is None:
        opening = times.groupBy(*keys).agg((F.min("_t") - 1).alias("_after"))
    else:
        held = last.groupBy(*keys).agg(F.max("_t").alias("_held"))
        first = times.groupBy(*keys).agg(F.min("_t").alias("_first"))
        opening = first.join(
            held.toDF(*[f"_key_{k}" for k in keys], "_held"), same_keys(keys), "left"
        ).select(*keys, F.coalesce(F.col("_held") + valid, F.col("_first") - 1).alias("_after"))
    rows = (
        times.select(*keys, (-F.col("_t")).alias("_r"), F.lit(1).alias("_kind"), "_t", F.lit(False).alias("_opening"))
        .unionByName(
            times.select(
                *keys, (-F.col("_t") - valid).alias("_r"), F.lit(0).alias("_kind"), "_t",
                F.lit(False).alias("_opening"),
            )
        )
        .unionByName(
            opening.select(
                *keys, (-F.col("_after")).alias("_r"), F.lit(0).alias("_kind"), none.alias("_t"),
                F.lit(True).alias("_opening"),
            )
        )
    )
    cut = ranged_pieces(rows, keys, ["_r", "_kind"])
    seen = F.when(F.col("_kind") == 1, F.col("_t"))
    place = ["_r", "_kind", "_opening", "_t"]
    found = running_last(cut, keys, F.col("_piece"), place, {"_next": seen})
    return found.filter("_kind = 0").select(*keys, "_t", "_opening", "_next")
