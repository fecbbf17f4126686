"""Live progress: the batch report of ``operators.progress`` on an event stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from legajo.fixed_values import SMOOTHING, STAGE_SECONDS, STAGES

REPORT = (
    "case_id STRING, event_id BIGINT, stage STRING, status STRING, elapsed_ms BIGINT, "
    "avg_stage_ms BIGINT, eta_ms BIGINT"
)
COLUMNS = [column.split()[0] for column in REPORT.split(", ")]
# first event, then last start and average of every stage; constant size per case
STATE = "first_us BIGINT, started MAP<STRING, BIGINT>, averages MAP<STRING, DOUBLE>"
DEFAULTS_US = {stage: seconds * 1e6 for stage, seconds in STAGE_SECONDS.items()}


def _remaining_ms(stage: str, status: str, averages: dict[str, float]) -> int | None:
    if stage not in STAGES:
        return None
    left = STAGES[STAGES.index(stage) + (status == "done"):]
    return int(sum(averages.get(s, DEFAULTS_US[s]) for s in left) // 1000)


def _report_case(
    key: tuple[str], pieces: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(pieces)).sort_values(["at_us", "event_id"])
    if state.exists:
        first, started, averages = state.get
        started, averages = dict(started), dict(averages)
    else:
        first, started, averages = int(rows["at_us"].iloc[0]), {}, {}
    report = []
    for event, stage, status, at in zip(
        rows["event_id"], rows["stage"], rows["status"], rows["at_us"]
    ):
        if status == "started":
            started[stage] = int(at)
        elif status == "done" and stage in started:
            taken = float(at - started[stage])
            before = averages.get(stage, taken)
            averages[stage] = SMOOTHING * taken + (1 - SMOOTHING) * before
        average = averages.get(stage)
        report.append(
            (
                key[0], event, stage, status, int((at - first) // 1000),
                None if average is None else int(average // 1000),
                _remaining_ms(stage, status, averages),
            )
        )
    state.update((first, started, averages))
    if idle_ms is not None:
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(watermark, int(rows["at_us"].iloc[-1]) // 1000) + idle_ms)
    table = pd.DataFrame(report, columns=COLUMNS)
    yield table.astype({"elapsed_ms": "Int64", "avg_stage_ms": "Int64", "eta_ms": "Int64"})


# executors get this module's functions with the job and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_report(
    events: DataFrame, idle_days: float | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Report rows of a stream of events (case_id, event_id, stage, status, ts).

    Every row is reported and every case keeps its state, which has a constant
    size.  With ``idle_days`` a case without events for so long leaves the state,
    which takes a watermark: rows later than ``lateness`` are then dropped.

    Rows of a case are ordered inside a micro-batch; its size, and with it what
    one case can hold in memory, is set by the source (maxFilesPerTrigger).
    """
    idle_ms = None if idle_days is None else int(idle_days * 24 * 3600 * 1000)

    def report(key, pieces, state):
        return _report_case(key, pieces, state, idle_ms)

    marked = events if idle_ms is None else events.withWatermark("ts", lateness)
    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return (
        marked.withColumn("at_us", F.unix_micros("ts"))
        .groupBy("case_id")
        .applyInPandasWithState(report, REPORT, STATE, "append", timeout)
    )


# --- log source and sink -----------------------------------------------------------------
def read_event_log(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """Tail a folder of JSON lines; the checkpoint remembers what was read."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def write_log(
    report: DataFrame, folder: str, checkpoint: str, every: str | None = "500 milliseconds"
) -> StreamingQuery:
    """Append report rows as JSON lines; ``every=None`` drains the source once."""
    writer = (
        report.writeStream.format("json")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", folder)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
