"""Streaming document intake, expiring dedupe and live process status."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from legajo.operators.admission import admitted
from legajo.operators.cases import latest_status
from legajo.operators.registry import content_hash
from legajo.sources.files import supported

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows a task adds to those it holds before it looks for copies among them.
HELD_ROWS = 100_000


def arriving_files(
    spark: SparkSession, folder: str, profile: str = "organiser", files_per_trigger: int | None = None
) -> DataFrame:
    """Supported files as they appear, with the hash of their bytes; case = folder."""
    limit = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    files = (
        spark.readStream.format("binaryFile")
        .options(**limit)
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return supported(files, profile).select(
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("case_id"),
        content_hash("content").alias("file_hash"),
        F.col("path").alias("document_id"),
        "length",
        "modificationTime",
    )


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FirstArrival(StatefulProcessor):
    """State of one (case, content): the id it was registered with.  Only the first is passed on."""

    def __init__(self, id_type: T.DataType, ttl_ms: int):
        self.id_type, self.ttl_ms = id_type, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("document_id", self.id_type)])
        self.registered = handle.getValueState("registered", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for part in rows:
            first = part.sort_values("arrived", kind="stable").iloc[:1]
            if best is None or first["arrived"].iloc[0] < best["arrived"].iloc[0]:
                best = first
        if best is None or self.registered.exists():
            return
        self.registered.update((best["document_id"].iloc[0],))
        yield best.drop(columns=["arrived"])

    def close(self) -> None:
        pass


# executors get this module's classes and functions with the job and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def firsts_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each (case, content) of every Arrow batch, so that copies meet as few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("arrived")
        first = table.group_by(["case_id", "file_hash"], use_threads=False).aggregate(
            [("document_id", "first"), ("arrived", "first")]
        )
        named = first.select(["case_id", "file_hash", "document_id_first", "arrived_first"])
        yield from named.rename_columns(batch.schema.names).cast(batch.schema).to_batches()


def firsts_of_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest row of each (case, content) of a partition; holds one row for each."""
    held: list[pa.RecordBatch] = []
    rows = reduced = 0
    for batch in firsts_of_batches(batches):
        held.append(batch)
        rows += batch.num_rows
        if rows > 2 * reduced + HELD_ROWS:
            held = list(firsts_of_batches(one_batch(held)))
            rows = reduced = sum(b.num_rows for b in held)
    yield from firsts_of_batches(one_batch(held))


def one_batch(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else ()


def registrations(
    arrivals: DataFrame, order: str = "document_id", ttl_days: float | None = None
) -> DataFrame:
    """(case_id, file_hash, document_id) of the first arrival of each case and content.

    A keyed state remembers what is registered, in RocksDB on the executors and with the
    changes of a micro-batch in its checkpoint; nothing stored is read again.  Inside a
    micro-batch the earliest row by ``order`` (not null) wins: a partition holds all rows of
    its keys and passes one on, and of those Spark drops the ones known from before.  With
    ``ttl_days`` a registration is forgotten so long after it was made, by a processor of
    our own.  Null case and hash are keys too.
    """
    keys = ["case_id", "file_hash"]
    rows = arrivals.select(*keys, "document_id", F.col(order).alias("arrived"))
    firsts = rows.mapInArrow(firsts_of_batches, rows.schema)
    if ttl_days is None:
        one_each = firsts.repartition(*keys).mapInArrow(firsts_of_partitions, rows.schema)
        return one_each.dropDuplicates(keys).drop("arrived")
    return firsts.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FirstArrival(
            rows.schema["document_id"].dataType, int(ttl_days * 24 * 3600 * 1000)
        ),
        outputStructType=T.StructType([f for f in rows.schema.fields if f.name != "arrived"]),
        outputMode="append",
        timeMode="processingTime",
    )


def register_stream(
    arrivals: DataFrame,
    store: str,
    checkpoint: str,
    order: str = "document_id",
    trigger: dict | None = None,
    ttl_days: float | None = None,
) -> StreamingQuery:
    """Register each (case_id, file_hash) once, whatever is retried or re-sent.

    The file sink's own log lists the files of finished micro-batches, so a replayed batch
    adds nothing.  Read the store with ``spark.read.parquet``.  With ``ttl_days`` the query
    runs on, so it needs a trigger that does not end.
    """
    trigger = trigger or {"availableNow": True}
    if ttl_days is not None and "processingTime" not in trigger:
        raise ValueError("with ttl_days no trigger that ends: give one of processingTime")
    with state_in_rocksdb(arrivals.sparkSession):
        return (
            registrations(arrivals, order, ttl_days)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .option("path", store)
            .trigger(**trigger)
            .start()
        )


def expiring_dedupe(
    events: DataFrame,
    keys: Sequence[str],
    store: str,
    checkpoint: str,
    at: str = "ts",
    hours: float = 24,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write (keys, at) of the events that find no valid entry of their key and store a new one.

    An entry is valid for ``hours`` from the event that stored it; null keys are keys too,
    null times never store.  The events of a key must come in time order from one
    micro-batch to the next, inside one in any order; an event older than the entry in
    force counts as a repeat.

    A micro-batch is admitted as a whole (``operators.admission``), so a hot key is spread.
    Between batches stays a snapshot of the entries that may still be valid.  A batch
    writes its own folder of entries and one of two snapshots, and reads the other: run
    again, it overwrites the same.
    """
    schema = events.select(*keys, at).schema

    def admit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = None
        if batch_id:
            before = session.read.schema(schema).parquet(f"{checkpoint}/entries/{(batch_id - 1) % 2}")
        folder = f"{store}/batch={batch_id}"
        admitted(batch, keys, at, hours, before).write.mode("overwrite").parquet(folder)
        fresh = session.read.schema(schema).parquet(folder)
        both = fresh if before is None else fresh.unionByName(before)
        newest = batch.agg(F.max(at)).first()[0]
        latest = both.groupBy(*keys).agg(F.max(at).alias(at))
        if newest is not None:  # later events are not older than this
            latest = latest.filter(F.col(at) >= F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS"))
        latest.write.mode("overwrite").parquet(f"{checkpoint}/entries/{batch_id % 2}")

    return (
        events.select(*keys, at)
        .writeStream.foreachBatch(admit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_entries(spark: SparkSession, store: str, schema: T.StructType | str) -> DataFrame:
    """The entries written so far."""
    return spark.read.schema(schema).parquet(f"{store}/batch=*")


def live_status(states: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest state per process, for output mode 'update'."""
    return latest_status(states, key, order)
