"""Streams over several micro-batches against their batch forms."""

import json
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from legajo.operators import admission
from legajo.operators import progress as prg
from legajo.operators.scaling import ranged_pieces
from legajo.plans.stream_queries import streamed_registrations
from legajo.schemas import PROGRESS_EVENTS
from legajo.streaming import intake
from legajo.streaming import progress as live
from test_scaling import SCHEMA, _random_events

COLUMNS = ["event_id", "elapsed_ms", "avg_stage_ms", "eta_ms"]


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = sorted(
        (r for r in _random_events(600, 4, 3) if r[2] != "otra"), key=lambda r: (r[4], r[1])
    )
    source = tmp_path / "in"
    source.mkdir()
    for start in range(0, len(rows), 200):
        lines = [
            json.dumps({"case_id": c, "event_id": i, "stage": s, "status": t, "ts": a.isoformat()})
            for c, i, s, t, a in rows[start:start + 200]
        ]
        (source / f"{start:04d}.json").write_text("\n".join(lines))
    events = live.read_event_log(spark, str(source), PROGRESS_EVENTS, files_per_trigger=1)
    report = live.stream_report(events)
    live.write_log(report, str(tmp_path / "out"), str(tmp_path / "cp"), every=None).awaitTermination()
    got = spark.read.schema(live.REPORT).json(str(tmp_path / "out")).select(*COLUMNS).collect()
    batch = prg.progress_report(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_registration_is_idempotent_across_batches(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    batches = [[("c", "h1", 1), ("c", "h1", 2)], [("c", "h1", 3), ("c", "h2", 4), ("d", "h1", 5)]]
    schema = "case_id STRING, file_hash STRING, document_id BIGINT"
    for n, rows in enumerate(batches):
        staged = tmp_path / f"s{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(staged))
        part = next(staged.glob("part-*.parquet"))
        shutil.copy(part, source / f"{n}.parquet")
        arrivals = spark.readStream.schema(schema).parquet(str(source))
        intake.register_stream(arrivals, store, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(store).select("case_id", "file_hash", "document_id").collect()
    assert sorted(map(tuple, got)) == [("c", "h1", 1), ("c", "h2", 4), ("d", "h1", 5)]


def test_files_stream_in_with_their_hash(spark, tmp_path):
    folder = tmp_path / "in" / "CASE-1"
    folder.mkdir(parents=True)
    for name, body in (("a.pdf", b"x"), ("b.pdf", b"x"), ("c.txt", b"y")):
        (folder / name).write_bytes(body)
    arrivals = intake.arriving_files(spark, str(tmp_path / "in"))
    store = str(tmp_path / "store")
    intake.register_stream(arrivals, store, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert [(r.case_id, r.document_id.rsplit("/", 1)[1]) for r in rows] == [("CASE-1", "a.pdf")]


def test_registrations_in_any_layout(spark, tmp_path):
    """One file to a micro-batch, or all at once: the same registrations, null keys too."""
    rows = [("c", f"h{i % 7}", i) for i in range(60)] + [(None, "h1", 61), (None, "h1", 62), ("c", None, 63)]
    schema = "case_id STRING, file_hash STRING, document_id BIGINT"
    for n in range(0, len(rows), 21):
        part = spark.createDataFrame(rows[n:n + 21], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in" / f"{n:03d}"))
    results = []
    for per_batch in (1, 10):
        arrivals = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", per_batch)
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        store = str(tmp_path / f"store{per_batch}")
        intake.register_stream(arrivals, store, str(tmp_path / f"cp{per_batch}")).awaitTermination()
        found = spark.read.parquet(store).select("case_id", "file_hash", "document_id").collect()
        results.append(sorted(map(tuple, found), key=str))
    want = [("c", f"h{i}", i) for i in range(7)] + [(None, "h1", 61), ("c", None, 63)]
    assert results == [sorted(want, key=str)] * 2
    state = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" not in spark.conf.get(state)  # the session keeps its own setting


def test_table_streams_from_a_folder_of_files(spark, tmp_path):
    """A table may be one file or a folder of files."""
    rows = [(i, f"text {i % 5}", f"case {i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = streamed_registrations(spark, str(tmp_path)).select("case_id", "document_id").collect()
    assert sorted(map(tuple, got)) == sorted((f"case {i % 2}", i) for i in range(10))


def test_registrations_expire(spark, tmp_path):
    """A registration older than its time to live is made again."""
    schema = "case_id STRING, file_hash STRING, document_id BIGINT"
    source, store = str(tmp_path / "in"), tmp_path / "store"

    def arrive(n):
        spark.createDataFrame([("c", "h", n)], schema).coalesce(1).write.mode("append").parquet(f"{source}/{n}")

    def registered(n):
        end = time.time() + 60
        while time.time() < end:
            if list(store.glob("*.parquet")):
                found = [r["document_id"] for r in spark.read.schema(schema).parquet(str(store)).collect()]
                if len(found) >= n:
                    return sorted(found)
            time.sleep(0.5)
        return None

    arrive(0)
    arrivals = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    with pytest.raises(ValueError, match="ends"):
        intake.register_stream(arrivals, str(store), str(tmp_path / "cp"), ttl_days=1)
    query = intake.register_stream(
        arrivals, str(store), str(tmp_path / "cp"), trigger={"processingTime": "1 second"},
        ttl_days=1 / 86_400,
    )
    try:
        assert registered(1) == [0]
        time.sleep(2)
        arrive(1)
        assert registered(2) == [0, 1]
    finally:
        query.stop()


def test_admission_chain_of_a_hot_key(spark):
    """Two thirds of the events in one key, against a walk; the hot key lies in many pieces."""
    rng = random.Random(4)
    rows = [("hot", rng.randrange(10**9)) for _ in range(4000)]
    rows += [(f"k{rng.randrange(30)}", rng.randrange(10**9)) for _ in range(2000)]
    rows += [(None, t) for t in (5, 5, 10**8, 3 * 10**8)] + [("empty", None)]
    frame = spark.createDataFrame(rows, "k STRING, s BIGINT").select(
        "k", F.timestamp_micros(F.col("s") * 1000).alias("ts")
    )
    for last in (None, {"hot": 3 * 10**8, "k1": 10**12, "elsewhere": 5}):
        held = None if last is None else spark.createDataFrame(
            list(last.items()), "k STRING, s BIGINT"
        ).select("k", F.timestamp_micros(F.col("s") * 1000).alias("ts"))
        hours = 1 / 3.6  # a million milliseconds
        got = admission.admitted(frame, ["k"], "ts", hours, held)
        got = sorted(((r[0], r[1]) for r in got.select("k", F.unix_millis("ts")).collect()), key=str)
        want, entry = [], dict(last or {})
        for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
            if k not in entry or t > entry[k] + 10**6:
                want.append((k, t))
                entry[k] = t
        assert got == sorted(want, key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ranged_pieces(frame, ["k"], ["ts"])
        most = cut.groupBy("k", "_piece").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most <= 2 * len(rows) / 8


def test_live_status_keeps_the_latest(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "k STRING, status STRING, o INT")
    assert intake.live_status(rows, "k", ["o"]).select(F.col("status")).first().status == "b"
