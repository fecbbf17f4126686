"""Skew-safe helpers against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from legajo.operators import progress as prg
from legajo.operators import requests
from legajo.operators.organise import resolve_collisions
from legajo.operators.registry import expiring_lookup
from legajo.operators.scaling import dense_ordinals, running_last
from legajo.plans import consolidation_queries, extraction_queries, finding_queries

START = datetime(2024, 1, 1)


def test_dense_ordinals_split_a_hot_group(spark):
    rows = [("hot", i * 7919 % 5000) for i in range(5000)]
    rows += [(f"k{i % 97}", i) for i in range(1000)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(rows, "g STRING, o INT").repartition(8)
    got = dense_ordinals(frame, ["g"], ["o"]).collect()
    assert len(got) == len(rows)
    expected = {}
    for key in {g for g, _ in rows}:
        for place, value in enumerate(sorted(o for g, o in rows if g == key), 1):
            expected[(key, value)] = place
    assert {(r.g, r.o): r.ordinal for r in got} == expected


def test_dense_ordinals_spread_the_hot_group(spark):
    frame = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    placed = dense_ordinals(frame, ["g"], ["o"])
    assert placed.agg(F.max("ordinal")).first()[0] == 20000


def _random_events(n, users, days):
    picker = random.Random(7)
    rows = []
    for i in range(n):
        user = "hot" if picker.random() < 0.6 else f"u{picker.randrange(users)}"
        at = START + timedelta(seconds=picker.randrange(days * 86400))
        stage = picker.choice(["upload", "ocr", "extract", "otra"])
        status = picker.choice(["started", "running", "done", "done"])
        rows.append((user, i, stage, status, at))
    return rows


SCHEMA = "case_id STRING, event_id BIGINT, stage STRING, status STRING, ts TIMESTAMP"


def test_running_last_matches_scan(spark):
    rows = _random_events(3000, 20, 10)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = running_last(
        frame, ["case_id"], F.to_date("ts"), ["ts", "event_id"],
        {"last": F.when(F.col("status") == "started", F.col("event_id"))},
    ).collect()
    last, expected = {}, {}
    for user, i, _, status, at in sorted(rows, key=lambda r: (r[4], r[1])):
        if status == "started":
            last[user] = i
        expected[i] = last.get(user)
    assert {r.event_id: r.last for r in got} == expected


def row_model(rows):
    """Sequential model of the progress report."""
    defaults = {"upload": 2, "ocr": 15, "extract": 10, "consolidate": 5, "analyze": 8, "report": 5}
    stages = list(defaults)
    first, started, averages, out = {}, {}, {}, {}
    for user, i, stage, status, at in sorted(rows, key=lambda r: (r[4], r[1])):
        us = (at - START) // timedelta(microseconds=1)
        first.setdefault(user, us)
        if status == "started":
            started[user, stage] = us
        elif status == "done" and (user, stage) in started:
            taken = us - started[user, stage]
            before = averages.get((user, stage))
            averages[user, stage] = taken if before is None else 0.25 * taken + 0.75 * before
        average = averages.get((user, stage)) if stage in stages else None
        eta = None
        if stage in stages:
            left = stages[stages.index(stage) + (status == "done"):]
            eta = sum(averages.get((user, s), defaults[s] * 1e6) for s in left) / 1000
        out[i] = ((us - first[user]) // 1000, average, eta)
    return out


def test_progress_matches_row_model(spark):
    rows = _random_events(4000, 10, 12)
    got = prg.progress_report(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = row_model(rows)
    assert len(got) == len(rows)
    for row in got:
        elapsed, average, eta = expected[row.event_id]
        assert row.elapsed_ms == elapsed
        assert (row.avg_stage_ms is None) == (average is None)
        if average is not None:
            assert row.avg_stage_ms == pytest.approx(average / 1000, abs=1.01)
        if eta is None:
            assert row.eta_ms is None
        else:
            assert row.eta_ms == pytest.approx(eta, abs=1.01)


def test_smoothing_of_two_four_eight(spark):
    rows = []
    at, i = START, 0
    for seconds in (2, 4, 8):
        rows.append(("c", i, "ocr", "started", at))
        at += timedelta(seconds=seconds)
        rows.append(("c", i + 1, "ocr", "done", at))
        i += 2
    got = prg.final_averages(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.avg_ms == 3875 and got.n_done == 3


def test_smoothing_longer_than_the_frame(spark):
    rows, at, expected = [], START, None
    for i in range(700):
        rows.append(("c", 2 * i, "ocr", "started", at))
        seconds = 1 + i * 37 % 11
        at += timedelta(seconds=seconds)
        rows.append(("c", 2 * i + 1, "ocr", "done", at))
        expected = seconds if expected is None else 0.25 * seconds + 0.75 * expected
    got = prg.final_averages(spark.createDataFrame(rows, SCHEMA), F.lit("one piece")).first()
    assert got.avg_ms == pytest.approx(expected * 1000, abs=1.01)


@pytest.mark.parametrize("side", [2, 4, 64])
def test_scan_over_several_levels_of_blocks(spark, monkeypatch, side):
    monkeypatch.setattr(prg, "SIDE", side)
    picker = random.Random(11)
    rows, expected = [], {}
    for case, n in (("a", 300), ("b", 65), ("c", 1), (None, 5)):
        average = None
        for i in range(n):
            d = float(picker.randrange(10**9))
            average = d if average is None else average * 0.75 + d * 0.25
            rows.append((case, i + 1, d))
            expected[case, i + 1] = average
    frame = spark.createDataFrame(rows, "k STRING, _ordinal BIGINT, d DOUBLE").repartition(5)
    got = prg.smoothed(frame, ["k"], "d", "avg", 300).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.avg == pytest.approx(expected[row.k, row._ordinal], rel=1e-13)


def test_busy_day_of_one_case_spreads(spark):
    """A third of the day's events in one case: no piece holds more than its share of rows."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * 7919 % 24_000) * 1_000_000)
    frame = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 500))
        .alias("case_id"),
        F.col("id").alias("event_id"),
        F.lit("ocr").alias("stage"),
        F.when(F.col("id") % 2 == 0, "started").otherwise("done").alias("status"),
        at.alias("ts"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = prg.in_pieces(frame)
        sizes = [r["count"] for r in cut.groupBy("case_id", "_piece").count().collect()]
        report = prg.progress_report(frame)
        got = {r.event_id: (r.elapsed_ms, r.avg_stage_ms) for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 2 * 24_000 / 8
    started, average, first, expected = {}, {}, {}, {}
    rows = sorted(frame.select("case_id", "event_id", "status", F.unix_micros("ts").alias("t")).collect(),
                  key=lambda r: (r.t, r.event_id))
    for r in rows:
        first.setdefault(r.case_id, r.t)
        if r.status == "started":
            started[r.case_id] = r.t
        elif r.case_id in started:
            d = r.t - started[r.case_id]
            old = average.get(r.case_id)
            average[r.case_id] = d if old is None else 0.75 * old + 0.25 * d
        expected[r.event_id] = ((r.t - first[r.case_id]) // 1000, average.get(r.case_id))
    for event, (elapsed, smooth) in got.items():
        assert elapsed == expected[event][0]
        want = expected[event][1]
        assert smooth is None if want is None else abs(smooth - want / 1000) < 1.01


def test_lookup_expires_after_a_day(spark):
    rows = [
        ("k", 1, "w", START), ("k", 2, "r", START + timedelta(hours=24)),
        ("k", 3, "r", START + timedelta(hours=24, seconds=1)), ("x", 4, "r", START),
    ]
    frame = spark.createDataFrame(rows, "key STRING, id INT, kind STRING, ts TIMESTAMP")
    found = expiring_lookup(frame, ["key"], "ts", F.col("kind") == "w", ["ts", "id"])
    assert {r.id: r.hit for r in found.collect()} == {2: True, 3: False, 4: False}


def test_collisions_take_free_suffixes(spark):
    wanted = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4)], "folder STRING, o INT")
    existing = spark.createDataFrame([("A",), ("A_3",)], "folder STRING")
    got = resolve_collisions(wanted, existing, ["o"]).collect()
    assert {r.o: r.final_folder for r in got} == {1: "A_2", 2: "A_4", 3: "A_5", 4: "B"}


def test_consolidation_with_one_case_holding_most_documents(spark):
    from legajo.operators import consolidate as con

    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias(
            "case_id"
        ),
        ((F.col("id") * 7919) % 30011).alias("doc_seq"),
        F.concat(F.lit("d"), "id").alias("source_document"),
        F.lit("poliza").alias("document_type"),
        F.concat(F.lit("v"), F.col("id") % 5).alias("ajuste"),
    ).repartition(16)
    decided = con.decisions(con.consolidate(rows, ["ajuste"]))
    hot = decided.filter("case_id = 'hot'").first()
    best = min((i * 7919 % 30011, i) for i in range(30000) if i % 3)[1]
    assert (hot.n_options, hot.source_document, hot.value) == (20000, f"d{best}", f"v{best % 5}")
    assert decided.count() == 10001


def test_ranges_against_all_pairs(spark):
    """Open ends, empty and single-day ranges, days at the edges, null keys, a hot key."""
    from legajo.operators.ranges import covering_counts

    picker = random.Random(9)
    day = lambda n: None if n is None else (START + timedelta(days=n)).date()
    points = [(i, picker.choice(["hot", "hot", "a", None]), day(picker.randrange(400))) for i in range(300)]
    points += [(300, "a", None), (301, "none", day(3))]
    ranges = [("hot", day(picker.randrange(400)), day(picker.randrange(400))) for _ in range(60)]
    ranges += [("a", None, day(20)), ("a", day(350), None), (None, None, None), ("a", day(7), day(7))]
    got = covering_counts(
        spark.createDataFrame(points, "id INT, k STRING, d DATE"),
        spark.createDataFrame(ranges, "k STRING, low DATE, high DATE"),
        "id", ["k"], "d", "low", "high",
    ).collect()
    want = {
        i: sum(
            k == key and d is not None and (low is None or low <= d) and (high is None or d <= high)
            for key, low, high in ranges
        )
        for i, k, d in points
    }
    assert {r.id: r.n_covering for r in got} == want


def exchanges(frame):
    """The exchanges of the plan for tables too large to be broadcast."""
    conf = frame.sparkSession.conf
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(name)
    conf.set(name, "-1")
    try:
        plan = frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)
    return [line.split("Exchange", 1)[1] for line in plan.splitlines() if "Exchange " in line]


@pytest.mark.parametrize(
    "query",
    [
        finding_queries.cross_document_discrepancies,
        finding_queries.discrepant_documents,
        extraction_queries.conflict_requests,
        consolidation_queries.conflict_options,
    ],
)
def test_fields_of_a_case_are_joined_in_place(spark, small, query):
    """Rows dealt by case are not dealt again by case and field."""
    found = exchanges(query(spark, small))
    assert found and not [e for e in found if "field" in e or "rangepartitioning" in e]


def test_conflicts_of_many_options_are_numbered_alike(spark):
    rows = [("c", f"f{i % 3}", f"v{i}", i % 5, f"d{i}", "otro", i) for i in range(90)]
    rows += [("c", "single", "v", 1, "d", "otro", 1)]
    options = spark.createDataFrame(
        rows,
        "case_id string, field string, value string, priority int, source_document string,"
        " document_type string, doc_seq int",
    )
    whole, cut = (
        sorted(map(tuple, requests.conflict_request_lines(options, together=n).collect()))
        for n in (100, 3)
    )
    assert whole == cut and len(whole) == 90


def test_few_terms_of_a_policy_need_no_blocks(spark, small):
    plan = extraction_queries.term_violations(spark, small)._jdf.queryExecution().toString()
    assert "explode" not in plan
