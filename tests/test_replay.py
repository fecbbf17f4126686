"""Resumable replay: digests without order, changed cases only, a run that dies."""

import pytest
from pyspark.sql import functions as F

from legajo.plans import jobs
from legajo.session import joined_in_place, stored_by

FIELDS = ["numero_siniestro", "nombre_asegurado"]
DOCS = "case_id STRING, document_id STRING, doc_seq INT, source_document STRING, document_type STRING"
RESULTS = "document_id STRING, pairs ARRAY<STRUCT<key: STRING, value: STRING>>"


def documents(spark, *names):
    rows = [(n[0], n, i, f"{n}.pdf", "poliza") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, DOCS)


def results(spark, **names):
    return spark.createDataFrame([(d, [("nombre_asegurado", n)]) for d, n in names.items()], RESULTS)


def state(reports):
    return {r["case_id"]: (r["nombre_asegurado"], r["run"]) for r in reports.collect()}


def test_digests_ignore_order_and_see_repeats(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 1, "x"), (None, 3, "z")]
    schema = "case_id STRING, n INT, t STRING"
    one = jobs.case_digests(spark.createDataFrame(rows, schema))
    other = jobs.case_digests(
        spark.createDataFrame(rows[::-1], schema).select("t", "case_id", "n").repartition(5)
    )
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()}
    fewer = jobs.case_digests(spark.createDataFrame(rows[:3], schema))
    digests = {r["case_id"]: tuple(r)[1:] for r in one.collect()}
    changed = {r["case_id"] for r in fewer.collect() if tuple(r)[1:] != digests[r["case_id"]]}
    assert changed == {"b"}


def test_only_changed_cases_are_replayed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "replay")
    docs = documents(spark, "a1", "a2", "b1", "c1")

    def run(**known):
        return jobs.replay_changed(docs, results(spark, **known), path, FIELDS)

    number, reports = run(a1="Ana", b1="Berta")
    assert number == 1 and state(reports) == {"a": ("Ana", 1), "b": ("Berta", 1)}
    # nothing changed: nothing is replayed
    assert state(run(b1="Berta", a1="Ana")[1]) == {"a": ("Ana", 1), "b": ("Berta", 1)}
    # one case changes, one is new, one lost its results and keeps its report
    with_more = {"a1": "Anabel", "c1": "Carla"}
    number, reports = run(**with_more)
    want = {"a": ("Anabel", number), "b": ("Berta", 1), "c": ("Carla", number)}
    assert state(reports) == want

    # a run that dies after the reports are in place and before the log is written
    real = jobs.snapshots.replace_cases

    def dies(*args):
        real(*args)
        raise RuntimeError("killed before the log")

    monkeypatch.setattr(jobs.snapshots, "replace_cases", dies)
    with pytest.raises(RuntimeError):
        run(a1="Ann", c1="Carla")
    monkeypatch.undo()
    number, reports = run(a1="Ann", c1="Carla")
    assert state(reports) == want | {"a": ("Ann", number)}
    assert reports.filter(F.col("case_id") == "a").count() == 1


def test_rows_that_lie_by_case_are_not_dealt_again(spark):
    docs = stored_by(documents(spark, "a1", "a2", "b1"), ["case_id"], "by-case")
    known = docs.select("case_id", "document_id")
    last = stored_by(jobs.case_digests(known).withColumnRenamed("case_id", "_case"), ["_case"], "log")
    with joined_in_place(spark):
        now = jobs.case_digests(docs.join(known, ["case_id", "document_id"]))
        rows = jobs.beside_cases(now, last.select("_case", F.col("n_rows").alias("before")))
        exchanges = rows._jdf.queryExecution().executedPlan().toString()
        assert {(r["case_id"], r["n_rows"], r["before"]) for r in rows.collect()} == {("a", 2, 2), ("b", 1, 1)}
    assert "Exchange hashpartitioning" not in exchanges
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def test_no_case_is_a_case(spark, tmp_path):
    docs = documents(spark, "a1", "b1").withColumn("case_id", F.when(F.col("case_id") == "a", "a"))

    def run(**known):
        return state(jobs.replay_changed(docs, results(spark, **known), str(tmp_path / "r"), FIELDS)[1])

    assert run(a1="Ana", b1="Berta") == {"a": ("Ana", 1), None: ("Berta", 1)}
    assert run(a1="Ana", b1="Berta") == {"a": ("Ana", 1), None: ("Berta", 1)}
    again = run(a1="Ana", b1="Beate")
    assert again["a"] == ("Ana", 1) and again[None][0] == "Beate" and again[None][1] > 1
