"""Inputs on which earlier forms of the operators went wrong."""

from datetime import datetime, timedelta
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

from legajo.functions.values import clean_amount, number_text
from legajo.operators import cases, classify, extract, feedback, findings, maintain, organise
from legajo.operators.scaling import running_last
from legajo.plans import catalog, lookup_queries
from legajo.sources import files
from legajo.streaming.intake import expiring_dedupe, stored_entries


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_amount_text_keeps_the_number(spark):
    given = ["1.234,56", "1234.5", "$1,234.56", "123456789012345678.12", "12", "abc", None]
    want = ["1.23456", "1234.5", "1234.56", "1.2345678901234568e+17", "12.0", None, None]
    frame = column(spark, given)
    assert [r[0] for r in frame.select(number_text(clean_amount("v"))).collect()] == want
    cleaned = extract.clean_extractions(
        column(spark, ["123456789012345678.12"]).withColumnRenamed("v", "monto_reclamacion"),
        ["monto_reclamacion"],
    ).collect()[0]
    assert cleaned["monto_reclamacion"] == "1.2345678901234568e+17"
    numbers = [0.0, -2.5, 1e16, 123456789.12, 5e-05, 0.0001, 1e22, 9999999999999998.0, 1e100]
    shown = column(spark, numbers, "double").select(number_text("v")).collect()
    assert [r[0] for r in shown] == [repr(x) for x in numbers]


@pytest.mark.parametrize(
    ("answer", "score"),
    [
        ('{"fraud_score": true,"fraud_ind', 0.0),
        ('{"fraud_score": "NaN"}', 0.0),
        ('{"fraud_score": "0.7"}', 0.0),
        ('{"fraud_score": true}', 1.0),
        ('{"fraud_score": 0.7}', 0.7),
        ('{"fraud_score": 1}', 1.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_fraud_score(spark, answer, score):
    rows = spark.createDataFrame([("1", answer)], "case_id string, answer string")
    assert findings.normal_answers(rows).collect()[0]["fraud_score"] == score


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"document_type":"a","reasons":["x"]}', ("otro", 0.0, ["Error LLM"])),
        ('{"document_type":"z","confidence":0.8}', ("otro", 0.0, ["Error LLM"])),
        ('{"document_type":"a","conf', ("otro", 0.0, ["Error parsing LLM"])),
        ('{"document_type":"a","confidence":0.8,"reasons":["1","2","3","4"]}',
         ("a", 0.8, ["1", "2", "3", "4"])),
    ],
)
def test_type_answers(spark, answer, want):
    rows = spark.createDataFrame([("1", answer)], "id string, answer string")
    assert tuple(classify.ingest_answers(rows, ["a"], "id").collect()[0][1:]) == want


def test_orphans_by_containment(spark):
    folders = column(spark, ["ACME_C1-final", "OTHER-x", "no dash"]).withColumnRenamed("v", "folder")
    cases = column(spark, ["C1", "C22"]).withColumnRenamed("v", "case_id")
    assert [r[0] for r in maintain.orphan_folders(folders, cases).collect()] == ["OTHER-x"]


def test_folders_beyond_a_hundred(spark):
    folders = spark.createDataFrame([(i, "F") for i in range(103)], "id int, folder string")
    taken = column(spark, ["F", "F_102"]).withColumnRenamed("v", "folder")
    found = organise.resolve_collisions(folders, taken, ["id"]).collect()
    names = {r["final_folder"] for r in found}
    assert None not in names and len(names) == 103 and not names & {"F", "F_102"}


def test_null_keys_stay(spark):
    rows = spark.createDataFrame(
        [(None, 1, "a"), (None, 2, None), ("k", 1, "b")], "k string, t int, x string"
    )
    last = running_last(rows, ["k"], F.col("t"), ["t"], {"seen": F.col("x")})
    assert {tuple(r) for r in last.collect()} == {
        (None, 1, "a", "a"), (None, 2, None, "a"), ("k", 1, "b", "b")
    }
    items = spark.createDataFrame(
        [(None, "f", "confirmed"), (None, "f", "odd"), ("p", "f", "confirmed")],
        "payload_id string, field string, status string",
    )
    good, bad = feedback.split_payloads(items)
    assert good.count() == 1 and bad.count() == 2


def test_quoted_cells(spark):
    content = column(spark, ['a,b\n"x,1",2\n\n"line\nbreak","say ""hi"""\n5" pipe,6"\n'])
    table = files.delimited_documents(
        content.select(F.encode("v", "UTF-8").alias("content"))
    ).collect()[0]["tables"][0]
    assert table["headers"] == ["a", "b"]
    assert table["data_rows"] == [["x,1", "2"], ["line\nbreak", 'say "hi"'], ['5" pipe', '6"']]


def test_long_texts_are_kept(spark):
    text = "línea con texto\n" * 2000
    frame = column(spark, [text, "", None])
    assert frame.select(extract.prepared_text("v")).collect()[0][0] == text
    chunks = extract.text_chunks(frame.withColumn("id", F.length("v")), 5000, "v").collect()
    assert "".join(r["v"] for r in sorted(chunks, key=lambda r: r["chunk_no"])) == text
    assert sorted(r["chunk_no"] for r in chunks) == [0, 0, 0, 1, 2, 3, 4, 5, 6]
    key = [r[0] for r in column(spark, [text, text + "x"]).select(extract.reuse_key("v", "v")).collect()]
    assert len(set(key)) == 2


@pytest.mark.parametrize("per_batch", [1, 10])
def test_expiring_dedupe_in_any_layout(spark, tmp_path, per_batch):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 24, 25, 30, 49, 50, 75, 76]
    for i, hour in enumerate(hours):
        rows = [("k", start + timedelta(hours=hour)), (None, start + timedelta(hours=hour))]
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in" / f"{i:02d}"))
    events = (
        spark.readStream.schema("key string, ts timestamp")
        .option("maxFilesPerTrigger", per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(str(tmp_path / "in"))
    )
    out = str(tmp_path / f"out{per_batch}")
    expiring_dedupe(events, ["key"], out, str(tmp_path / f"state{per_batch}")).awaitTermination()
    got = stored_entries(spark, out, events.schema).collect()
    assert len(got) == 8
    for key in ("k", None):
        times = sorted((r["ts"] - start).total_seconds() / 3600 for r in got if r["key"] == key)
        assert times == [0, 25, 50, 75]


def test_created_cases_past_four_digits(spark, tmp_path):
    """Numbers of more than four digits are named as in the SQL; the operator holds them whole."""
    keys = "(SELECT CAST(range AS BIGINT) AS c_custkey FROM range(8980, 9020))"
    customers = str(tmp_path / "customer.parquet")
    duckdb.sql(f"COPY {keys} TO '{customers}' (FORMAT parquet)")
    view = duckdb.connect()
    view.execute(f"CREATE VIEW customer AS SELECT * FROM '{customers}'")
    want = view.execute(catalog.TWINS["created_cases"]).fetchall()
    got = lookup_queries.created_cases(spark, str(tmp_path)).select("arrival", "case_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "case_id string, year int, seq int")
    given = spark.createDataFrame([(1, 1999, "CASE-1999-12345")], "arrival int, year int, case_id string")
    assert cases.create_if_absent(given, none, ["arrival"]).first()["case_id"] == "CASE-1999-12345"


def documents_in(spark, folder, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_of_unknown_language_are_content(spark, tmp_path):
    rows = [
        (1, "a text", None, "src2", 6), (2, "a text", "fr", "src2", 6), (3, "a text", "fr", "src1", 6),
        (4, "", "en", "src2", 0), (5, None, None, "src2", None), (6, "", None, "src1", 0),
    ]
    got = lookup_queries.documents_without_content(spark, documents_in(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect())) == [
        (1, "src2", None), (2, None, "no_content"), (3, "src1", None),
        (4, None, "no_content"), (5, None, "no_content"), (6, "src1", None),
    ]


def test_texts_of_unknown_language_stay_in_the_template(spark, tmp_path):
    rows = [
        (1, "a", None, "s", 1), (2, "a", "fr", "s", 1), (3, "a", "de", "s", 1), (4, "a", "en", "s", 1),
        (5, "", "en", "s", 0), (6, "", None, "s", 0), (7, None, None, "s", None),
    ]
    got = lookup_queries.template_documents(spark, documents_in(spark, tmp_path, rows))
    want = ["a", "OCR a", "OCR a", "a", "OCR ", "OCR ", ""]
    kinds = ["otro", "fr", "de", "otro", "otro", "otro", "otro"]
    assert sorted(map(tuple, got.collect())) == [
        (i, kind, md5(text.encode()).hexdigest())
        for i, kind, text in zip(range(1, 8), kinds, want)
    ]
