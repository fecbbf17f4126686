"""Files written by the sinks and read back; delimited and JSON sources."""

import json
from datetime import datetime


from legajo.schemas import OCR_RESULTS, STORED_TABLES
from legajo.sources import files as fil
from legajo.sources import stores as sto


def test_listing_splits_supported_files(spark, tmp_path):
    for name in ("a.PDF", "b.jpg", "c.docx", "d.txt", "._e.pdf", "f.csv"):
        (tmp_path / name).write_bytes(b"x")
    files = fil.listing(spark, str(tmp_path))
    names = {p.path.rsplit("/", 1)[1] for p in fil.supported(files).collect()}
    # files starting with '.' are never listed by Spark
    assert names == {"a.PDF", "b.jpg", "c.docx", "f.csv"}
    assert fil.unsupported(files).count() == 1
    assert fil.listing_summary(files).first().n_files == 5
    assert fil.require_any(fil.supported(files)).first().n_files == 4


def test_delimited_files_become_documents(spark, tmp_path):
    (tmp_path / "uno.csv").write_text("a;b;c\n1;;3\n\"x\";y;z\n", encoding="utf-8")
    (tmp_path / "dos.csv").write_bytes("año,n\nseñal,2\n".encode("latin-1"))
    rows = {
        r.path.rsplit("/", 1)[1]: r
        for r in fil.delimited_documents(fil.csv_files(spark, str(tmp_path))).collect()
    }
    first = rows["uno.csv"].tables[0]
    assert first.headers == ["a", "b", "c"]
    assert first.data_rows == [["1", None, "3"], ["x", "y", "z"]]
    assert (first.row_count, first.column_count) == (2, 3)
    assert rows["dos.csv"].tables[0].data_rows == [["señal", "2"]]


def test_ocr_json_and_store_round_trip(spark, tmp_path):
    source = tmp_path / "json"
    source.mkdir()
    for i in range(3):
        body = {"document_id": f"d{i}", "file_hash": f"{i:02x}ff", "raw_text": "t" if i else None}
        (source / f"{i}.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    rows = sto.read_ocr_json(spark, str(source), OCR_RESULTS)
    assert {r.file_name for r in rows.collect()} == {"0.json", "1.json", "2.json"}
    stored = sto.ocr_store_rows(rows.drop("file_name"))
    assert stored.filter("raw_text = ''").count() == 1
    sto.write_ocr_store(stored, str(tmp_path / "store"))
    assert sorted(p.name for p in (tmp_path / "store").glob("hash_prefix=*")) == [
        "hash_prefix=00", "hash_prefix=01", "hash_prefix=02",
    ]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_log_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "log")
    for status, at in (("confirmed", "2024-01-01"), ("corrected", "2024-01-02")):
        full = spark.createDataFrame(
            [("c", "f", "a", "b", status, datetime.fromisoformat(at))], STORED_TABLES["feedback"]
        )
        sto.append_rows(full, path)
    log = sto.read_rows(spark, path, "feedback")
    assert [r.status for r in sto.latest_rows(log, ["case_id", "field"], "created_at").collect()] == [
        "corrected"
    ]
    sto.compact(log, ["case_id", "field"], "created_at", str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1


def test_runs_index_examples_and_redaction(spark, tmp_path):
    runs = spark.createDataFrame([("c", {"api_key": "k", "x": "1"})], "case_id STRING, options MAP<STRING, STRING>")
    clean = sto.redacted_options(runs).first().options
    assert clean == {"api_key": "***redacted***", "x": "1"}
    sto.append_with_id(runs, str(tmp_path / "runs"), "run_id")
    assert spark.read.parquet(str(tmp_path / "runs")).first().run_id
    schema = "case_id STRING, total_documents BIGINT"
    index = spark.createDataFrame([("c1", 2), ("c2", 3)], schema)
    sto.write_case_index(index, str(tmp_path / "index"))
    assert sto.read_case_index(spark, str(tmp_path / "index"), schema, "c2").first().total_documents == 3
    assert sto.read_case_index(spark, str(tmp_path / "index"), schema, "zz").count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"examples": [{"field": "a"}, {"field": "b"}]}))
    examples = sto.golden_examples(
        spark, str(tmp_path / "g.json"),
        "examples ARRAY<STRUCT<field: STRING>>", "examples",
    )
    assert examples.count() == 2


def test_extraction_rows_keep_other_keys(spark):
    rows = spark.createDataFrame([("d", {"document_type": "poliza", "k": "v"}), ("e", {"k": "w"})],
                                 "document_id STRING, fields MAP<STRING, STRING>")
    got = {r.document_id: r for r in sto.extraction_store_rows(rows).collect()}
    assert got["d"].document_type == "poliza" and got["d"].extra == {"k": "v"}
    assert got["e"].document_type == "desconocido"
