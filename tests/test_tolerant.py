"""Broken, mistyped and changed JSON records: each is read or rejected, none is lost."""

from legajo.sources import tolerant

SCHEMA = "id INT, name STRING, at STRUCT<x: INT>"


def test_lines(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [
        '{"id": 1, "name": "a", "at": {"x": 1}}', "", '{"id": 2}', '{"id": "two"}', '{"id": 3, "na',
        '[1, 2]', '"text"', "null", '{"id": 4, "extra": {"k": [1]}, "more": 1}', "{}",
        '{"id": 5, "at": {"x": "far"}}', "no json",
    ]
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "b.jsonl").write_text("")
    records = tolerant.json_records(spark, str(folder), SCHEMA)
    states = {r["text"]: r["state"] for r in records.collect()}
    wrong = {'{"id": "two"}', '{"id": 5, "at": {"x": "far"}}'}
    cut = {'{"id": 3, "na', "[1, 2]", '"text"', "null", "no json"}
    assert {t for t, s in states.items() if s == "wrong type"} == wrong
    assert {t for t, s in states.items() if s == "malformed"} == cut
    read = {(r["id"], r["name"], r["at"] and r["at"]["x"]) for r in tolerant.readable(records).collect()}
    assert read == {(1, "a", 1), (2, None, None), (4, None, None), (None, None, None)}
    assert tolerant.rejected(records).count() == 7
    assert {tuple(r) for r in tolerant.drift(records).collect()} == {("extra", 1), ("more", 1)}


def test_whole_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "id": 7,\n "name": "two\\nlines"\n}')
    (tmp_path / "cut.json").write_text('{\n "id": 7,\n "na')
    (tmp_path / "empty.json").write_text("")
    records = tolerant.json_records(spark, str(tmp_path), SCHEMA, whole_files=True)
    found = {r["file"].rsplit("/")[-1]: (r["state"], r["record"] and r["record"]["name"]) for r in records.collect()}
    assert found["one.json"] == ("read", "two\nlines") and found["cut.json"] == ("malformed", None)
    assert found.get("empty.json", ("malformed", None)) == ("malformed", None)
