"""The replacing table: whole cases, untouched buckets, a writer that dies."""

import pytest

from legajo.sources import snapshots

SCHEMA = "case_id STRING, part INT, value STRING"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_replace_read_and_a_dead_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cases")
    snapshots.create(spark, path)
    schema = frame(spark, ("x", 1, "y")).schema
    assert snapshots.read(spark, path, schema).count() == 0
    first = [(f"c{i}", p, "old") for i in range(30) for p in range(3)] + [(None, 0, "old")]
    assert snapshots.replace_cases(frame(spark, *first), path) == 1
    before = snapshots.manifest_of(spark, path)[1]
    assert snapshots.replace_cases(frame(spark, ("c3", 9, "new"), (None, 1, "new"), ("d", 1, "new")), path) == 2

    def state():
        return sorted((tuple(r) for r in snapshots.read(spark, path, schema).collect()), key=str)

    want = [r for r in first if r[0] not in ("c3", None)] + [("c3", 9, "new"), (None, 1, "new"), ("d", 1, "new")]
    assert state() == sorted(want, key=str)
    after = snapshots.manifest_of(spark, path)[1]
    assert sum(before[b] != after[b] for b in before) <= 3  # other buckets were not written again

    def dies(*_):
        raise RuntimeError("killed before the switch")

    monkeypatch.setattr(snapshots, "_switch", dies)
    with pytest.raises(RuntimeError):
        snapshots.replace_cases(frame(spark, ("c4", 1, "half")), path)
    monkeypatch.undo()
    assert state() == sorted(want, key=str)
    assert snapshots.replace_cases(frame(spark, ("c4", 1, "again")), path) == 3
    assert ("c4", 1, "again") in state() and ("c4", 0, "old") not in state()
    assert snapshots.replace_cases(frame(spark), path) == 4  # nothing written, nothing lost
    assert len(state()) == len(want) - 2
