"""Run registered queries beside their SQL twins and report differences."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from legajo.plans import catalog  # noqa: E402
from legajo.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: [str(v) for v in r]
    )


def compare(spark, connection, name: str, sf_dir: str) -> str:
    frame = catalog.QUERIES[name](spark, sf_dir)
    mine = rows_of(frame.columns, frame.collect())
    if name not in catalog.TWINS:
        return f"rows only ({len(mine)})"
    cursor = connection.execute(catalog.TWINS[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"DIFFERENT columns {sorted(columns)} {sorted(frame.columns)}"
    if mine == theirs:
        kinds = dict(zip(columns, [str(d[1]) for d in cursor.description]))
        types = {c: t for c, t in frame.dtypes}
        return f"equal ({len(mine)})" if mine else f"EMPTY {types} {kinds}"
    known_mine, known_theirs = set(mine), set(theirs)
    gone = [r for r in theirs if r not in known_mine][:2]
    extra = [r for r in mine if r not in known_theirs][:2]
    return f"DIFFERENT {len(mine)} vs {len(theirs)}\n   spark {extra}\n   sql   {gone}"


def main() -> None:
    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    catalog.load()
    spark = local_session("8")
    connection = connect(sf_dir)
    bad = 0
    for name in catalog.QUERIES:
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            verdict = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += not verdict.startswith(("equal", "rows only"))
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
