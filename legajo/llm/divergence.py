"""How the sources of a language diverge in their terms, by sparse merges of group pairs.

The terms of a language that enough of its documents hold are numbered and cut into
blocks.  Every source of the language is a row per block with two sorted arrays, term
ids and counts.  Sources are dealt into tiles; a task co-groups the rows of two tiles
for one block and merges every unordered pair of sources: a galloping search finds the
terms both hold, and terms that only one or neither holds are priced in bulk.  So a task
holds two tiles of one block, whatever the size of a source or of the vocabulary.

Shares are whole numbers of a billionth and every division is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import slices, stored, text_bytes
from legajo.operators.scaling import dense_ordinals

#: Terms of a block and sources of a tile: what bounds a task.
BLOCK, TILE = 8192, 16
#: Distinct (group, term) entries a task holds before it passes them on.
HELD = 300_000
BILLION = 1_000_000_000

# letters and bytes of characters beyond ASCII stay, A-Z in lower case; the rest separates
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def text_terms(data: bytes) -> list[bytes]:
    """The terms of a text's UTF-8 bytes: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return data.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term.

    A row with the empty term stands for every group that occurs.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs_with) in held.items():
                n = len(times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()),
                        pa.array([source] * n, pa.string()),
                        pa.array(list(times), pa.binary()).cast(pa.string()),
                        pa.array(list(times.values()), pa.int64()),
                        pa.array([docs_with[t] for t in times], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in slices(batches):
            columns = (batch.column(i).to_pylist() for i in range(3))
            for lang, source, data in zip(*columns, strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter({b"": 0}), Counter()
                times, docs_with = held[lang, source]
                size -= len(times)
                terms = text_terms(data)
                times.update(terms)
                docs_with.update(set(terms))
                size += len(times)
                if size >= HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    named = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        text_bytes(text_col).alias("text"),
    )
    parts = named.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), three digits at a time so that 64 bits hold it."""
    part = np.asarray(counts, np.int64) + 2
    result, rest = part // whole, part % whole
    for _ in range(3):
        rest = rest * 1000
        result = result * 1000 + rest // whole
        rest = rest % whole
    return result + 1


def share_column(count: Column, whole: Column) -> Column:
    """The same as a column, in whole decimals."""
    part = (count.cast("decimal(18,0)") + 2) * F.lit(BILLION).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", part, whole.cast("decimal(18,0)"))


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares reach a billion and one, so 64 bits hold it."""
    gap = p - q
    return gap * gap // (p + q)


def galloped(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the common ids in two sorted arrays, searching from the shorter one."""
    at = np.searchsorted(many, few)
    inside = at < len(many)
    inside[inside] = many[at[inside]] == few[inside]
    return np.flatnonzero(inside), at[inside]


def pair_price(a: tuple, b: tuple, terms: int) -> int:
    """The summed price of two groups (ids, shares, share of an absent term) over a block."""
    (ids_a, p, p0), (ids_b, q, q0) = a, b
    if len(ids_a) > len(ids_b):
        return pair_price(b, a, terms)
    at_a, at_b = galloped(ids_a, ids_b)
    only_a, only_b = price(p, q0), price(p0, q)
    both = price(p[at_a], q[at_b]).sum() - only_a[at_a].sum() - only_b[at_b].sum()
    neither = terms - len(ids_a) - len(ids_b) + len(at_a)
    return int(only_a.sum() + only_b.sum() + both + neither * int(price(p0, q0)))


PAIRS = "lang string, left string, right string, value bigint"


def merged_tiles(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of all pairs (left source before right source) of two tiles in one block, both ways."""

    def groups(table: pa.Table) -> list[tuple]:
        return [
            (
                r["place"],
                r["source"],
                (
                    np.array(r["ids"] or [], np.int64),
                    share(np.array(r["ns"] or [], np.int64), r["whole"]),
                    share(np.int64(0), r["whole"]),
                ),
                r["terms"],
            )
            for r in table.to_pylist()
            if r["whole"]
        ]

    rows: list[tuple] = []
    others = groups(right)
    for place, source, mine, terms in groups(left):
        for other_place, other, theirs, _ in others:
            if place < other_place:
                value = pair_price(mine, theirs, terms)
                rows += [(source, other, value), (other, source, value)]
    lang = key[0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(rows), pa.string()),
            "left": pa.array([r[0] for r in rows], pa.string()),
            "right": pa.array([r[1] for r in rows], pa.string()),
            "value": pa.array([r[2] for r in rows], pa.int64()),
        }
    )


def audit(
    docs: DataFrame,
    min_docs: int = 10,
    top: int | None = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group (lang, source).

    A language keeps its terms that at least ``min_docs`` of its documents hold.  A
    group's share of a term is 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the
    group's occurrences of the V kept terms; a language's share likewise.

    Part ``pair`` has every other source of the language, whether close or far, with
    the summed difference floor((p - q)^2 / (p + q)) over all kept terms; part
    ``term`` the group's own terms that it uses more than its language does, by the
    same difference, up to rank ``top`` (all for None).

    Null text, lang and source count as empty.  A document without terms still makes
    its group known.  Repeated rows are documents of their own.  A language without
    kept terms has differences of 0 and no terms; no row in, no row out.  Other
    columns are not read, so their names cannot clash.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    kept = stored(
        counts.filter("term <> ''")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .filter(F.col("docs") >= min_docs)
        .drop("docs"),
        "kept-terms",
    )
    numbered = stored(dense_ordinals(kept, ["lang"], ["term"], "id"), "numbered-terms")
    used = stored(
        counts.filter("term <> ''").drop("docs").join(numbered, ["lang", "term"]), "used-terms"
    )
    langs = stored(
        numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("sum")),
        "languages",
    )
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = stored(
        dense_ordinals(
            counts.filter("term = ''").select("lang", "source"), ["lang"], ["source"], "place"
        )
        .join(langs, "lang", "left")
        .join(sums, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            "place",
            F.coalesce("terms", F.lit(0)).alias("all_terms"),
            F.col("sum") + 2 * F.col("terms"),
            (F.coalesce("own", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("whole"),
        )
        .toDF("lang", "source", "place", "all_terms", "lang_whole", "whole"),
        "groups",
    )
    pairs = source_pairs(used, groups)
    terms = own_terms(used, groups, top)
    return pairs.unionByName(terms)


def source_pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair`` of the audit."""
    arrays = (
        used.withColumn("block", F.expr(f"(id - 1) div {BLOCK}"))
        .groupBy("lang", "source", "block")  # BLOCK terms at most
        .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("at"))
        .select("lang", "source", "block", F.col("at.id").alias("ids"), F.col("at.n").alias("ns"))
    )
    last = F.greatest(F.expr(f"(all_terms - 1) div {BLOCK}"), F.lit(0))
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    cells = stored(
        grid.join(arrays, ["lang", "source", "block"], "left").select(
            "lang",
            "source",
            "place",
            "block",
            "whole",
            F.expr(f"(place - 1) div {TILE}").alias("tile"),
            F.least(F.col("all_terms") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("terms"),
            "ids",
            "ns",
        ),
        "cells",
    )
    tiles = groups.groupBy("lang").agg(F.expr(f"(max(place) - 1) div {TILE}").alias("last_tile"))
    cells = cells.join(tiles, "lang")
    first = cells.withColumn("a", F.col("tile")).withColumn(
        "b", F.explode(F.sequence(F.col("tile"), F.col("last_tile")))
    )
    second = cells.withColumn("b", F.col("tile")).withColumn(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tile")))
    )
    keys = ["lang", "a", "b", "block"]
    columns = [*keys, "place", "source", "whole", "terms", "ids", "ns"]
    priced = (
        first.select(*columns)
        .groupBy(*keys)
        .cogroup(second.select(*columns).toDF(*columns).groupBy(*keys))
        .applyInArrow(merged_tiles, PAIRS)
        .groupBy("lang", "left", "right")
        .agg(F.sum("value").alias("value"))
    )
    # a language without kept terms: every pair is alike
    bare = groups.filter("all_terms = 0").select("lang", "source")
    other = bare.select("lang", F.col("source").alias("right"))
    alike = bare.join(other, "lang").filter("source <> right").select(
        "lang", F.col("source").alias("left"), "right", F.lit(0).cast("bigint").alias("value")
    )
    by_value = Window.partitionBy("lang", "left").orderBy(F.desc("value"), "right")
    return priced.unionByName(alike).select(
        "lang",
        F.col("left").alias("source"),
        F.lit("pair").alias("part"),
        F.col("right").alias("item"),
        "value",
        F.row_number().over(by_value).alias("rank"),
    )


def own_terms(used: DataFrame, groups: DataFrame, top: int | None) -> DataFrame:
    """Part ``term`` of the audit."""
    shares = used.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").alias("item"),
        share_column(F.col("n"), F.col("whole")).alias("p"),
        share_column(F.col("total"), F.col("lang_whole")).alias("q"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = shares.filter("p > q").select(
        "lang",
        "source",
        F.lit("term").alias("part"),
        "item",
        F.expr("(p - q) * (p - q) div (p + q)").alias("value"),
    ).withColumn("rank", F.row_number().over(by_value))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)
