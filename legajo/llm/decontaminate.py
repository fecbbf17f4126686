"""Benchmark items inside documents, by SimHash windows and multi-index Hamming blocks.

Everything here is DataFrame expressions.  Words are runs of letters and digits,
lower-cased; a shingle is five words.  The windows of a document have as many
shingles as the item.

1. A window can only reach the similarity if enough of its shingles occur in the
   item, so windows are laid where that many shared shingles lie (``window_starts``).
   A window left out has a similarity below the bound for certain.
2. Windows and items get SimHash fingerprints.  Two fingerprints within the radius
   agree in one of radius + 1 bit blocks at least, so a join on the blocks finds
   every such pair.
3. Candidates are verified exactly: shingles weigh as often as they occur, and the
   similarity is the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import scratch, small_side, stored, text_or_empty

WORD = r"[\p{L}\p{N}]+"
#: Rows of a join side that is broadcast; a larger side is shuffled.
BROADCAST_ROWS = 1_000_000


def hashed(df: DataFrame, kept: list[Column], text_col: str, words: int) -> DataFrame:
    """The kept columns, ``dkey`` (hash of the text) and ``hashes`` of the shingles in order.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    text = text_or_empty(text_col)
    split = df.select(
        *kept,
        F.xxhash64(text).alias("dkey"),
        F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("_words"),
    )
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - words, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(words)]),
    )
    short = F.array(F.xxhash64(F.array_join("_words", " ")))
    none = F.array().cast("array<bigint>")
    return split.withColumn(
        "hashes",
        F.when(F.size("_words") == 0, none).when(F.size("_words") < words, short).otherwise(each),
    ).drop("_words")


def fingerprint_sums(h: Column) -> list[Column]:
    """Per pair of bits i and i + 32, the number of hashes with the bit, in halves of a long."""
    one = F.lit(1)
    return [
        F.sum(
            F.shiftrightunsigned(h, i).bitwiseAND(one)
            + F.shiftleft(F.shiftrightunsigned(h, i + 32).bitwiseAND(one), 32)
        ).alias(f"_b{i}")
        for i in range(32)
    ]


def majority(count: Column) -> Column:
    """The fingerprint of the summed bits: a bit is set if more than half of the hashes have it."""
    fp = F.lit(0).cast("bigint")
    low = F.lit((1 << 32) - 1)
    for i in range(32):
        for bit, half in (
            (i, F.col(f"_b{i}").bitwiseAND(low)),
            (i + 32, F.shiftrightunsigned(F.col(f"_b{i}"), 32)),
        ):
            fp = fp.bitwiseOR(
                F.when(half * 2 > count, F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0))
            )
    return fp


def fingerprinted(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) of rows (keys, h), one per shingle."""
    sums = shingles.groupBy(*keys).agg(F.count("h").alias("_n"), *fingerprint_sums(F.col("h")))
    return sums.select(*keys, majority(F.col("_n")).alias("fp"))


def block_keys(fp: Column, n: Column, radius: int) -> Column:
    """One key per bit block; fingerprints within the radius and of one window size share one."""
    blocks = radius + 1
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return F.array(
        *[
            F.xxhash64(
                n,
                F.lit(b),
                F.shiftrightunsigned(fp, edges[b]).bitwiseAND(
                    F.lit((1 << (edges[b + 1] - edges[b])) - 1)
                ),
            )
            for b in range(blocks)
        ]
    )


def reaches(shared: Column, m: Column, n: Column, similarity: float) -> Column:
    return shared >= similarity * (m + n - shared) - 1e-9


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["dkey"] == right["dkey"])


def documents_found(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, dkey, item_id, s, value): the windows that reach the similarity, by id and text hash."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    benchmark = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    id_col, text_col, item_id, item_text = "id", "text", "item_id", "text"
    items = hashed(benchmark, [F.col(item_id).alias("item_id")], item_text, words)
    items = items.filter(F.size("hashes") > 0).withColumnRenamed("dkey", "item")
    items = stored(items.withColumn("n", F.size("hashes")), "items")
    texts = items.dropDuplicates(["item"])
    item_shingles = stored(
        texts.select("item", "n", F.explode("hashes").alias("h"))
        .groupBy("item", "n", "h")
        .agg(F.count(F.lit(1)).alias("ci")),
        "item-shingles",
    )
    rows = hashed(docs, [F.col(id_col).alias("id")], text_col, words)
    # the outer form: for the inner one the optimiser would evaluate the array twice over
    places = rows.select(
        "id",
        "dkey",
        F.size("hashes").alias("n_all"),
        F.posexplode_outer("hashes").alias("pos", "h"),
    )
    hits = stored(
        places.join(small_side(item_shingles, BROADCAST_ROWS), "h")
        .distinct(),
        "hits",
    )
    windows = stored(window_starts(hits, similarity), "windows")

    asked = stored(windows.select("id").distinct(), "asked").withColumnRenamed("id", "_asked")
    wanted = docs.join(
        small_side(asked, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("_asked")), "left_semi"
    )
    wanted = hashed(wanted, [F.col(id_col).alias("id")], text_col, words)
    spots = windows.select("id", "dkey", "n", "m", "s").distinct()
    placed = spots.join(wanted.dropDuplicates(["id", "dkey"]), same_document(spots, wanted)).select(
        spots["id"],
        spots["dkey"],
        "n",
        "m",
        "s",
        F.explode_outer(F.slice("hashes", F.col("s") + 1, F.col("m"))).alias("h"),
    )
    prints = fingerprinted(placed, ["id", "dkey", "n", "m", "s"])
    item_prints = fingerprinted(
        texts.select("item", "n", F.explode("hashes").alias("h")), ["item", "n"]
    )
    item_keys = item_prints.select(
        "item",
        F.col("fp").alias("item_fp"),
        F.explode(block_keys(F.col("fp"), F.col("n"), radius)).alias("key"),
    )
    near = (
        prints.withColumn("key", F.explode(block_keys(F.col("fp"), F.col("n"), radius)))
        .join(item_keys, "key")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("id", "dkey", "n", "m", "s", "item")
        .distinct()
    )
    inside = (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("s") + F.col("m"))
    shared = (
        near.join(hits.drop("n"), same_document(near, hits) & (near["item"] == hits["item"]) & inside)
        .groupBy(near["id"], near["dkey"], near["item"], "n", "m", "s", "h")
        .agg(F.least(F.count(F.lit(1)), F.max("ci")).alias("common"))
        .groupBy("id", "dkey", "item", "n", "m", "s")
        .agg(F.sum("common").alias("shared"))
        .filter(reaches(F.col("shared"), F.col("m"), F.col("n"), similarity))
    )
    value = F.col("shared") / (F.col("m") + F.col("n") - F.col("shared"))
    return shared.join(items.select("item", "item_id").distinct(), "item").select(
        "id", "dkey", "item_id", "s", value.alias("value")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, similarity, start.

    ``start`` is the first shingle (and word) of the most similar window, the
    earliest of equal ones.  A document shorter than an item is one window.  Null
    and empty texts and items match nothing; null ids are kept, and rows equal in
    id and text count once.  Other columns are not read, so their names cannot clash.
    """
    found = documents_found(
        docs, benchmark, words, similarity, radius, id_col, text_col, item_id, item_text
    )
    return (
        found.groupBy("id", "item_id")
        .agg(F.max(F.struct(F.col("value").alias("similarity"), (-F.col("s")).alias("back"))).alias("best"))
        .select(
            F.col("id").alias(id_col),
            "item_id",
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.back")).alias("start"),
        )
    )


def window_starts(hits: DataFrame, similarity: float) -> DataFrame:
    """(id, dkey, item, n, m, s): windows of m shingles from s with enough hits of the item.

    m is n, the size of the item, or that of a shorter document.
    """
    m = F.least("n", "n_all")
    document = ["id", "dkey", "item", "n", "n_all"]
    enough = (
        hits.groupBy(*document)
        .agg(F.count(F.lit(1)).alias("_hits"))
        .filter(reaches(F.col("_hits"), m, F.col("n"), similarity))
        .select(F.col("id").alias("_id"), F.col("dkey").alias("_dkey"), F.col("item").alias("_item"))
    )
    same = (
        F.col("id").eqNullSafe(F.col("_id"))
        & (F.col("dkey") == F.col("_dkey"))
        & (F.col("item") == F.col("_item"))
    )
    first = F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0))
    last = F.least(F.col("pos"), F.greatest(F.col("n_all") - F.col("n"), F.lit(0)))
    return (
        hits.join(enough, same, "left_semi")
        .withColumn("s", F.explode(F.sequence(first, last)))
        .groupBy(*document, "s")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .withColumn("m", m)
        .filter(reaches(F.col("_hits"), F.col("m"), F.col("n"), similarity))
        .select("id", "dkey", "item", "n", "m", "s")
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The rows of docs without a benchmark item; all columns as they were.

    Rows are told apart by id and text, so a contaminated row takes no row along that
    only shares its id, null or not.  Other columns may have any names.
    """
    with scratch(docs.sparkSession):
        found = documents_found(docs, benchmark, id_col=id_col, text_col=text_col, **options)
        gone = stored(found.select("id", "dkey").distinct(), "contaminated", keep=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text_or_empty(text_col)).alias("_key"),
    )
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("dkey"))
    return rows.join(small_side(gone, BROADCAST_ROWS), same, "left_anti").select("row.*")
