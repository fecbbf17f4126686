"""Exact duplicates by two Bloom passes; only possibly repeated rows are shuffled.

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty.  Pass one hashes every text to three bits of a 64-bit block and counts
the hits of each bit; only bits hit twice or more are kept.  Pass two tests each
row against those bits: a row with a bit hit once is certainly unique and goes
straight through.  The rest, with few false alarms, is grouped by SHA-256.

The filter grows with the counted texts (at most ``LOAD`` of them to a block), so
that false alarms stay at some three in a hundred at any size.  Up to ``blocks``
blocks it is broadcast, which has a proven bound (rows of two longs).  A larger
filter is a table dealt out by block: hashes, ids and digests go to their blocks,
texts do not.  The result never depends on the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import ascii_lower, stored, text_or_empty

#: Largest broadcast of the filter: 2^19 rows of two longs, some 30 MB.
BLOCKS = 1 << 19
#: Texts to a block of 64 bits, at most.
LOAD = 8
#: Parts of a block in a filter that is not broadcast, for texts that very many rows share.
SALTS = 16
#: Groups above this share of the rows are sent back by broadcast: fewer groups than this.
LARGE = 1 << 15


def normalised_text(text_col: str) -> Column:
    return ascii_lower(text_or_empty(text_col))


def quick_hash(text_col: str) -> Column:
    """A hash that equal texts share; full lower-casing is coarser than A-Z alone."""
    return F.xxhash64(F.lower(text_or_empty(text_col)))


def bit_of(key: Column, turn: int) -> Column:
    """The turn-th bit position (0 to 63) of a hash, from bits the block does not use."""
    return F.shiftrightunsigned(key, 40 + 8 * turn).bitwiseAND(F.lit(63)).cast("int")


def block_of(key: Column, blocks: int) -> Column:
    return key.bitwiseAND(F.lit(blocks - 1))


def blocks_for(texts: int) -> int:
    """The blocks of a filter for so many texts, a power of two."""
    return 1 << max(10, (max(texts, 1) - 1).bit_length() - LOAD.bit_length() + 1)


def repeated_bits(keys: DataFrame, key: str = "_key", blocks: int = BLOCKS) -> DataFrame:
    """Per block the bits that two or more of the keys hit: (_block, _bits)."""
    if blocks < 1 or blocks & (blocks - 1):
        raise ValueError("blocks must be a power of two")
    hits = keys.select(
        block_of(F.col(key), blocks).alias("_block"),
        F.explode(F.array_distinct(F.array(*[bit_of(F.col(key), t) for t in range(3)]))).alias(
            "_bit"
        ),
    )
    twice = hits.groupBy("_block", "_bit").count().filter("count > 1")
    return twice.groupBy("_block").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_bits")
    )


def salted_join(rows: DataFrame, side: DataFrame, key: str, side_key: str) -> DataFrame:
    """Left join with a side of one small row per key, which is sent to ``SALTS`` parts of its key."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    names = [c for c in rows.columns if c in ("_id", "_key")]
    spread = F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")
    return (
        rows.withColumn("_part", spread)
        .join(
            side.withColumn("_salt", salts),
            (F.col(key) == F.col(side_key)) & (F.col("_part") == F.col("_salt")),
            "left",
        )
        .drop("_part", "_salt")
    )


def flag_repeated(
    rows: DataFrame,
    bits: DataFrame,
    key: str = "_key",
    blocks: int = BLOCKS,
    broadcast: int = BLOCKS,
) -> DataFrame:
    """The rows with ``_maybe``: whether every bit of the key was hit twice.

    A filter of more than ``broadcast`` blocks is joined by a shuffle of the rows, each
    block in ``SALTS`` parts.
    """
    shift = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_of(F.col(key), t))
        for t in range(3)
    ]
    mask = shift[0].bitwiseOR(shift[1]).bitwiseOR(shift[2])
    rows = rows.withColumn("_at", block_of(F.col(key), blocks))
    if blocks <= broadcast:
        probed = rows.join(F.broadcast(bits), F.col("_at") == F.col("_block"), "left")
    else:
        probed = salted_join(rows, bits, "_at", "_block")
    held = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(mask) == mask
    return probed.withColumn("_maybe", held).drop("_at", "_block", "_bits")


def flagged_rows(rows: DataFrame, blocks: int) -> DataFrame:
    """Stored rows with ``_key`` as rows with ``_maybe``, by a filter of their size."""
    size = blocks_for(rows.count())
    bits = stored(repeated_bits(rows.select("_key"), blocks=size), "bits")
    return flag_repeated(rows, bits, blocks=size, broadcast=blocks)


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays.  A null id is below every other id and
    stays only where no equal text has an id.  Rows that repeat both id and text
    are counted each and share one decision.  No row in, no row out.  Other
    columns are not read.
    """
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        quick_hash(text_col).alias("_key"),
        F.sha2(normalised_text(text_col), 256).alias("text_sha256"),
    )
    flagged = stored(flagged_rows(stored(keyed, "keys"), blocks).drop("_key"), "texts")
    maybe = flagged.filter("_maybe")
    groups = stored(
        maybe.groupBy("text_sha256").agg(
            F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    # rows of the few largest groups meet their group in place, all others by a shuffle
    large = F.col("group_size") > F.lit(maybe.count() // LARGE)
    in_place = F.broadcast(groups.filter(large))
    grouped = maybe.join(in_place, "text_sha256").unionByName(
        maybe.join(in_place.select("text_sha256"), "text_sha256", "left_anti").join(
            groups.filter(~large), "text_sha256"
        )
    )
    single = flagged.filter("not _maybe").select(
        "*", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")
    )
    return single.unionByName(grouped).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS
) -> DataFrame:
    """The rows of docs without repeated texts, all columns as they were.

    Certainly unique rows are passed on in place.  Of each group of equal texts
    the row with the largest id stays; of rows equal in id and text, one.
    """
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
        F.col(id_col).alias("_id"),
        quick_hash(text_col).alias("_key"),
        text_or_empty(text_col).alias("_text"),
    )
    keys = stored(rows.select("_key"), "keys")
    size = blocks_for(keys.count())
    bits = stored(repeated_bits(keys, blocks=size), "bits")
    if size > blocks:  # hashes meet the filter, rows then meet the hashes that it holds back
        maybe = flag_repeated(keys.distinct(), bits, blocks=size, broadcast=blocks)
        repeated = stored(maybe.filter("_maybe").select("_key"), "repeated")
        repeated = repeated.withColumnRenamed("_key", "_again")
        flagged = salted_join(rows, repeated, "_key", "_again").withColumn(
            "_maybe", F.col("_again").isNotNull()
        )
    else:
        flagged = flag_repeated(rows, bits, blocks=size, broadcast=blocks)
    winners = (
        flagged.filter("_maybe")
        .select("_row", "_id", F.sha2(ascii_lower(F.col("_text")), 256).alias("_sha"))
        .groupBy("_sha")
        .agg(F.max_by("_row", F.struct("_id")).alias("_row"))  # a row per task and text moves
    )
    kept = flagged.filter("not _maybe").select("_row").unionByName(winners.select("_row"))
    return kept.select("_row.*")
