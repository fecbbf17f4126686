"""Token counts through a cache keyed by content digest and tokenizer version.

The content digest is SHA-256 of the text (null: empty).  Counts already stored
for this tokenizer file are joined; only distinct contents without one are
encoded, and their counts are appended to the cache.

Texts are shuffled as little as can be: a row whose digest certainly occurs once
(the filter of ``exact_dedup``) and is certainly not cached is encoded in place.
The rest is joined to the cache and made distinct first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import Memo, decode, file_digest, shared_folder, slices, text_bytes
from legajo.llm.exact_dedup import BLOCKS, flag_repeated, repeated_bits

CACHE = "content string, tokenizer bigint, n_tokens bigint"

#: A piece is a run of spaces with what follows, as far as the next space.
PIECES = re.compile(r" *[^ ]+| +")


class SentencePieceCounter:
    """Counts of whole texts by sentencepiece.

    Where the model only has pieces with the space mark at their front (or made
    of marks alone), no merge reaches over a space that follows other text, so
    counts add up over pieces cut there and a bounded memo keeps them.  Any
    other model encodes whole texts.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.cut = all(self.MARK not in p.lstrip(self.MARK) for p in pieces) and self.additive()
        lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.first = Memo(self.whole, 50_000)
        self.later = Memo(lambda piece: self.whole(piece[1:]) if len(piece) > 1 else lone)

    def additive(self) -> bool:
        """Whether the model keeps all spaces and puts one in front of a text."""
        ids = self.model.encode("  a  b ")
        return "".join(map(self.model.id_to_piece, ids)) == self.MARK + "  a  b ".replace(
            " ", self.MARK
        )

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str) -> int:
        if not text or not self.cut or self.MARK in text:
            return self.whole(text)
        if "  " in text or text[0] == " " or text[-1] == " ":
            head, *rest = PIECES.findall(text)
        else:
            head, *rest = text.split(" ")
            rest = map(" ".__add__, rest)
        return self.first[head] + sum(map(self.later.__getitem__, rest))


@lru_cache(2)
def load_counter(path: str) -> SentencePieceCounter:
    return SentencePieceCounter(path)


def encode_counts(contents: DataFrame, tokenizer_path: str) -> DataFrame:
    """(content, text bytes) to (content, n_tokens)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(tokenizer_path)
        for batch in slices(batches):
            counts = [counter.count(decode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return contents.select("content", "text").mapInArrow(counted, "content string, n_tokens bigint")


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``cache`` is a Parquet folder that later calls reuse; without one a new
    folder is used.  A null text counts as empty and has no tokens.  Null and
    repeated ids are kept row by row.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = cache or shared_folder(spark, "token-counts")
    version = F.lit(file_digest(tokenizer_path)).cast("bigint")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(folder)
    known = spark.read.schema(CACHE).parquet(folder).filter(F.col("tokenizer") == version)
    known = known.select("content", "n_tokens")

    text = text_bytes(text_col)
    rows = docs.select(F.sha2(text, 256).alias("content"), text.alias("text"))
    key = F.conv(F.substring("content", 1, 15), 16, 10).cast("bigint")
    rows = rows.withColumn("_key", key)
    cached = known.select(F.explode(F.array(key, key)).alias("_key"))  # twice: never alone
    keys = rows.select("_key").unionByName(cached)
    flagged = flag_repeated(rows, repeated_bits(keys, blocks=BLOCKS), blocks=BLOCKS)
    alone = flagged.filter("not _maybe").select("content", "text")
    shared = (
        flagged.filter("_maybe")
        .select("content", "text")
        .join(known.select("content"), "content", "left_anti")
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    misses = encode_counts(alone.unionByName(shared), tokenizer_path)
    misses.select("content", version.alias("tokenizer"), "n_tokens").write.mode("append").parquet(
        folder
    )

    stored_counts = (
        spark.read.schema(CACHE)
        .parquet(folder)
        .filter(F.col("tokenizer") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        docs.select(
            F.col(id_col), F.sha2(text, 256).alias("content"), F.octet_length(text).alias("n_bytes")
        )
        .join(stored_counts, "content")
        .select(
            id_col,
            F.col("n_bytes").cast("bigint").alias("n_bytes"),
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        )
    )
