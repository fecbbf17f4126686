"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

1. ``split_blocks`` cuts the texts into pre-tokens.  Each block of documents
   numbers its distinct pre-tokens and keeps, per document, those numbers in
   text order (the positions).
2. The distinct words of all blocks are shuffled by word, so that equal words of
   all blocks meet in one task, and ``encode_words`` encodes each of them once.
3. The ids go back to their blocks, and ``assemble`` puts them at the positions.

A plain row per token would shuffle some hundred bytes per word; here words move
as one array per block and shuffle bucket, and positions as packed numbers.
Decoding looks every id up in the token-byte table of the vocabulary file.

Ids are held packed, as little-endian unsigned 32-bit integers, the form in which
token shards are stored; ``octet_length(ids) / 4`` is their number.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import decode, give_memory_back, text_bytes

#: Bytes of text after which a block is closed (a longer text is a block of its own).
BLOCK_BYTES = 48 << 20
#: Pre-tokens in one packed row of positions.
CHUNK_TOKENS = 1 << 20

PIECES = "block string, sign bigint, bucket int, first int, words array<string>"
CODES = "block string, sign bigint, chunk int, doc_ids array<{}>, n_words array<int>, codes binary"


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token
        }


@lru_cache(2)
def build_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(
        "corpus", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}
    )


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class Block:
    """Documents as numbers of distinct pre-tokens."""

    def __init__(self, splitter, keep_codes: bool):
        self.splitter, self.keep_codes, self.numbers = splitter, keep_codes, Numbers()
        self.ids, self.docs, self.size, self.texts = [], [], 0, 0

    def add(self, doc_id, text: str, size: int) -> None:
        words = self.splitter.findall(text)
        codes = np.fromiter(map(self.numbers.__getitem__, words), "<u4", len(words))
        if self.keep_codes:
            self.ids.append(doc_id)
            self.docs.append(codes)
        self.size += size
        self.texts += 1

    def ordered(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, list[str]]], int]:
        """New number of each old one, (bucket, first number, words) per bucket, and a sign."""
        words = list(self.numbers)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), "i8", len(words))
        order = np.argsort(bucket, kind="stable")
        new = np.empty(len(words), "<u4")
        new[order] = np.arange(len(words), dtype="<u4")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows, sign = [], self.texts
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                held = [words[i] for i in order[cuts[b] : cuts[b + 1]]]
                sign = zlib.crc32("\0".join(held).encode(), sign)
                rows.append((b, int(cuts[b]), held))
        return new, rows, sign


def split_blocks(
    docs: DataFrame,
    kind: str,
    buckets: int,
    pattern: str,
    id_col: str,
    text_col: str,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of one kind, ``words`` or ``codes``, of the blocks of docs.

    Both kinds come from one numbering.  The sign of a block tells whether the
    two evaluations saw the same rows; ``assemble`` stops if they did not.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch], splitter) -> Iterator[Block]:
        block = Block(splitter, kind == "codes")
        for batch in batches:
            for doc_id, cell in zip(batch.column(0), batch.column(1), strict=True):
                data = cell.as_py()  # one text at a time
                block.add(doc_id.as_py(), decode(data), len(data))
                if block.size >= block_bytes:
                    yield block
                    block = Block(splitter, kind == "codes")
        if block.texts:
            yield block

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        part = TaskContext.get().partitionId()
        for place, block in enumerate(blocks(batches, regex.compile(pattern))):
            new, rows, sign = block.ordered(buckets)
            block.numbers.clear()
            name = f"{part}-{place}"
            if kind == "words":
                for b, first, words in rows:
                    yield pa.RecordBatch.from_pydict(
                        {"block": [name], "sign": [sign], "bucket": [b], "first": [first], "words": [words]},
                        schema=words_schema,
                    )
                continue
            low = chunk = 0
            while low < len(block.docs):
                high, total = low, 0
                while high < len(block.docs) and (high == low or total < CHUNK_TOKENS):
                    total += len(block.docs[high])
                    high += 1
                codes = new[np.concatenate(block.docs[low:high])] if total else new[:0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [name],
                        "sign": [sign],
                        "chunk": [chunk],
                        "doc_ids": [block.ids[low:high]],
                        "n_words": [[len(d) for d in block.docs[low:high]]],
                        "codes": [zstandard.compress(codes.tobytes(), 3)],
                    },
                    schema=codes_schema,
                )
                low, chunk = high, chunk + 1
        give_memory_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    codes_ddl = CODES.format(id_type)
    words_schema = to_arrow_schema(StructType.fromDDL(PIECES))
    codes_schema = to_arrow_schema(StructType.fromDDL(codes_ddl))
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(packed, PIECES if kind == "words" else codes_ddl)


def encode_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(block, sign, first, lengths, ids) for rows of words that are grouped by bucket."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = build_encoding(ranks_path, pattern)
        known: dict[str, bytes] = {}
        for batch in batches:
            lengths, ids = [], []
            for row in batch.column("words"):
                packed = []
                for word in row.as_py():
                    if (got := known.get(word)) is None:
                        got = np.asarray(encoding.encode_ordinary(word), "<u4").tobytes()
                        known[word] = got
                    packed.append(got)
                lengths.append([len(p) // 4 for p in packed])
                ids.append(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block"),
                    batch.column("sign"),
                    batch.column("first"),
                    pa.array(lengths, pa.list_(pa.int32())),
                    pa.array(ids, pa.list_(pa.int32())),
                ],
                names=["block", "sign", "first", "lengths", "ids"],
            )
        known.clear()
        give_memory_back()

    return words.mapInArrow(
        encoded,
        "block string, sign bigint, first int, lengths array<int>, ids array<int>",
    )


def assemble(codes: DataFrame, words: DataFrame) -> DataFrame:
    """Put the ids of each block's words at their positions: (id, ids packed)."""
    id_type = codes.schema["doc_ids"].dataType.elementType.simpleString()

    def joined(codes: pa.Table, words: pa.Table) -> pa.Table:
        build_encoding.cache_clear()  # all words are encoded when their ids arrive
        if not codes.num_rows:
            raise ValueError("the documents differ between two reads; store them first")
        words = words.sort_by("first")
        lengths = flat_values(words.column("lengths"), np.int64)
        ids = flat_values(words.column("ids"), np.dtype("<i4"))
        del words
        give_memory_back()
        starts = np.cumsum(lengths) - lengths
        tables = []
        for row in codes.sort_by("chunk").to_batches(max_chunksize=1):
            held = np.frombuffer(zstandard.decompress(row.column("codes")[0].as_py()), "<u4")
            if held.size and int(held.max()) >= lengths.size:
                raise ValueError("the documents differ between two reads; store them first")
            n = lengths[held]
            ends = np.cumsum(n)
            total = int(ends[-1]) if n.size else 0
            out = ids[np.repeat(starts[held] - (ends - n), n) + np.arange(total)]
            doc_ends = np.cumsum(row.column("n_words").flatten().to_numpy())
            cuts = np.concatenate([[0], np.concatenate([[0], ends])[doc_ends]]).astype(np.int64)
            data = pa.py_buffer(np.ascontiguousarray(out).tobytes())
            packed = pa.BinaryArray.from_buffers(
                pa.binary(),
                len(doc_ends),
                [None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), data],
            )
            tables.append(pa.table({"id": row.column("doc_ids").flatten(), "ids": packed}))
        return pa.concat_tables(tables)

    keys = ["block", "sign"]
    return (
        codes.groupBy(*keys)
        .cogroup(words.groupBy(*keys))
        .applyInArrow(joined, f"id {id_type}, ids binary")
    )


def flat_values(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All values of a column of lists, in row order."""
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False)) for c in column.chunks]
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: id and packed ``ids`` of the whole text.

    Each match of the pattern is encoded on its own and no special token is
    known.  A null or empty text has no ids (an empty value, not null).  Null and
    repeated document ids are kept row by row.  Other columns are not read.  The
    documents are read twice and must be a table that gives the same rows in the
    same partitions, such as stored files; otherwise the job stops with an error.
    Smaller blocks take less memory of a task and shuffle words that they share more often.
    """
    spark = docs.sparkSession
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = split_blocks(docs, "words", buckets, pattern, id_col, text_col, block_bytes)
    by_word = words.repartition(buckets, "bucket")
    known = encode_words(by_word, ranks_path, pattern)
    codes = split_blocks(docs, "codes", buckets, pattern, id_col, text_col, block_bytes)
    return assemble(codes, known).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the bytes of the packed ids, from the token-byte table.

    The table has one row per token of the vocabulary file, so every task holds
    it whole.  Null ids give null, no ids an empty value; other columns stay.
    """
    place = encoded.columns.index(ids_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                cut = batch.slice(low, 500)
                texts = [
                    None
                    if ids is None
                    else b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    for ids in cut.column(place).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns, pa.array(texts, pa.binary())],
                    names=[*cut.schema.names, "decoded"],
                )
        give_memory_back()

    return encoded.mapInArrow(decoded, f"{ddl}, `decoded` binary")
