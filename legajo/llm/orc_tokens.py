"""Token ids as ORC files: run-length encoded stripes, row indexes, Bloom filters on the id.

The rows are cut into ranges of document ids and sorted, so the files follow
each other in id order and every file prunes by its id range.  Each row also
carries its file number (``part``) and its place in the file (``ordinal``), from
which the running offset of every document is summed: one row per file goes
through one task, and the rows of a file through a window of their own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.llm.common import cuts_at_spaces, decode, give_memory_back, text_bytes

TOKENS = "doc_id {}, ids array<int>, n_tokens bigint, part int, ordinal bigint"
#: A space in the token texts of byte-level vocabularies.
SPACE = "\u0120"
#: Bytes of text that are encoded at once (a longer text alone).
SLICE_BYTES = 8 << 20


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, with a bounded memo of what texts share.

    Texts are cut in front of single spaces, where no token reaches over; each distinct
    piece goes through the library once.  The memo keeps pieces that some slice repeats.
    """

    LIMIT = 300_000
    JOINED = 1_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids with a space in front
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.known: dict[str, bytes] = {}

    def can_cut(self, text: str) -> bool:
        return not any([s in text for s in self.special]) and cuts_at_spaces(text)

    def each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(one.ids, dtype="<u4").tobytes() for one in found]

    def behind_spaces(self, pieces: list[str]) -> list[bytes]:
        """Ids of a space and each piece.

        Many are encoded as one text, in which the only tokens with a space in front are
        the pieces' first ones.
        """
        out: list[bytes] = []
        for low in range(0, len(pieces), self.JOINED):
            some = [" " + piece for piece in pieces[low : low + self.JOINED]]
            ids = np.frombuffer(self.each(["".join(some)])[0], dtype="<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):  # another kind of vocabulary
                out += self.each(some)
                continue
            data, cuts = ids.tobytes(), [*(starts * 4).tolist(), ids.nbytes]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def look_up(self, pieces: list[str], repeated: np.ndarray) -> list[bytes]:
        """Ids of a space and each of the distinct pieces; new ones that are repeated are kept."""
        found = list(map(self.known.get, pieces))
        new = [place for place, ids in enumerate(found) if ids is None]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        for place, ids in zip(new, self.behind_spaces([pieces[i] for i in new]), strict=True):
            found[place] = ids
            if repeated[place]:
                self.known[pieces[place]] = ids
        return found

    def encode(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all texts in a row, ``end`` after each, and where each text ends.

        Equal to encoding each text at once.  A text is its head, the pieces behind its
        spaces, and the end; one that cannot be cut is a head as a whole.
        """
        n = len(texts)
        cut = list(map(self.can_cut, texts))
        heads = [t.split(" ", 1)[0] if c else t for t, c in zip(texts, cut, strict=True)]
        shown = pa.array([t if c else "" for t, c in zip(texts, cut, strict=True)], pa.large_string())
        split = pc.split_pattern(shown, " ")
        first = split.offsets.to_numpy()[:-1]
        behind = np.ones(len(split.values), dtype=bool)
        behind[first] = False
        coded = split.values.filter(pa.array(behind)).dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = self.look_up(pieces, np.bincount(codes, minlength=len(pieces)) > 1)

        begins = first + np.arange(n)  # every text has a place more, for its end
        ends = np.append(begins[1:], len(behind) + n) - 1
        places = np.full(len(behind) + n, len(found) + n)
        inside = np.ones(len(places), dtype=bool)
        inside[begins] = inside[ends] = False
        places[inside] = codes
        places[begins] = len(found) + np.arange(n)
        table = pa.array([*found, *self.each(heads), end], pa.large_binary())
        joined = table.take(pa.array(places))
        _, offsets, data = joined.buffers()
        cuts = np.frombuffer(offsets, dtype="<i8", count=len(joined) + 1)[ends + 1] // 4
        return np.frombuffer(data, dtype="<i4", count=int(cuts[-1])), cuts


@lru_cache(2)
def load_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def sized_slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Cuts of the batch with some ``size`` bytes of text in its second column."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        until = size + (ends[low - 1] if low else 0)
        high = max(low + 1, int(np.searchsorted(ends, until, side="right")))
        yield batch.slice(low, high - low)
        low = high


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write (doc_id, ids, n_tokens, part, ordinal) in ascending id order.

    A null text has the end id only (no id at all with ``end_id=None``).  Null
    ids come first; rows with one id stay together in an order of their own.
    An empty table gives an empty folder of files.  Other columns are not read.
    """
    end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        part, ordinal = TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in sized_slices(batch, SLICE_BYTES):
                texts = [decode(t) for t in cut.column(1).to_pylist()]
                ids, ends = encoder.encode(texts, end)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(np.full(cut.num_rows, part, dtype=np.int32)),
                        pa.array(np.arange(ordinal, ordinal + cut.num_rows, dtype=np.int64)),
                    ],
                    names=["doc_id", "ids", "n_tokens", "part", "ordinal"],
                )
                ordinal += cut.num_rows
        give_memory_back()

    (
        docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(encoded, TOKENS.format(id_type))
        .write.option("orc.compress", "ZSTD")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(64 << 20))
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """The stored rows; filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema(TOKENS.format(id_type)).orc(folder)


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    batch.column("ordinal"),
                    pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "part", "ordinal", "n_tokens", "ids_crc32"],
            )

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select("doc_id", "ids", "part", "ordinal").mapInArrow(
        digests,
        f"doc_id {id_type}, part int, ordinal bigint, n_tokens bigint, ids_crc32 bigint",
    )
    until = Window.unboundedPreceding
    files = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.sum("_tokens").over(Window.orderBy("part").rowsBetween(until, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("ordinal").rowsBetween(until, -1)
    )
    return (
        rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(files, "part")
        .select(
            "doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
