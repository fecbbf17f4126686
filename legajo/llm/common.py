"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    A cluster job would name it in ``--py-files``; tasks import it from there.
    """
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(
        shutil.make_archive(f"{folder}/{root.name}-code", "zip", root.parent, root.name)
    )
    _SHIPPED["application"] = context.applicationId


_SHIPPED: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Does Spark delete the shuffle files of a query when it has ended?
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders to delete at the end of each open ``scratch``.
_SCRATCH: list[list[str]] = []


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files; else those lie until the driver collects garbage."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


#: Bytes of one Arrow batch between the JVM and a Python task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Queries run inside hand rows to Python in batches of this size, which both sides hold."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside without ``keep`` are deleted at the end; nothing may read them later."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for folder in _SCRATCH.pop():
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(folder)
    with shuffles_released(spark):  # read back from the files, the query does not run again
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_or_empty(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def text_bytes(text: str | Column) -> Column:
    """The text as UTF-8 bytes, empty for null: what the Python tasks decode."""
    return text_or_empty(text).cast("binary")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ``lower`` where a text is all ASCII."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null id: as empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """The stored table with a broadcast hint only if its counted rows stay within the bound.

    Beyond the bound the table is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def decode(data: bytes | None) -> str:
    """UTF-8 bytes as text; invalid sequences become U+FFFD."""
    return (data or b"").decode("utf-8", "replace")


def file_digest(path: str) -> int:
    """crc32 of a vocabulary file: its version in caches."""
    with open(path, "rb") as file:
        return zlib.crc32(file.read())


# White space characters of Unicode and of Python.
WHITE = "".join(
    map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)))
) + "\u2028\u2029\u202f\u205f\u3000"
CROWDED = [" " + c for c in WHITE]
CROWDED_ASCII = [pair for pair in CROWDED if pair.isascii()]


def cuts_at_spaces(text: str) -> bool:
    """Whether every space is single and stands before text.

    Then no match of the pre-token pattern reaches over a space from before it:
    the text can be cut in front of each space and the parts matched on their own.
    """
    pairs = CROWDED_ASCII if text.isascii() else CROWDED
    return not (text.endswith(" ") or any([pair in text for pair in pairs]))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small cuts, so that few texts are held at once; gives memory back at the end."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
    give_memory_back()


def give_memory_back() -> None:
    """Return freed memory to the system: a worker stays for later tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


class Memo(dict):
    """Values by key, computed on first use and emptied at a size bound."""

    def __init__(self, compute, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
