"""File listings and delimited files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.text import extension, file_name, strip
from legajo.operators.organise import is_supported

SEPARATORS = [",", ";", "\t", "|"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly inside a folder: path, length, time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def _usable(profile: str) -> Column:
    return is_supported("path", profile) & ~file_name("path").startswith("._")


def supported(files: DataFrame, profile: str = "organiser") -> DataFrame:
    return files.filter(_usable(profile))


def unsupported(files: DataFrame, profile: str = "organiser") -> DataFrame:
    return files.filter(~_usable(profile))


def require_any(files: DataFrame) -> DataFrame:
    """Fail when the job runs on a folder without a usable file."""
    count = files.agg(F.count(F.lit(1)).alias("_n")).select(
        F.when(
            F.col("_n") == 0,
            F.raise_error(F.lit("No se encontraron documentos para procesar")).cast("long"),
        ).otherwise(F.col("_n")).alias("n_files")
    )
    return count


def folder_counts(files: DataFrame, profile: str = "organiser") -> DataFrame:
    """Supported, unsupported and total files and bytes per folder."""
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    usable = _usable(profile)
    return files.groupBy(folder.alias("folder")).agg(
        F.count_if(usable).alias("n_supported"),
        F.count_if(~usable).alias("n_unsupported"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("total_bytes"),
    )


def listing_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"))


# --- delimited files -----------------------------------------------------------------
def decoded(content: str) -> Column:
    """UTF-8 where valid, else ISO-8859-1."""
    raw = F.col(content)
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def sniffed_separator(line: Column) -> Column:
    """The candidate that occurs most in the header line, ',' on a tie."""
    scores = F.array(
        *[
            F.struct(
                (F.length(line) - F.length(F.replace(line, F.lit(s), F.lit("")))).alias("n"),
                F.lit(-i).alias("place"),
                F.lit(s).alias("separator"),
            )
            for i, s in enumerate(SEPARATORS)
        ]
    )
    return F.array_max(scores)["separator"]


def _unquoted(cell: Column) -> Column:
    bare = strip(cell)
    inner = F.replace(F.regexp_replace(bare, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(bare.rlike('(?s)^".*"$'), inner).otherwise(bare), F.lit(""))


#: A quoted part, which may hold separators, line breaks and doubled quotes.
QUOTED = r'"(?:[^"]++|"")*+"'


def records(text: Column, separator: Column) -> Column:
    """The non-empty records of a text; line breaks inside quoted cells do not end one."""
    starts = F.concat(F.lit(r"(?<![^\Q"), separator, F.lit(r"\E\r\n])"))
    pattern = F.concat(F.lit("(?:"), starts, F.lit(QUOTED + r'|[^"\r\n]++|")++'))
    return F.regexp_extract_all(text, pattern, F.lit(0))


def record_cells(record: Column, separator: Column) -> Column:
    """The cells of a record as written; separators inside quoted cells do not end one."""
    other = F.concat(F.lit(r"[^\Q"), separator, F.lit(r"\E"))
    pattern = F.concat(
        F.lit("((?:(?<!"), other, F.lit("])" + QUOTED + "|"), other, F.lit('"]++|")*+)\\Q'),
        separator, F.lit(r"\E"),
    )
    return F.regexp_extract_all(F.concat(record, separator), pattern, F.lit(1))


def delimited_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Each delimited file as one document: text and one table; empty cells are null.

    Cells may be quoted and then hold separators, line breaks and doubled quotes.
    """
    first_line = F.regexp_extract("_text", r"([^\r\n]+)", 1)
    split = (
        files.withColumn("_text", decoded(content))
        .withColumn("_sep", sniffed_separator(first_line))
        .withColumn("_lines", records(F.col("_text"), F.col("_sep")))
    )
    cells = F.transform(
        "_lines", lambda row: F.transform(record_cells(row, F.col("_sep")), _unquoted)
    )
    return (
        split.withColumn("_cells", cells)
        .select(
            *[c for c in files.columns if c != content],
            F.array_join("_lines", "\n").alias("text"),
            F.array(
                F.struct(
                    F.lit(0).alias("id"),
                    (F.size("_cells") - 1).alias("row_count"),
                    F.size(F.get("_cells", 0)).alias("column_count"),
                    F.get("_cells", 0).alias("headers"),
                    F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))).alias(
                        "data_rows"
                    ),
                )
            ).alias("tables"),
        )
    )


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    return files.filter(extension(file_name("path")) == ".csv")
