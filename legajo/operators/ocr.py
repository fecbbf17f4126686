"""OCR result tables: canonical rows, key-values, entities, tables, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import DEFAULT_OCR_MODEL, MAX_OCR_BYTES, OCR_MODELS
from legajo.functions.text import ColumnLike, as_column, bound, contains_any, squeeze, strip


# --- key-values ------------------------------------------------------------------
def normal_key(key: ColumnLike) -> Column:
    bare = strip(F.replace(as_column(key), F.lit(":"), F.lit("")))
    return F.replace(F.lower(bare), F.lit(" "), F.lit("_"))


def normal_value(value: ColumnLike) -> Column:
    return squeeze(value)


def normal_pairs(pairs: ColumnLike) -> Column:
    """Normalised pairs with empty keys and values dropped."""
    tidy = F.transform(
        as_column(pairs),
        lambda p: F.struct(
            normal_key(p["key"]).alias("key"), normal_value(p["value"]).alias("value")
        ),
    )
    return F.filter(tidy, lambda p: (p["key"] != "") & (p["value"] != ""))


def merged_pairs(fields: ColumnLike, pairs: ColumnLike) -> Column:
    """One map: among ``fields`` the last wins, then ``pairs`` add first-seen keys."""
    ordered = F.concat(F.reverse(normal_pairs(fields)), normal_pairs(pairs))

    def first(entries: Column) -> Column:
        return F.filter(
            entries, lambda p, i: F.array_position(entries["key"], p["key"]) == i + 1
        )

    return F.map_from_entries(bound(ordered, first))


# --- canonical rows ------------------------------------------------------------------
def _if_present(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def canonical_rows(raw: DataFrame) -> DataFrame:
    """Uniform OCR rows from rows that may lack or rename parts.

    Known inputs: document_id, text, key_value_pairs or key_values, tables,
    entities, confidence_scores or confidence, page_count, language, metadata
    (map of strings), errors, success.
    """
    meta = F.coalesce(*_if_present(raw, "metadata"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    ))
    named = F.when(
        F.map_contains_key(meta, "source_name") | F.coalesce(meta["file_name"], F.lit("")).isin(""),
        meta,
    ).otherwise(
        F.map_concat(meta, F.create_map(F.lit("source_name"), meta["file_name"]))
    )
    empty_map = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )
    empty_list = F.array().cast("array<string>")
    columns = {
        "text": F.coalesce(*_if_present(raw, "text"), F.lit("")),
        "key_value_pairs": F.coalesce(
            *_if_present(raw, "key_value_pairs", "key_values"), empty_map
        ),
        "page_count": F.coalesce(
            *_if_present(raw, "page_count"), meta["page_count"].try_cast("int"), F.lit(1)
        ),
        "language": F.coalesce(*_if_present(raw, "language"), meta["language"], F.lit("es")),
        "metadata": named,
        "errors": F.coalesce(*_if_present(raw, "errors"), empty_list),
        "success": F.coalesce(*_if_present(raw, "success"), F.lit(False)),
    }
    scores = _if_present(raw, "confidence_scores", "confidence")
    if scores:
        columns["confidence_scores"] = F.coalesce(*scores)
    renamed = [c for c in ("key_values", "confidence") if c in raw.columns]
    return raw.withColumns(columns).drop(*renamed)


# --- entities ---------------------------------------------------------------------------
def normal_entity(text: ColumnLike, category: ColumnLike) -> Column:
    column, kind = as_column(text), as_column(category)
    bare = F.replace(F.replace(column, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return (
        F.when(kind == "Currency", strip(bare))
        .when(kind == "PhoneNumber", F.regexp_replace(column, r"\D", ""))
        .otherwise(column)
    )


def distinct_entities(entities: DataFrame, key: str = "document_id") -> DataFrame:
    """First entity per trimmed content; needs pos, content, category, confidence."""
    trimmed = entities.withColumn("content", strip("content")).filter("content <> ''")
    first = trimmed.groupBy(key, "content").agg(
        F.min(F.struct("pos", "category", "confidence")).alias("first")
    )
    return first.select(
        key,
        "first.pos",
        "content",
        "first.category",
        "first.confidence",
        normal_entity("content", F.col("first.category")).alias("normalized"),
    )


def entity_rows(documents: DataFrame, key: str, entities: str) -> DataFrame:
    """Map of category to values as (key, type, value) rows."""
    return documents.select(key, F.explode(entities).alias("type", "values")).select(
        key, "type", F.explode("values").alias("value")
    )


# --- tables -----------------------------------------------------------------------------------
def table_rows(cells: DataFrame, keys: Sequence[str] = ("document_id", "table_id")) -> DataFrame:
    """Rows of each table as arrays as wide as the table; missing cells are ''.

    Needs row_index, column_index, column_count and text.  A result row never
    holds more than one table row; row 0 is the header.
    """
    place = F.col("pos") if "pos" in cells.columns else F.lit(0)
    rows = cells.groupBy(*keys, "row_index").agg(
        F.max("column_count").alias("column_count"),
        # at most one table row, so as wide as the table
        F.array_sort(
            F.collect_list(F.struct("column_index", place.alias("pos"), "text"))
        ).alias("cells"),
    )
    values = F.transform(
        F.when(
            F.col("column_count") > 0, F.sequence(F.lit(0), F.col("column_count") - 1)
        ).otherwise(F.array().cast("array<int>")),
        lambda i: F.coalesce(
            F.try_element_at(
                F.filter("cells", lambda c: c["column_index"] == i), F.lit(-1)
            )["text"],
            F.lit(""),
        ),
    )
    return rows.select(
        *keys, "row_index", (F.col("row_index") == 0).alias("is_header"), values.alias("row_values")
    )


# --- confidence and gates ------------------------------------------------------------------------
def text_tier(length: Column) -> Column:
    return F.when(length > 1000, 0.9).when(length > 500, 0.7).when(length > 100, 0.5).otherwise(0.3)


def quality_band(overall: Column) -> Column:
    return (
        F.when(overall >= 0.9, "excellent")
        .when(overall >= 0.7, "good")
        .when(overall >= 0.5, "fair")
        .otherwise("poor")
    )


def confidence_scores(
    documents: DataFrame, parts: DataFrame, key: str = "document_id"
) -> DataFrame:
    """Scores per document from its own value and its parts.

    ``documents``: key, confidence (nullable), text_length.  ``parts``: key,
    part ('page', 'table' or 'entity') and confidence.
    """
    means = parts.groupBy(key).agg(
        *[
            F.avg(F.when(F.col("part") == p, F.col("confidence"))).alias(f"{p}_mean")
            for p in ("page", "table", "entity")
        ]
    )
    # rounded so that the order in which page values are summed cannot move a band
    overall = F.round(F.coalesce("confidence", "page_mean", F.lit(0.0)), 9)
    return documents.join(means, key, "left").select(
        key,
        "text_length",
        overall.alias("overall"),
        text_tier(F.col("text_length")).alias("text_extraction"),
        F.coalesce("table_mean", F.lit(0.0)).alias("table_detection"),
        F.coalesce("entity_mean", F.lit(0.0)).alias("entity_recognition"),
        quality_band(overall).alias("quality_assessment"),
    )


def quality_gate(scored: DataFrame) -> DataFrame:
    """Errors for short text and low confidence; success means none."""
    errors = F.array_compact(
        F.array(
            F.when(F.col("text_length") < 50, F.lit("Texto extraído muy corto, posible problema de calidad")),
            F.when(F.col("overall") < 0.5, F.lit("Confianza baja en el reconocimiento")),
        )
    )
    return scored.withColumn("errors", errors).withColumn("success", F.size("errors") == 0)


def size_error(size: ColumnLike) -> Column:
    """Message for files over the size limit, else null."""
    column = as_column(size)
    return F.when(
        column > MAX_OCR_BYTES,
        F.format_string("Archivo demasiado grande: %.2fMB (máx 50MB)", column / (1024.0 * 1024)),
    )


def with_error_rows(results: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Oversized files become empty, failed rows in the same table."""
    message = size_error(size)
    rejected = message.isNotNull()
    return results.withColumns(
        {
            "text": F.when(rejected, F.lit("")).otherwise(F.col("text")),
            "overall": F.when(rejected, 0.0).otherwise(F.col("overall")),
            "errors": F.when(rejected, F.array(message)).otherwise(F.col("errors")),
            "success": F.when(rejected, False).otherwise(F.col("success")),
        }
    )


def ocr_model(name: ColumnLike) -> Column:
    low = F.lower(as_column(name))
    result = F.lit(DEFAULT_OCR_MODEL)
    for model, terms in reversed(list(OCR_MODELS.items())):
        result = F.when(contains_any(low, terms), F.lit(model)).otherwise(result)
    return result


# --- template rows and views ---------------------------------------------------------------------
def template_rows(extracted: DataFrame) -> DataFrame:
    """Extracted rows in report shape: default type, text from OCR when absent."""
    return extracted.withColumns(
        {
            "document_type": F.coalesce("document_type", F.lit("otro")),
            "raw_text": F.coalesce(
                F.when(F.col("raw_text") != "", F.col("raw_text")), F.col("ocr_text"), F.lit("")
            ),
        }
    )


def documents_with_extraction(documents: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    return documents.join(extracted.select(key), key, "left_semi")


def case_documents(
    documents: DataFrame, ocr_results: DataFrame, extracted: DataFrame
) -> DataFrame:
    """Documents with their OCR and extraction where present, sized in KiB."""
    kib = F.when(F.col("size_bytes") > 0, F.col("size_bytes") / 1024.0)
    return (
        documents.join(ocr_results, "document_id", "left")
        .join(extracted, "document_id", "left")
        .withColumns(
            {
                "file_size_kb": kib,
                "raw_text": F.coalesce("raw_text", F.lit("")),
                "document_type": F.coalesce(
                    F.when(F.col("document_type") != "", F.col("document_type")),
                    F.lit("desconocido"),
                ),
            }
        )
    )


def case_header(cases: DataFrame, case_id: str) -> DataFrame:
    """The row of one case; an empty result is an error when it is evaluated."""
    found = cases.filter(F.col("case_id") == case_id)
    missing = found.agg(F.count(F.lit(1)).alias("_n")).select(
        F.when(
            F.col("_n") == 0,
            F.raise_error(F.lit(f"case_id no encontrado: {case_id}")).cast("long"),
        ).otherwise(F.col("_n")).alias("_n")
    )
    # one-row side
    return found.crossJoin(F.broadcast(missing)).drop("_n")


def case_headers(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """The row of every wanted case; an unknown one is an error when it is evaluated."""
    ids = wanted.select("case_id").distinct()
    found = ids.join(cases.withColumn("_found", F.lit(True)), "case_id", "left")
    message = F.concat(F.lit("case_id no encontrado: "), "case_id")
    known = F.when(F.col("_found"), True).otherwise(F.raise_error(message).cast("boolean"))
    return found.filter(known).drop("_found")


def summary_rows(
    documents: DataFrame,
    key: str = "document_id",
    preview: int | None = None,
    most_tables: int | None = None,
) -> DataFrame:
    """Text, lengths, counts and tables.

    ``preview`` shortens the text to so many characters and "..."; documents with
    more than ``most_tables`` tables show none.
    """
    text = F.coalesce("text", F.lit(""))
    shown, tables = text, F.col("tables")
    if preview is not None:
        more = F.when(F.length(text) > preview, "...").otherwise("")
        shown = F.concat(F.substring(text, 1, preview), more)
    if most_tables is not None:
        tables = F.when(F.size("tables") <= most_tables, tables)
    return documents.select(
        key,
        shown.alias("preview"),
        F.length(text).alias("text_length"),
        F.size("tables").alias("n_tables"),
        F.size("key_value_pairs").alias("n_pairs"),
        tables.alias("tables"),
    )
