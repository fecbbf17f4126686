"""Field extraction: from OCR rows or model answers to clean wide extractions.

An extraction row is one document with one nullable string column per field, so
every step here is a projection; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import (
    AMOUNT_FIELD,
    DATE_FIELDS,
    FIELD_RULES,
    FIELD_SYNONYMS,
    RELEVANT_LINE_TERMS,
    REQUIRED_FIELDS,
)
from legajo.functions.text import (
    ColumnLike,
    as_column,
    bound,
    contains_any,
    strip,
)
from legajo.functions.values import (
    first_pass_amount,
    guided_amount,
    money,
    null_if_token,
    number_text,
    second_pass_amount,
    slashed_date,
)
from legajo.operators.ocr import normal_pairs


# --- content preparation -----------------------------------------------------------
def relevant_sections(
    text: Column,
    terms: Sequence[str] = tuple(RELEVANT_LINE_TERMS),
    max_lines: int | None = None,
    enough: int = 10,
) -> Column:
    """The lines with a term when more than ``enough`` have one, else all lines."""
    lines = F.split(text, "\n")
    marked = F.filter(lines, lambda line: contains_any(F.lower(line), terms))
    chosen = F.when(F.size(marked) > enough, marked).otherwise(lines)
    return F.array_join(first_of(chosen, max_lines), "\n")


def first_of(array: Column, n: int | None) -> Column:
    """The first n elements; all without a limit."""
    return array if n is None else F.slice(array, 1, n)


def first_characters(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def prepared_text(
    text: ColumnLike,
    terms: Sequence[str] = tuple(RELEVANT_LINE_TERMS),
    limit: int | None = None,
    condense_above: int | None = None,
    max_lines: int | None = None,
) -> Column:
    """What a model request holds: the whole text unless a limit is given.

    ``limit`` cuts at a number of characters; texts longer than
    ``condense_above`` keep their relevant lines, ``max_lines`` of them at most.
    """
    head = first_characters(F.coalesce(as_column(text), F.lit("")), limit)
    if condense_above is None:
        return head
    condensed = relevant_sections(head, terms, max_lines)
    return F.when(F.length(head) > condense_above, condensed).otherwise(head)


def text_chunks(documents: DataFrame, size: int, text: str = "text") -> DataFrame:
    """One row per piece of ``size`` characters with ``chunk_no`` from 0; no character is lost.

    An empty or null text is one empty piece.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.ceil(F.length(whole) / size) - 1, F.lit(0)).cast("int")
    rows = documents.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn(text, F.substring(whole, F.col("chunk_no") * size + 1, F.lit(size)))


def trimmed_tables(
    tables: ColumnLike, n_tables: int | None = None, n_rows: int | None = None
) -> Column:
    """Tables with their rows (structs with headers and data_rows), the first ones if limited."""
    return F.transform(
        first_of(as_column(tables), n_tables),
        lambda t: F.struct(
            t["headers"].alias("headers"), first_of(t["data_rows"], n_rows).alias("rows")
        ),
    )


def has_content(text: ColumnLike, pairs: ColumnLike) -> Column:
    return (F.coalesce(as_column(text), F.lit("")) != "") | (
        F.coalesce(F.size(as_column(pairs)), F.lit(0)) > 0
    )


def blank_without_content(
    extractions: DataFrame, content: Column, fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Documents without text and pairs give nulls and a warning."""
    return extractions.withColumns(
        {
            **{f: F.when(content, F.col(f)) for f in fields},
            "warning": F.when(~content, F.lit("no_content")),
        }
    )


# --- label to field -------------------------------------------------------------------
def synonym_map(synonyms: Mapping[str, Sequence[str]] = FIELD_SYNONYMS) -> dict[str, str]:
    """Normalised label to field; the first field claiming a label keeps it."""
    fields: dict[str, str] = {}
    for field, labels in synonyms.items():
        for label in [field, *labels]:
            key = label.replace(":", "").strip().lower().replace(" ", "_")
            fields.setdefault(key, field)
    return fields


def fields_from_pairs(
    documents: DataFrame,
    pairs: str = "pairs",
    fields: Sequence[str] = REQUIRED_FIELDS,
    fuzzy: int = 0,
) -> DataFrame:
    """One column per field from ``pairs`` (array of key/value, in reading order).

    A key equal to a label of the field gives the field; with ``fuzzy`` > 0 a
    second pass takes keys within that edit distance where no key was equal.
    """
    known = synonym_map()
    result = documents.withColumn("_mapped", normal_pairs(pairs))
    columns = {}
    for field in fields:
        labels = [k for k, f in known.items() if f == field]
        exact = F.filter("_mapped", _labelled(labels))
        value = F.get(exact, 0)["value"]
        if fuzzy:
            near = F.filter("_mapped", _near_label(labels, list(known), fuzzy))
            value = F.coalesce(value, F.get(near, 0)["value"])
        columns[field] = value
    return result.withColumns(columns).drop("_mapped")


def _labelled(labels: Sequence[str]):
    """Predicate for pairs whose key is one of the labels."""
    return lambda pair: pair["key"].isin(labels)


def _near_label(labels: Sequence[str], known: Sequence[str], distance: int):
    """Predicate for unmapped pairs whose key is within the edit distance of a label."""

    def near(pair: Column) -> Column:
        hit = F.lit(False)
        for label in labels:
            hit = hit | (F.levenshtein(pair["key"], F.lit(label), distance) >= 0)
        return ~pair["key"].isin(known) & hit

    return near


# --- answers -------------------------------------------------------------------------------
def ingest_field_answers(
    answers: DataFrame, answer: str = "answer", fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Model answers (JSON text, maybe fenced) to the known fields; other keys drop."""

    def from_brace(fenced: Column) -> Column:
        return F.when(
            fenced.contains("{"), F.substring(fenced, F.instr(fenced, "{"), F.length(fenced))
        ).otherwise(fenced)

    def body(text: Column) -> Column:
        unfenced = bound(F.btrim(text, F.lit("`")), from_brace)
        return F.when(text.startswith("```"), unfenced).otherwise(text)

    parsed = F.from_json(bound(strip(F.col(answer)), body), "map<string,string>")
    return (
        answers.withColumn("_fields", parsed)
        .withColumns({f: F.try_element_at("_fields", F.lit(f)) for f in fields})
        .withColumn("parsed_ok", F.coalesce(F.size("_fields") > 0, F.lit(False)))
        .drop("_fields")
    )


def split_rejects(extractions: DataFrame, good: str = "parsed_ok") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows; one bad document never stops the others."""
    return extractions.filter(F.col(good)), extractions.filter(~F.col(good))


# --- cleaning ---------------------------------------------------------------------------------
def clean_extractions(
    extractions: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Null tokens, trimmed dates, and amounts as the text of the number plus DECIMAL.

    The decimal is null where the number does not fit; the text always stays.
    """
    columns, helpers = {}, []
    for field in fields:
        value = F.col(field)
        if field in DATE_FIELDS:
            columns[field] = bound(strip(value), null_if_token)
        elif field == AMOUNT_FIELD:
            # read once, in projections of their own
            first, amount = f"_first_{field}", f"_amount_{field}"
            extractions = extractions.withColumn(first, first_pass_amount(null_if_token(value)))
            extractions = extractions.withColumn(amount, second_pass_amount(F.col(first)))
            columns[field] = F.coalesce(number_text(amount), F.col(first)["text"])
            columns[f"{field}_decimal"] = money(amount)
            helpers += [first, amount]
        else:
            columns[field] = null_if_token(value)
    return extractions.withColumns(columns).drop(*helpers)


def guided_values(extractions: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """The guided chain: claim digits, DD/MM/YYYY dates, plain amounts."""
    columns = {}
    for field in fields:
        rules = FIELD_RULES.get(field, {})
        value = F.col(field)
        if "digits" in rules:
            columns[field] = F.substring(
                F.regexp_replace(value, r"\D", ""), 1, rules["digits"]
            )
        elif rules.get("type") == "date":
            columns[field] = F.when(value == "", value).otherwise(slashed_date(value))
        elif rules.get("type") == "float":
            columns[field] = F.coalesce(number_text(guided_amount(value)), value)
    return extractions.withColumns(columns)


def fill_metrics(extractions: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Filled and total fields of each document."""
    filled = F.lit(0)
    for field in fields:
        filled = filled + F.col(field).isNotNull().cast("int")
    return extractions.withColumns(
        {"fields_filled": filled, "fields_total": F.lit(len(fields))}
    )


def reuse_key(name: ColumnLike, text: ColumnLike) -> Column:
    """Key under which an extraction may be reused: name and whole text."""
    return F.md5(F.concat_ws("\x1f", as_column(name), F.coalesce(as_column(text), F.lit(""))))
