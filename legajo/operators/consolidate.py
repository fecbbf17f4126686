"""Consolidation: many extractions per case to one decided value per field.

Input is one row per document: ``case_id``, ordering columns, ``source_document``,
``document_type`` and one nullable string column per field.

The priority path is a single aggregation on ``case_id``: every field keeps a
count and its best option (``min_by``), both of which combine before the
shuffle, so a case with a third of all documents leaves each input partition as
one row.  Option lists are never collected into one value; they stay in a long
table beside the decisions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import (
    ALLOWED_FIELDS,
    CONSOLIDATED_FIELDS,
    EMERGENCY_PATTERNS,
    FIELD_SOURCE_RULES,
    FIELD_TYPE_PRIORITIES,
    PRIORITY_PROFILES,
    REQUIRED_FIELDS,
)
from legajo.functions.text import about, lookup, strip
from legajo.operators.scaling import beside_fields

UNKNOWN_PRIORITY = 99


# --- rules as expressions ------------------------------------------------------
def document_type() -> Column:
    return F.coalesce(F.col("document_type"), F.lit("desconocido"))


def may_supply(field: str, on_unknown: str = "all", on_empty: str = "none") -> Column:
    """Whether the document's type may supply the field.

    ``on_unknown`` is for types absent from the allow-list, ``on_empty`` for
    types listed without any field; each is "all" or "none".
    """
    kind = document_type()
    listed = [t for t, fields in ALLOWED_FIELDS.items() if field in fields]
    empty = [t for t, fields in ALLOWED_FIELDS.items() if not fields]
    granted = listed + empty if on_empty == "all" else listed
    if on_unknown == "all":
        return ~kind.isin([t for t in ALLOWED_FIELDS if t not in granted])
    return kind.isin(granted)


def priority(field: str, profile: str) -> Column:
    """Rank of the document's type, 99 when unknown; smaller wins."""
    if profile == "yaml":
        ranks = {t: i for i, t in enumerate(FIELD_TYPE_PRIORITIES.get(field, []), 1)}
        return lookup(ranks, document_type(), UNKNOWN_PRIORITY) if ranks else F.lit(
            UNKNOWN_PRIORITY
        )
    return lookup(PRIORITY_PROFILES[profile], document_type(), UNKNOWN_PRIORITY)


def mask_fields(
    extractions: DataFrame, fields: Sequence[str], on_unknown: str = "all", on_empty: str = "none"
) -> DataFrame:
    """Null out every (type, field) pair the allow-list does not grant."""
    return extractions.withColumns(
        {f: F.when(may_supply(f, on_unknown, on_empty), F.col(f)) for f in fields}
    )


# --- long form -------------------------------------------------------------------
def options(
    extractions: DataFrame,
    fields: Sequence[str] = REQUIRED_FIELDS,
    order: Sequence[str] = ("doc_seq",),
    profile: str | None = "class",
) -> DataFrame:
    """One row per usable (document, field): allowed by type and not null."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.when(may_supply(f), F.col(f)).alias("value"),
                (priority(f, profile) if profile else F.lit(None).cast("int")).alias("priority"),
            )
            for f in fields
        ]
    )
    return (
        extractions.select(
            "case_id", *order, "source_document", document_type().alias("document_type"),
            F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell"),
        )
        .select("case_id", "cell.field", "cell.value", "cell.priority", "source_document",
                "document_type", *order)
    )


# --- priority path: one shuffle ----------------------------------------------------
def consolidate(
    extractions: DataFrame,
    fields: Sequence[str] = REQUIRED_FIELDS,
    order: Sequence[str] = ("doc_seq",),
    profile: str = "class",
    values: bool = False,
) -> DataFrame:
    """One row per case with its decision array; the other tables project from it.

    With ``values`` each field's decided value is a column ``value_<field>`` too: a table that
    reads those alone needs no array, and Spark leaves out the counts and options behind it.
    """
    # evaluated once per document, below the aggregate
    documents = extractions.select(
        "case_id",
        "source_document",
        document_type().alias("document_type"),
        *[F.struct(priority(f, profile), *order).alias(f"place_{f}") for f in fields[:1]],
        *[F.struct(priority(f, profile), *order).alias(f"place_{f}")
          for f in fields[1:] if profile == "yaml"],
        *fields,
        *[F.when(may_supply(f), F.col(f)).alias(f"usable_{f}") for f in fields],
    )
    aggregates = [
        F.count(F.lit(1)).alias("n_documents"),
        F.sort_array(F.collect_set("document_type")).alias("document_types"),
    ]
    for field in fields:
        value = F.col(f"usable_{field}")
        place = F.col(f"place_{field if profile == 'yaml' else fields[0]}")
        option = F.struct(
            value.alias("value"),
            F.col("source_document").alias("source"),
            F.col("document_type").alias("type"),
        )
        aggregates += [
            F.count(value).alias(f"n_{field}"),
            F.count(F.col(field)).alias(f"seen_{field}"),
            F.min_by(option, F.when(value.isNotNull(), place)).alias(f"best_{field}"),
        ]
        if values:
            decided = F.min_by(value, F.when(value.isNotNull(), place))
            aggregates.append(strip(decided).alias(f"value_{field}"))
    per_case = documents.groupBy("case_id").agg(*aggregates)
    return per_case.select(
        "case_id",
        "n_documents",
        "document_types",
        F.array(*[_decision(f) for f in fields]).alias("decisions"),
        *[f"value_{f}" for f in fields if values],
    )


def _decision(field: str) -> Column:
    count, best = F.col(f"n_{field}"), F.col(f"best_{field}")
    only = F.concat(F.lit("Único valor de "), best["source"])
    ranked = F.concat(
        F.lit("Seleccionado de "), best["source"], F.lit(" ("), best["type"],
        F.lit(") por mayor prioridad"),
    )
    return F.struct(
        F.lit(field).alias("field"),
        strip(best["value"]).alias("value"),
        best["source"].alias("source_document"),
        F.when(count == 0, 0.0).when(count == 1, 1.0).otherwise(0.9).alias("confidence"),
        F.when(count == 1, only).when(count > 1, ranked).alias("reasoning"),
        count.alias("n_options"),
        F.col(f"seen_{field}").alias("n_seen"),
    )


def decisions(consolidated: DataFrame) -> DataFrame:
    """Long decision table: every field of every case, empty ones included."""
    return consolidated.select("case_id", F.inline("decisions"))


def with_empty_cases(
    cases: DataFrame, consolidated: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Cases without any extraction get all-null fields with confidence 0."""
    empty = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit(None).cast("string").alias("value"),
                F.lit(None).cast("string").alias("source_document"),
                F.lit(0.0).alias("confidence"),
                F.lit(None).cast("string").alias("reasoning"),
                F.lit(0).cast("long").alias("n_options"),
                F.lit(0).cast("long").alias("n_seen"),
            )
            for f in fields
        ]
    )
    return cases.join(consolidated, "case_id", "left").select(
        "case_id",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("document_types", F.array().cast("array<string>")).alias("document_types"),
        F.coalesce("decisions", empty).alias("decisions"),
    )


def conflicts(consolidated: DataFrame) -> DataFrame:
    """Fields decided among two or more options, also when all options agree."""
    return decisions(consolidated).filter("n_options > 1")


def conflict_options(option_rows: DataFrame, conflict_rows: DataFrame) -> DataFrame:
    """The options behind each conflict, in long form."""
    chosen = conflict_rows.select(
        "case_id", "field", F.col("value").alias("selected"), "reasoning"
    )
    return beside_fields(option_rows, chosen, ["selected", "reasoning"])


def field_value(field: str) -> Column:
    """Value of one field inside the decision array."""
    return F.get(F.filter("decisions", about(field)), 0)["value"]


def wide_cases(consolidated: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """One row per case, one column per field; policy term joined from both ends."""
    given = set(consolidated.columns)
    columns = {f: F.col(f"value_{f}") if f"value_{f}" in given else field_value(f) for f in fields}
    if {"vigencia_inicio", "vigencia_fin"} <= set(fields):
        start, end = columns["vigencia_inicio"], columns["vigencia_fin"]
        columns["vigencia"] = F.when(
            start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" a "), end)
        ).otherwise(F.coalesce(start, end))
    wanted = [f for f in CONSOLIDATED_FIELDS if f in columns]
    wanted += [f for f in fields if f not in wanted]
    known = F.filter("decisions", lambda d: d["reasoning"].isNotNull())
    return consolidated.select(
        "case_id",
        *[columns[f].alias(f) for f in wanted],
        F.map_from_entries(
            F.transform(known, lambda d: F.struct(d["field"], d["reasoning"]))
        ).alias("sources"),
        F.map_from_entries(
            F.transform("decisions", lambda d: F.struct(d["field"], d["confidence"]))
        ).alias("confidences"),
    )


def case_context(consolidated: DataFrame) -> DataFrame:
    """Sorted document types and how many documents gave each field."""
    seen = F.filter("decisions", lambda d: d["n_seen"] > 0)
    counts = F.transform(seen, lambda d: F.concat(d["field"], F.lit("="), d["n_seen"]))
    return consolidated.select(
        "case_id",
        F.array_join("document_types", ", ").alias("document_types"),
        F.array_join(counts, ", ").alias("field_counts"),
    )


def consolidation_metrics(consolidated: DataFrame) -> DataFrame:
    """Filled fields, conflicts and mean confidence of each case."""
    total = F.size("decisions")
    confidence = F.aggregate("decisions", F.lit(0.0), lambda acc, d: acc + d["confidence"])
    return consolidated.select(
        "case_id",
        F.size(F.filter("decisions", lambda d: d["value"].isNotNull())).alias("fields_filled"),
        total.alias("fields_total"),
        F.size(F.filter("decisions", lambda d: d["n_options"] > 1)).alias("n_conflicts"),
        F.round(confidence / F.greatest(total, F.lit(1)), 6).alias("mean_confidence"),
    )


# --- options without priority: source rule, then most common value -------------------
def source_rule_rank() -> Column:
    """Index of the first rule of the field found in the source name, else null."""
    source = F.lower("source_document")
    rank = F.lit(None).cast("int")
    for field, rules in FIELD_SOURCE_RULES.items():
        hit = F.lit(None).cast("int")
        for position in range(len(rules), 0, -1):
            hit = F.when(source.contains(rules[position - 1]), position).otherwise(hit)
        rank = F.when(F.col("field") == field, hit).otherwise(rank)
    return rank


def resolve_without_priority(
    option_rows: DataFrame, order: Sequence[str] = ("doc_seq",)
) -> DataFrame:
    """Decide by source rule (0.8), else by the most frequent value (0.6).

    Values are counted per (case, field, value) first, so neither step holds a
    group's rows together.
    """
    place = F.struct(*order)
    rule = source_rule_rank()
    by_value = option_rows.groupBy("case_id", "field", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(*order, "source_document")).alias("first_option"),
        F.min(
            F.when(rule.isNotNull(), F.struct(rule.alias("rule"), *order, "source_document"))
        ).alias("rule_option"),
    )
    source_of = lambda option: F.col(option)["source_document"]
    first_place = F.struct(*[F.col("first_option")[c] for c in order])
    decided = by_value.groupBy("case_id", "field").agg(
        F.sum("n").alias("n_options"),
        F.min_by(
            F.struct("value", source_of("rule_option").alias("source")), F.col("rule_option")
        ).alias("by_rule"),
        F.min_by(
            F.struct("value", source_of("first_option").alias("source")),
            F.struct(-F.col("n"), first_place),
        ).alias("common"),
    )
    chosen = F.coalesce("by_rule", "common")
    single = F.col("n_options") == 1
    return decided.select(
        "case_id",
        "field",
        chosen["value"].alias("value"),
        chosen["source"].alias("source_document"),
        F.when(single, 1.0)
        .when(F.col("by_rule").isNotNull(), 0.8)
        .otherwise(0.6)
        .alias("confidence"),
        F.when(single, F.concat(F.lit("Único valor de "), chosen["source"]))
        .when(
            F.col("by_rule").isNotNull(),
            F.concat(
                F.lit("Seleccionado de "), chosen["source"],
                F.lit(" por regla de prioridad legacy"),
            ),
        )
        .otherwise(
            F.concat(F.lit("Valor más común entre "), F.col("n_options"), F.lit(" documentos"))
        )
        .alias("reasoning"),
        "n_options",
    )


# --- later changes ------------------------------------------------------------------
def apply_adjustments(decision_rows: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Replace values by (case_id, field, new_value), only where a value exists."""
    return (
        decision_rows.join(adjustments, ["case_id", "field"], "left")
        .withColumn(
            "value",
            F.when(
                F.col("value").isNotNull() & F.col("new_value").isNotNull(), F.col("new_value")
            ).otherwise(F.col("value")),
        )
        .drop("new_value")
    )


def emergency_values(
    consolidated: DataFrame,
    texts: DataFrame,
    order: Sequence[str] = ("doc_seq",),
    patterns: Sequence[tuple[str, str, str, float]] = tuple(EMERGENCY_PATTERNS),
) -> DataFrame:
    """For cases where every field is null: patterns over the raw texts.

    ``texts`` has case_id, the ordering columns, source_document and raw_text.
    The first document (in order) that matches a pattern supplies the field.
    """
    empty = consolidated.filter(
        ~F.exists("decisions", lambda d: d["value"].isNotNull())
    ).select("case_id")
    place = F.struct(*order)
    aggregates = []
    for field, pattern, stripped, _ in patterns:
        found = F.regexp_extract("raw_text", pattern, 1)
        value = strip(found, stripped) if stripped else strip(found)
        option = F.struct(value.alias("value"), F.col("source_document").alias("source"))
        aggregates.append(F.min_by(option, F.when(found != "", place)).alias(field))
    scraped = texts.join(empty, "case_id", "left_semi").groupBy("case_id").agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.col(field)["value"].alias("value"),
                F.concat(F.lit("emergencia:"), F.col(field)["source"]).alias("reasoning"),
                F.lit(confidence).alias("confidence"),
            )
            for field, _, _, confidence in patterns
        ]
    )
    return scraped.select("case_id", F.inline(rows)).filter("value IS NOT NULL")
