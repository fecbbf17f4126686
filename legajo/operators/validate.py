"""Field validation: clean rows, violations and a quality summary for whole tables.

Rules are row-local expressions, so validating a table is one projection; only
the summary aggregates (one row per field).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.fixed_values import FIELD_RULES, REQUIRED_FIELDS
from legajo.functions.text import squeeze
from legajo.operators.ranges import covering_counts
from legajo.functions.values import checked_date, date_error, float_error, policy_error, to_number
from legajo.operators.consolidate import may_supply

CRITICAL_FIELDS = [
    "numero_siniestro", "nombre_asegurado", "numero_poliza", "monto_reclamacion",
    "fecha_ocurrencia",
]


def transformed(field: str, value: Column) -> Column:
    """Value after the field's transform and word cap."""
    rules = FIELD_RULES.get(field, {})
    if "digits" in rules:
        return F.substring(F.regexp_replace(value, r"\D", ""), 1, rules["digits"])
    if "max_words" in rules:
        words = F.split(squeeze(value), " ")
        cap = rules["max_words"]
        return F.when(F.size(words) > cap, F.array_join(F.slice(words, 1, cap), " ")).otherwise(
            value
        )
    return value


def field_error(field: str, value: Column, year: Column, number: Column) -> Column:
    """Message of the first broken rule, null when the value is null or valid.

    ``year`` and ``number`` are the value read as a date and as a number.
    """
    rules = FIELD_RULES.get(field, {})
    kind = rules.get("type")
    if kind == "date":
        error = date_error(value, year=year)
    elif kind == "float":
        error = float_error(value, rules.get("min"), number=number)
    else:
        tested = transformed(field, value) if "digits" in rules else value
        error = F.lit(None).cast("string")
        if "max_length" in rules:
            error = F.when(
                F.length(tested) > rules["max_length"],
                F.lit(f"Muy largo (máx: {rules['max_length']})"),
            ).otherwise(error)
        if "min_length" in rules:
            error = F.when(
                F.length(tested) < rules["min_length"],
                F.lit(f"Muy corto (mín: {rules['min_length']})"),
            ).otherwise(error)
        if "regex" in rules:
            error = F.when(
                ~tested.rlike(rules["regex"]), F.lit(f"No cumple formato: {rules['format']}")
            ).otherwise(error)
    return F.when(value.isNotNull(), error)


def validate_extractions(
    extractions: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Masked and validated fields plus ``errors`` (field, message) per document.

    ``as_given`` (field, value) keeps the whole value of each field that a transform or
    word cap changed.
    Types that are unknown or list nothing are not masked here.  An invalid
    value stays as it came.  Readings, messages and values are computed in
    three projections, so each is evaluated once per row.
    """
    allowed = {f: may_supply(f, on_unknown="all", on_empty="all") for f in fields}
    kinds = {f: FIELD_RULES.get(f, {}).get("type") for f in fields}
    dates = [f for f in fields if kinds[f] == "date"]
    numbers = [f for f in fields if kinds[f] == "float"]
    read = extractions.withColumns(
        {
            **{f"_year_{f}": F.year(checked_date(f)) for f in dates},
            **{f"_number_{f}": to_number(f) for f in numbers},
        }
    )
    none = F.lit(None)
    told = read.withColumns(
        {
            f"_message_{f}": F.when(
                allowed[f],
                field_error(
                    f,
                    F.col(f),
                    F.col(f"_year_{f}") if f in dates else none,
                    F.col(f"_number_{f}") if f in numbers else none,
                ),
            )
            for f in fields
        }
    )
    messages = {f: F.col(f"_message_{f}") for f in fields}
    values = {
        f: F.when(
            allowed[f],
            F.when(F.col(f"_message_{f}").isNotNull(), F.col(f)).otherwise(
                transformed(f, F.col(f))
            ),
        )
        for f in fields
    }
    cut = [f for f in fields if FIELD_RULES.get(f, {}).keys() & {"digits", "max_words"}]
    given = {f: F.when(~values[f].eqNullSafe(F.col(f)) & allowed[f], F.col(f)) for f in cut}
    return told.withColumns(
        {
            **values,
            "errors": _present(messages, "message"),
            "as_given": _present(given, "value"),
        }
    ).drop(
        *[f"_year_{f}" for f in dates],
        *[f"_number_{f}" for f in numbers],
        *[f"_message_{f}" for f in fields],
    )


def _present(texts: dict[str, Column], name: str) -> Column:
    """Array of (field, text) of the fields whose text is not null; no lambda, so it is compiled."""
    none = F.array().cast(f"array<struct<field: string, {name}: string>>")
    entries = [
        F.when(text.isNotNull(), F.array(F.struct(F.lit(f).alias("field"), text.alias(name))))
        .otherwise(none)
        for f, text in texts.items()
    ]
    return F.flatten(F.array(*entries)) if entries else none


def violations(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    # inline alone adds a filter on the array, which evaluates every rule once more
    return validated.select(*keys, F.inline_outer("errors")).filter("field IS NOT NULL")


def values_as_given(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The whole values behind those that validation shortened, one row each."""
    return validated.select(*keys, F.inline_outer("as_given")).filter("field IS NOT NULL")


def error_texts(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`field: message` list per document, at most one entry per field."""
    texts = F.transform(
        "errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])
    )
    return validated.select(*keys, F.array_join(texts, "; ").alias("errors"))


def quality_summary(
    validated: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS
) -> DataFrame:
    """Values, violations and share of valid values per field.

    One wide aggregate: each input partition sends a single row.
    """
    broken = F.col("errors.field")
    totals = validated.agg(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.count(F.col(f)).alias("n_values"),
                F.count_if(F.array_contains(broken, f)).alias("n_invalid"),
            ).alias(f)
            for f in fields
        ]
    )
    share = 1 - F.coalesce(F.try_divide("n_invalid", "n_values"), F.lit(0.0))
    return totals.select(F.inline(F.array(*fields))).withColumn("valid_share", F.round(share, 6))


# --- coherence of a consolidated case -------------------------------------------------
def coherence_violations(
    wide: DataFrame, critical: Sequence[str] = tuple(CRITICAL_FIELDS)
) -> DataFrame:
    """Rows (case_id, rule) for every broken rule of the case."""
    occurred = checked_date("fecha_ocurrencia")
    claimed = checked_date("fecha_reclamacion")
    rules = [F.when(occurred > claimed, F.lit("ocurrencia_posterior_a_reclamacion"))]
    if {"vigencia_inicio", "vigencia_fin"} <= set(wide.columns):
        start, end = checked_date("vigencia_inicio"), checked_date("vigencia_fin")
        rules.append(
            F.when((occurred < start) | (occurred > end), F.lit("ocurrencia_fuera_de_vigencia"))
        )
    amount = F.col("monto_reclamacion")
    number = to_number(amount)
    rules.append(
        F.when(
            amount.isNotNull() & ~F.coalesce(number > 0, F.lit(False)), F.lit("monto_no_positivo")
        )
    )
    policy = F.col("numero_poliza")
    rules.append(
        F.when(policy.isNotNull() & policy_error(policy).isNotNull(), F.lit("poliza_invalida"))
    )
    rules += [
        F.when(F.col(f).isNull(), F.lit(f"falta_{f}")) for f in critical if f in wide.columns
    ]
    return wide.select("case_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))




def term_violations(
    wide: DataFrame, terms: DataFrame, start: str = "vigencia_inicio", end: str = "vigencia_fin"
) -> DataFrame:
    """Rows (case_id, rule) of cases that occurred in no term of their policy, or whose policy is invalid.

    A policy may have any number of ``terms`` (numero_poliza, start, end as dates, null
    for an open end), renewals for instance.  A policy without terms breaks no rule.
    """
    dated = wide.select("case_id", "numero_poliza", checked_date("fecha_ocurrencia").alias("occurred"))
    known = terms.select(F.col("numero_poliza").alias("_known")).distinct()
    counted = covering_counts(dated, terms, "case_id", ["numero_poliza"], "occurred", start, end)
    outside = (
        counted.filter("occurred IS NOT NULL AND n_covering = 0")
        .join(known, F.col("numero_poliza") == F.col("_known"), "left_semi")
        .select("case_id", F.lit("ocurrencia_fuera_de_vigencia").alias("rule"))
    )
    invalid = wide.filter(
        F.col("numero_poliza").isNotNull() & policy_error(F.col("numero_poliza")).isNotNull()
    ).select("case_id", F.lit("poliza_invalida").alias("rule"))
    return outside.unionByName(invalid)
