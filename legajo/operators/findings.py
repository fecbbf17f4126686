"""Fraud findings: differences between documents, answers of an analyst model, risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.operators.report import risk_band
from legajo.operators.scaling import beside_fields

ANSWER = (
    "fraud_score DOUBLE, "
    "fraud_indicators ARRAY<STRUCT<description: STRING, weight: DOUBLE, doc_refs: ARRAY<INT>>>, "
    "inconsistencies ARRAY<STRUCT<field: STRING, value_a: STRING, value_b: STRING, "
    "severity: STRING, affected_docs: ARRAY<INT>>>, "
    "external_validations ARRAY<STRUCT<type: STRING, description: STRING, result: STRING, "
    "is_critical: BOOLEAN>>, "
    "route_analysis MAP<STRING, STRING>"
)


# --- deterministic part ---------------------------------------------------------------
def discrepancies(option_rows: DataFrame, order: Sequence[str] = ("doc_seq",)) -> DataFrame:
    """Fields with several values inside a case, each value against the first seen.

    One row per further distinct value, so the output grows with the distinct
    values and never with the pairs of documents.
    """
    values = option_rows.groupBy("case_id", "field", "value").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.min(F.struct(*order, "source_document")).alias("first"),
    )
    return (
        beside_fields(values, first_values(option_rows, order), ["base"])
        .filter(F.col("value") != F.col("base.value"))
        .select(
            "case_id",
            "field",
            F.col("base.value").alias("value_a"),
            F.col("base.source_document").alias("source_a"),
            F.col("value").alias("value_b"),
            F.col("first.source_document").alias("source_b"),
            "n_documents",
        )
    )


def first_values(option_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(case_id, field, base): the first value and its document of fields with several values."""
    return (
        option_rows.groupBy("case_id", "field")
        .agg(
            F.min_by(F.struct("value", "source_document"), F.struct(*order)).alias("base"),
            F.min("value").alias("_low"),
            F.max("value").alias("_high"),
        )
        .filter("_low <> _high")
        .select("case_id", "field", "base")
    )


def discrepant_rows(option_rows: DataFrame, order: Sequence[str] = ("doc_seq",)) -> DataFrame:
    """The rows behind all discrepancies: those that differ from the first value of their field."""
    return (
        beside_fields(option_rows, first_values(option_rows, order), ["base"])
        .filter(F.col("value") != F.col("base.value"))
        .drop("base")
    )


def affected_documents(option_rows: DataFrame, found: DataFrame) -> DataFrame:
    """The documents behind each differing value, in long form."""
    wanted = found.select("case_id", "field", F.col("value_b").alias("value"))
    return option_rows.join(wanted, ["case_id", "field", "value"], "left_semi")


# --- answers ----------------------------------------------------------------------------
def normal_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Analyst answers with safe defaults.

    Text that is no whole JSON value counts as empty; a score counts when it is a
    JSON number or truth value, and 0 otherwise.
    """
    whole = F.try_parse_json(answer)
    parsed = F.when(whole.isNotNull(), F.from_json(answer, ANSWER))
    kind = F.schema_of_variant(F.try_variant_get(whole, "$.fraud_score", "variant"))
    number = F.try_variant_get(whole, "$.fraud_score", "double")
    score = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), number).when(
        kind == "BOOLEAN", F.try_variant_get(whole, "$.fraud_score", "boolean").cast("double")
    )
    return answers.withColumns({"_score": score, "_a": parsed}).select(
        *[c for c in answers.columns if c != answer],
        F.coalesce("_score", F.lit(0.0)).alias("fraud_score"),
        *[
            F.coalesce(f"_a.{name}", F.array()).alias(name)
            for name in ("fraud_indicators", "inconsistencies", "external_validations")
        ],
        F.coalesce("_a.route_analysis", F.create_map()).alias("route_analysis"),
    )


def indicator_rows(analyses: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per indicator and document it refers to (null when none)."""
    return (
        analyses.select(key, F.posexplode("fraud_indicators").alias("pos", "indicator"))
        .select(
            key, "pos", "indicator.description", "indicator.weight",
            F.explode_outer("indicator.doc_refs").alias("doc_index"),
        )
    )


def finding_rows(analyses: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, kind, detail, doc_index) of all three kinds of findings, from one reading of the answers.

    A row per document a finding refers to, one with a null index where it names none.
    """

    def found(kind: str, detail: Column, documents: Column) -> Column:
        none = F.array(F.lit(None).cast("int"))
        return F.transform(
            F.when(F.size(documents) > 0, documents).otherwise(none),
            lambda d: F.struct(
                F.lit(kind).alias("kind"), detail.alias("detail"), d.alias("doc_index")
            ),
        )

    no_document = F.lit(None).cast("array<int>")
    kinds = [
        F.transform(
            "fraud_indicators", lambda i: found("indicator", i["description"], i["doc_refs"])
        ),
        F.transform(
            "inconsistencies",
            lambda i: found(
                "inconsistency",
                F.concat_ws(" ", i["field"], i["severity"], i["value_a"]),
                i["affected_docs"],
            ),
        ),
        F.transform(
            "external_validations",
            lambda v: found("validation", F.concat_ws(" ", v["type"], v["result"]), no_document),
        ),
    ]
    # inline alone adds a filter on the array, which reads the answers once more
    return analyses.select(key, F.inline_outer(F.flatten(F.concat(*kinds)))).filter(
        "kind IS NOT NULL"
    )


def inconsistency_rows(analyses: DataFrame, key: str = "case_id") -> DataFrame:
    return analyses.select(key, F.inline("inconsistencies"))


def validation_rows(analyses: DataFrame, key: str = "case_id") -> DataFrame:
    return analyses.select(key, F.inline("external_validations"))


def risk_rows(analyses: DataFrame, key: str = "case_id") -> DataFrame:
    return analyses.select(
        key,
        "fraud_score",
        risk_band("fraud_score").alias("risk_level"),
        risk_band("fraud_score", upper=False).alias("risk_label"),
    )


# --- document analyses ---------------------------------------------------------------------
def report_points(content: str, longer_than: int = 0, most: int | None = None) -> Column:
    """Texts and list items in order, those longer than a length and the first if limited.

    ``content`` is an array of (name, text, items).
    """
    texts = F.flatten(
        F.transform(
            content,
            lambda e: F.when(e["text"].isNotNull(), F.array(e["text"])).otherwise(
                F.coalesce(e["items"], F.array().cast("array<string>"))
            ),
        )
    )
    kept = F.filter(texts, lambda t: F.length(t) > longer_than)
    return kept if most is None else F.slice(kept, 1, most)


def alerts(anomalies: str, visual: str, contextual: str) -> Column:
    """Alerts of one document: each anomaly, visual alteration, inconsistency."""
    def alert(kind: str, severity: str, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), text.alias("description")
        )

    content = F.transform(
        F.coalesce(F.col(anomalies), F.array().cast("array<string>")),
        lambda a: alert("content", "medium", a),
    )
    others = F.array_compact(
        F.array(
            F.when(
                F.lower(F.col(visual)).contains("alteración"),
                alert("visual", "high", F.lit("Posibles alteraciones visuales detectadas")),
            ),
            F.when(
                F.lower(F.col(contextual)).contains("inconsisten"),
                alert("contextual", "high", F.lit("Inconsistencias entre documentos")),
            ),
        )
    )
    return F.concat(content, others)


def document_analyses(documents: DataFrame, content: str = "content") -> DataFrame:
    """Assembled analysis rows: points for the report and the alerts."""
    return documents.withColumns(
        {
            "report_points": report_points(content),
            "alerts": alerts("anomalies", "visual", "contextual"),
        }
    )
