"""Request tables for work done outside (language models, OCR services).

The engine writes requests and reads answers; it makes no call itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.fixed_values import (
    ALLOWED_FIELDS,
    FIELD_RULES,
    FIELD_SYNONYMS,
    LOSS_TYPES,
    RECOGNISED_ADJUSTERS,
    REQUIRED_FIELDS,
)
from legajo.functions.text import lookup
from legajo.operators.consolidate import conflicts, decisions, document_type
from legajo.operators.extract import prepared_text
from legajo.operators.scaling import beside_fields, dense_ordinals, ordinals

# fixed values: notes added to the request of a field or of a document type
FIELD_NOTES = {
    "numero_siniestro": "ignorar el valor anterior",
    "vigencia_inicio": "meses abreviados a número",
    "vigencia_fin": "meses abreviados a número",
    "bien_reclamado": "cinco palabras, sin artículos",
    "monto_reclamacion": "monto total, sin desglose",
    "tipo_siniestro": "valores: " + ", ".join([t for ts in LOSS_TYPES.values() for t in ts][:5]),
    "ajuste": "ajustadores: " + ", ".join(RECOGNISED_ADJUSTERS),
}
TYPE_NOTES = {
    "informe_preliminar_del_ajustador": "número en la tabla principal; ajustador en el encabezado",
    "poliza_de_la_aseguradora": "vigencia como Desde/Hasta; domicilio fiscal completo",
    "carta_de_reclamacion_formal_a_la_aseguradora": "monto total reclamado",
    "carpeta_de_investigacion": "un solo tipo del catálogo",
    "narracion_de_hechos": "un solo tipo del catálogo",
    "declaracion_del_asegurado": "un solo tipo del catálogo",
}


def field_guide(kind: str) -> str:
    """Guide for one document type: its fields with labels, format and notes."""
    lines = []
    for field in ALLOWED_FIELDS[kind]:
        labels = ", ".join(FIELD_SYNONYMS.get(field, [])[:3])
        shape = FIELD_RULES.get(field, {}).get("format", "texto libre")
        lines.append(f"✓ {field}")
        lines.append(f"  etiquetas: {labels}; formato: {shape}")
        if field in FIELD_NOTES:
            lines.append(f"  nota: {FIELD_NOTES[field]}")
    if kind in TYPE_NOTES:
        lines.append(f"documento: {TYPE_NOTES[kind]}")
    return "\n".join(lines)


def guided_requests(
    documents: DataFrame, text: str = "text", name: str = "source_document"
) -> DataFrame:
    """One request per document; null prompt when its type supplies nothing."""
    kinds = {t: fields for t, fields in ALLOWED_FIELDS.items() if fields}
    guide = lookup({t: field_guide(t) for t in kinds}, document_type())
    count = lookup({t: len(fields) for t, fields in kinds.items()}, document_type(), 0)
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("DOCUMENTO: "), F.col(name)),
        F.concat(F.lit("TIPO: "), document_type()),
        guide,
        F.lit("CONTENIDO:"),
        prepared_text(text),
        F.lit("Responder con JSON; lo que falte, null."),
    )
    return documents.withColumns(
        {"n_fields": count, "prompt": F.when(guide.isNotNull(), prompt)}
    )


def open_requests(
    documents: DataFrame,
    text: str = "text",
    name: str = "source_document",
    limit: int | None = None,
) -> DataFrame:
    """Requests without guide: every field and the whole text, or ``limit`` characters of it."""
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("DOCUMENTO: "), F.col(name)),
        F.concat(F.lit("TIPO: "), document_type()),
        F.lit("CAMPOS: " + ", ".join(REQUIRED_FIELDS)),
        prepared_text(text, limit=limit),
    )
    return documents.withColumn("prompt", prompt)


def conflict_request_lines(
    option_rows: DataFrame, order: Sequence[str] = ("doc_seq",), together: int = 100_000
) -> DataFrame:
    """Numbered option lines of each conflict, in priority order, one row per line.

    Lines stay rows: a conflict with very many options never becomes one value, and one
    with more than ``together`` is numbered by several tasks.
    """
    groups = ["case_id", "field"]
    sizes = option_rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_options"))
    wanted = beside_fields(option_rows, sizes.filter("n_options > 1"), ["n_options"])
    in_order = Window.partitionBy(*groups).orderBy("priority", *order)
    small = F.col("n_options") <= together
    placed = wanted.filter(small).withColumn("place", F.row_number().over(in_order).cast("bigint"))
    if not sizes.filter(~small).isEmpty():
        large = dense_ordinals(wanted.filter(~small), groups, ["priority", *order], "place")
        placed = placed.unionByName(large)
    line = F.concat(
        F.col("place"), F.lit(". Valor: '"), F.col("value"), F.lit("' Fuente: "),
        F.col("source_document"), F.lit(" Tipo: "), F.col("document_type"),
    )
    return placed.select(*groups, "n_options", "place", line.alias("line"))


def validation_requests(consolidated: DataFrame) -> DataFrame:
    """One validation request per case that has at least one value."""
    filled = F.filter("decisions", lambda d: d["value"].isNotNull())
    lines = F.transform(filled, lambda d: F.concat(d["field"], F.lit(": "), d["value"]))
    return consolidated.filter(F.size(filled) > 0).select(
        "case_id",
        F.concat_ws(
            "\n",
            F.lit("Valores reunidos del caso:"),
            F.array_join(lines, "\n"),
            F.concat(F.lit("DOCUMENTOS: "), F.col("n_documents")),
            F.concat(F.lit("TIPOS: "), F.array_join("document_types", ", ")),
        ).alias("prompt"),
    )


def merge_model_decisions(consolidated: DataFrame, model_decisions: DataFrame) -> DataFrame:
    """Prefer a model's decision for a conflict; without one the rule stands.

    ``model_decisions``: case_id, field, model_value, model_source,
    model_confidence, model_reasoning.
    """
    conflict = F.col("n_options") > 1
    answered = conflict & F.col("model_value").isNotNull()
    rows = decisions(consolidated).join(model_decisions, ["case_id", "field"], "left")
    changed = {
        "value": "model_value", "source_document": "model_source",
        "confidence": "model_confidence", "reasoning": "model_reasoning",
    }
    return rows.withColumns(
        {c: F.when(answered, F.col(m)).otherwise(F.col(c)) for c, m in changed.items()}
    ).drop(*changed.values())


def first_examples(conflict_rows: DataFrame, n: int = 3) -> DataFrame:
    """First n earlier resolutions of each field; only n rows per field and task move."""
    place = F.row_number().over(Window.partitionBy("field").orderBy("case_id"))
    return conflict_rows.withColumn("place", place).filter(F.col("place") <= n)


def case_payload(
    documents: DataFrame, order: Sequence[str] = ("doc_seq",), text: str = "raw_text"
) -> DataFrame:
    """Compact rows an analysis request is made of: 0-based index, type, text length."""
    others = [c for c in ("entities", "key_value_pairs") if c in documents.columns]
    compact = documents.select(
        "case_id",
        *order,
        F.coalesce("document_type", F.lit("otro")).alias("document_type"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("text_length"),
        *others,
    )
    placed = ordinals(compact, ["case_id"], order, "_place")
    return placed.select(
        "case_id", (F.col("_place") - 1).alias("doc_index"), "document_type", "text_length", *others
    )


__all__ = [
    "case_payload", "conflict_request_lines", "conflicts", "field_guide", "first_examples",
    "guided_requests", "merge_model_decisions", "open_requests", "validation_requests",
]
