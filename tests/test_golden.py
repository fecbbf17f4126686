"""Golden rows: classification, routes, models, scalar rules, consolidation."""

import pytest
from pyspark.sql import functions as F

from legajo.fixed_values import (
    ALLOWED_FIELDS,
    CLASSIFIER_LEXICON,
    PRIORITY_PROFILES,
    REQUIRED_FIELDS,
    TYPE_ROUTES,
)
from legajo.functions import values as val
from legajo.operators import classify as cls
from legajo.operators import consolidate as con
from legajo.operators import extract as ext
from legajo.operators import feedback as fbk
from legajo.operators import organise as org
from legajo.operators import requests as req
from legajo.operators import validate as chk
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_ORDER, claim_documents
from legajo.plans.classification_queries import _classified

# fixed values: file name and expected type
BY_NAME = {
    "carta_reclamacion_aseguradora.pdf": "carta_de_reclamacion_formal_a_la_aseguradora",
    "reclamacion_transportista.pdf": "carta_de_reclamacion_formal_al_transportista",
    "factura_1234.pdf": "guias_y_facturas",
    "guia_embarque.pdf": "guias_y_facturas",
    "salida_almacen.xlsx": "salida_de_almacen",
    "tarjeta_circulacion.pdf": "tarjeta_de_circulacion_vehiculo",
    "licencia_operador.pdf": "licencia_del_operador",
    "aviso_siniestro.pdf": "aviso_de_siniestro_transportista",
    "GPS_tracking.csv": "reporte_gps",
    "carpeta_investigacion.pdf": "carpeta_de_investigacion",
    "poliza_seguro.pdf": "poliza_de_la_aseguradora",
    "informe_ajustador.pdf": "informe_preliminar_del_ajustador",
    "checklist_antifraude.xlsx": "checklist_antifraude",
    "unknown_document.pdf": "otro",
}
# fixed values: text, expected type, confidence
BY_TEXT = [
    ("CARPETA DE INVESTIGACIÓN FGR/2025/001", "carpeta_de_investigacion", 0.2143),
    ("FACTURA No. 12345 Total: $50,000 Guía de embarque", "guias_y_facturas", 0.26),
    ("PÓLIZA DE SEGURO Cobertura de transporte marítimo", "poliza_de_la_aseguradora", 0.3333),
    ("REPORTE GPS Coordenadas: 19.4326, -99.1332", "reporte_gps", 0.3333),
    ("CHECKLIST ANTIFRAUDE - Evaluación de riesgo", "checklist_antifraude", 0.5263),
]


def one(spark, expression, value, kind="STRING"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(expression("v").alias("x")).first().x


def test_dimension_sizes():
    assert len(REQUIRED_FIELDS) == 14 and len(ALLOWED_FIELDS) == 20
    assert sum(not f for f in ALLOWED_FIELDS.values()) == 10
    assert len(CLASSIFIER_LEXICON) == 16 and len(TYPE_ROUTES) == 16
    assert len(PRIORITY_PROFILES["class"]) == len(PRIORITY_PROFILES["module"]) == 17


def test_classify_by_name(spark):
    frame = spark.createDataFrame([("", n) for n in BY_NAME], "text STRING, filename STRING")
    got = {r.filename: r for r in cls.classify(frame).collect()}
    assert {n: r.document_type for n, r in got.items()} == BY_NAME
    assert all(r.confidence == (0.0 if r.document_type == "otro" else 0.3) for r in got.values())


def test_classify_by_text(spark):
    frame = spark.createDataFrame(
        [(t, "documento.pdf") for t, _, _ in BY_TEXT], "text STRING, filename STRING"
    )
    got = {r.text: r for r in cls.classify(frame).collect()}
    for text, kind, confidence in BY_TEXT:
        assert got[text].document_type == kind
        assert got[text].confidence == pytest.approx(confidence, abs=1e-4)


def test_fixture_type_counts(spark):
    rows = _classified(spark, "/root/testdata/sf0.01").groupBy("document_type").count().collect()
    assert {r.document_type: r["count"] for r in rows} == {
        "t_de": 337, "t_en": 327, "t_fr": 118, "t_es": 105, "otro": 80, "t_license": 22,
        "t_contact": 7, "t_secret": 4,
    }


def test_fixture_decision_counts(spark):
    claims = claim_documents(spark, "/root/testdata/sf0.01")
    rows = con.decisions(con.consolidate(claims, CLAIM_FIELDS, CLAIM_ORDER))
    counted = rows.agg(F.expr("count_if(n_options > 0)"), F.expr("count_if(n_options > 1)")).first()
    assert tuple(counted) == (63937, 31761)
    allowed = {0.0, 0.9, 1.0}
    assert {r.confidence for r in rows.select("confidence").distinct().collect()} <= allowed


def test_routes_and_models(spark):
    frame = spark.createDataFrame([(t, r) for t, r in TYPE_ROUTES.items()], "t STRING, r STRING")
    route = org.extraction_route("t", F.lit("x.pdf"), F.lit(True))
    assert frame.filter(route != F.col("r")).count() == 0
    tasks = [
        ("extraction", "direct_ai", "gpt-5-mini"), ("extraction", "ocr_text", "gpt-5"),
        ("consolidation", "ocr_text", "gpt-5"), ("generation", "ocr_text", "gpt-5-mini"),
        ("otra", "ocr_text", "gpt-4o-mini"),
    ]
    frame = spark.createDataFrame(tasks, "t STRING, r STRING, m STRING")
    assert frame.filter(org.task_model(F.col("t"), F.col("r")) != F.col("m")).count() == 0


@pytest.mark.parametrize(
    "expression, value, expected",
    [
        (val.clean_amount, "$1,234.56", 1234.56),
        (val.clean_amount, "1.234.567,89", 1234567.89),
        (val.clean_amount, "1.234,56", 1.23456),
        (val.clean_amount, "sin dato", None),
        (val.slashed_date, "2024-02-26", "26/02/2024"),
        (val.slashed_date, "5/2/2024", "05/02/2024"),
        (val.slashed_date, "26-ENE-2024", "26-01-2024"),
        (val.rfc_error, "MYK0501234A1", "Día inválido: 34"),
        (lambda c: val.rfc_error(c, fixed=True), "MYK0501234A1", None),
        (val.policy_error, "AX-2024-001", None),
        (val.policy_error, "ABC", "No contiene números"),
        (val.policy_error, "A1", "Muy corto (< 3 caracteres)"),
        (val.amount_error, "$1,000.50 MXN", None),
        (val.amount_error, "0", "Monto debe ser positivo"),
        (val.amount_error, "1000000001", "Monto excesivamente alto"),
        (val.date_error, "31/12/1999", "Año muy antiguo: 1999"),
        (val.date_error, "30/02/2024", "Formato de fecha no reconocido: 30/02/2024"),
        (val.date_error, "12/31/2024", None),
        (val.loss_type, "choque frontal", "Colisión / Choque"),
        (val.loss_type, "incendio en bodega", "Incendio"),
        (val.loss_type, "robo de mercancía", "Robo"),
        (val.display_date, "05.02.2024", "05/02/2024"),
        (val.display_date, "01/02/69", "01/02/1969"),
        (val.display_date, "del 01/01/2025 al 31/12/2025", "01/01/2025"),
        (val.display_money, "$ 1,234.5", "$1,234.50 MXN"),
        (val.display_money, "cien  pesos", "cien pesos"),
    ],
)
def test_scalar_rules(spark, expression, value, expected):
    assert one(spark, expression, value) == expected


def test_claim_number_keeps_digits(spark):
    for value, bad in (("12345678901234", 0), ("ABC12345678901234", 0), ("123", 1)):
        frame = spark.createDataFrame([("x", value)], "document_type STRING, numero_siniestro STRING")
        row = chk.validate_extractions(frame, ["numero_siniestro"]).first()
        assert len(row.errors) == bad


def test_shortened_values_are_kept_as_given(spark):
    rows = [
        ("x", "ABC12345678901234", "uno dos tres cuatro cinco seis"), ("x", "12345678901234", "uno dos"),
        ("x", "12345678901234567", None), ("x", "12", "a b c d e"),
    ]
    frame = spark.createDataFrame(
        rows, "document_type STRING, numero_siniestro STRING, bien_reclamado STRING"
    )
    checked = chk.validate_extractions(frame, ["numero_siniestro", "bien_reclamado"])
    kept = {(r.field, r.value) for r in chk.values_as_given(checked, []).collect()}
    assert kept == {
        ("numero_siniestro", rows[0][1]), ("bien_reclamado", rows[0][2]), ("numero_siniestro", rows[2][1])
    }


def test_most_common_value_takes_the_first_on_ties(spark):
    rows = [("c", i, f"d{i}", "t", v) for i, v in enumerate("xyyx")]
    frame = spark.createDataFrame(
        rows, "case_id STRING, doc_seq INT, source_document STRING, document_type STRING, ajuste STRING"
    )
    got = con.resolve_without_priority(con.options(frame, ["ajuste"], profile=None)).first()
    assert (got.value, got.confidence, got.source_document) == ("x", 0.6, "d0")
    rule = frame.withColumn(
        "source_document", F.when(F.col("doc_seq") == 2, "Peritaje.pdf").otherwise(F.col("source_document"))
    )
    got = con.resolve_without_priority(con.options(rule, ["ajuste"], profile=None)).first()
    assert (got.value, got.confidence, got.source_document) == ("y", 0.8, "Peritaje.pdf")


def test_answers_and_labels(spark):
    answers = spark.createDataFrame(
        [(1, '```json\n{"ajuste": "A", "x": 1}\n```'), (2, "[1]"), (3, '{"ajuste": null}')],
        "id INT, answer STRING",
    )
    rows = {r.id: r for r in ext.ingest_field_answers(answers, fields=["ajuste"]).collect()}
    assert rows[1].ajuste == "A" and rows[1].parsed_ok
    assert rows[2].ajuste is None and not rows[2].parsed_ok
    assert rows[3].ajuste is None
    pairs = spark.createDataFrame(
        [([("Poliza", "X-1"), ("PÓLIZA NO.:", "X-2")],)], "pairs ARRAY<STRUCT<key: STRING, value: STRING>>"
    )
    found = ext.fields_from_pairs(pairs, fields=["numero_poliza"]).first()
    assert found.numero_poliza == "X-2"
    near = spark.createDataFrame([([("polizaa", "X-9")],)], pairs.schema)
    assert ext.fields_from_pairs(near, fields=["numero_poliza"], fuzzy=2).first().numero_poliza == "X-9"
    assert one(spark, fbk.label_field, "Póliza") == "numero_poliza"


def test_open_and_validation_requests(spark):
    frame = spark.createDataFrame(
        [("c", 1, "a.pdf", "poliza", "texto", "P-1")],
        "case_id STRING, doc_seq INT, source_document STRING, document_type STRING, text STRING, "
        "numero_poliza STRING",
    )
    assert "a.pdf" in req.open_requests(frame).first().prompt
    cases = con.consolidate(frame, ["numero_poliza"])
    assert "numero_poliza: P-1" in req.validation_requests(cases).first().prompt
