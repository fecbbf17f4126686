"""Values that a rule names several times are computed once per row; groups are numbered in place."""

from pyspark.sql import functions as F

from legajo.fixed_values import ALLOWED_FIELDS
from legajo.functions import values as val
from legajo.operators import consolidate as con
from legajo.operators import extract as ext
from legajo.operators import findings as fnd
from legajo.operators import ocr
from legajo.operators import requests as req
from legajo.operators import scaling
from legajo.operators import validate as chk
from legajo.plans import catalog

catalog.load()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_amounts_and_dates_are_read_once(spark):
    rows = spark.createDataFrame([("$ 1,234.50 MXN", "05-ENE-2024")], "monto_reclamacion STRING, d STRING")
    cleaned = ext.clean_extractions(rows, ["monto_reclamacion"])
    assert cleaned.first()["monto_reclamacion"] == "1234.5"
    assert cleaned.columns == ["monto_reclamacion", "d", "monto_reclamacion_decimal"]
    assert plan(cleaned).count("regexp_replace(") < 10
    slashed = rows.select(val.slashed_date("d").alias("s"))
    assert slashed.first()["s"] == "05-01-2024"
    assert plan(slashed).count("replace(") < 20
    shown = rows.select(val.display_date("d").alias("s"))
    assert plan(shown).count("trim(") == 1


def test_rules_are_not_evaluated_again_by_a_filter(spark):
    rows = spark.createDataFrame(
        [("1", "a.pdf", "poliza", "ab"), ("2", "b.pdf", "poliza", "Ana")],
        "case_id STRING, source_document STRING, document_type STRING, nombre_asegurado STRING",
    ).filter("case_id > '0'")
    found = chk.violations(chk.validate_extractions(rows, ["nombre_asegurado"]), ["case_id"])
    assert [tuple(r) for r in found.collect()] == [("1", "nombre_asegurado", "Muy corto (mín: 3)")]
    assert plan(found).count("Muy corto") == 1


def test_one_list_decides_who_may_supply(spark):
    kinds = spark.createDataFrame([(t,) for t in [*ALLOWED_FIELDS, "other", None]], "document_type STRING")
    for unknown in ("all", "none"):
        for empty in ("all", "none"):
            got = {
                r[0]: r[1]
                for r in kinds.select(
                    "document_type", con.may_supply("numero_poliza", unknown, empty)
                ).collect()
            }
            for kind, may in got.items():
                if kind not in ALLOWED_FIELDS:
                    assert may == (unknown == "all")
                elif ALLOWED_FIELDS[kind]:
                    assert may == ("numero_poliza" in ALLOWED_FIELDS[kind])
                else:
                    assert may == (empty == "all")


def test_merged_pairs_are_built_once(spark, small):
    query = catalog.QUERIES["merged_pairs"](spark, small)
    assert plan(query).count("map_from_entries") == 1
    row = spark.range(1).select(
        F.expr("array(struct('A:' AS key, 'x' AS value), struct('a' AS key, 'y' AS value))").alias("f"),
        F.expr("array(struct('a' AS key, 'z' AS value), struct('b' AS key, 'w' AS value))").alias("p"),
    )
    assert row.select(ocr.merged_pairs("f", "p").alias("m")).first()["m"] == {"a": "y", "b": "w"}


def test_answers_are_read_once_for_all_findings(spark, small):
    assert plan(catalog.QUERIES["answer_findings"](spark, small)).count("from_json") == 1
    answer = (
        '{"fraud_indicators":[{"description":"i","doc_refs":[]},{"description":"j","doc_refs":[3,4]}],'
        '"inconsistencies":[{"field":"f","value_a":"v"}],"external_validations":[]}'
    )
    rows = spark.createDataFrame([("1", answer), ("2", "{")], "case_id STRING, answer STRING")
    found = fnd.finding_rows(fnd.normal_answers(rows)).collect()
    assert len(found) == 4 and {tuple(r) for r in found} == {
        ("1", "indicator", "i", None), ("1", "indicator", "j", 3), ("1", "indicator", "j", 4),
        ("1", "inconsistency", "f v", None),
    }


def test_answers_and_labels_are_joined_and_parsed_once(spark, small):
    assert plan(catalog.QUERIES["ingested_field_answers"](spark, small)).count("from_json") == 1
    assert plan(catalog.QUERIES["fields_from_labels"](spark, small)).count("Join ") == 1


def test_records_and_folders_decide_only_their_fields(spark, small):
    for name in ("stored_cases", "final_folders"):
        assert "fecha_ocurrencia" not in plan(catalog.QUERIES[name](spark, small))


def test_groups_are_numbered_in_place_and_large_ones_by_ranges(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 700, "hot")
        .otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("g"), "id",
    )
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want[r["id"]] = (r["g"], sum(g == r["g"] for g, _ in want.values()) + 1)
    for together in (5, 50, 100_000):
        got = scaling.ordinals(rows, ["g"], ["id"], "n", together).collect()
        assert {r["id"]: (r["g"], r["n"]) for r in got} == want
    documents = rows.select(
        F.col("g").alias("case_id"), F.col("id").alias("doc_seq"), F.lit("abc").alias("raw_text"),
        F.lit(None).cast("string").alias("document_type"),
    )
    payload = req.case_payload(documents)
    assert payload.columns == ["case_id", "doc_index", "document_type", "text_length"]
    assert "RepartitionByExpression" not in plan(payload) and payload.count() == 1000


def test_reports_need_no_counts_and_no_arrays(spark, small):
    run = plan(catalog.QUERIES["full_case_run"](spark, small))
    assert "count(" not in run and "array(struct(" not in run
    rows = spark.createDataFrame(
        [("1", i, f"{i}.pdf", "poliza", v) for i, v in enumerate((None, " Ana ", "Eva"))] + [("2", 0, "0.pdf", "poliza", None)],
        "case_id STRING, doc_seq INT, source_document STRING, document_type STRING, nombre_asegurado STRING",
    )
    fields = ["nombre_asegurado"]
    plain = con.consolidate(rows, fields)
    with_values = con.consolidate(rows, fields, values=True)
    want = {r["case_id"]: (r["nombre_asegurado"], r["sources"], r["confidences"]) for r in con.wide_cases(plain, fields).collect()}
    got = {r["case_id"]: (r["nombre_asegurado"], r["sources"], r["confidences"]) for r in con.wide_cases(with_values, fields).collect()}
    assert got == want and got["1"][0] == "Ana" and got["2"][0] is None
    assert with_values.drop("value_nombre_asegurado").schema == plain.schema
