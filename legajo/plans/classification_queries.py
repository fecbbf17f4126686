"""Classification, routing and naming over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.fixed_values import (
    NO_TYPE_REASON,
    PRIORITY_PROFILES,
    RECIPIENT_PATTERNS,
    UNKNOWN_TYPE_REASON,
)
from legajo.operators import classify as cls
from legajo.operators import organise as org
from legajo.plans.bindings import table
from legajo.plans.catalog import register
from legajo.plans.document_lexicon import (
    DOCUMENT_DETECTOR,
    DOCUMENT_LEXICON,
    DOCUMENT_NAME_DETECTOR,
    DOCUMENT_RECIPIENT_PATTERNS,
)


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text",
        F.concat("source", F.lit("_"), "doc_id", F.lit(".pdf")).alias("filename"),
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls.classify(named_documents(spark, sf_dir), DOCUMENT_LEXICON)


# --- SQL text ------------------------------------------------------------------
def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]::VARCHAR[]"


def _lexicon_sql(rules) -> str:
    """The rules as rows; terms in lower case, and as they are written."""
    return ",\n".join(
        f"({i}, '{r.type_name}', {_list(t.lower() for t in r.keywords)}, "
        f"{_list(t.lower() for t in r.must_have)}, {_list(t.lower() for t in r.may_have)}, "
        f"{_list(t.lower() for t in r.exclude)})"
        for i, r in enumerate(rules)
    )


_NAMED = """named AS (SELECT doc_id, source, text, concat(source, '_', doc_id, '.pdf') AS filename,
          lower(text) AS t, lower(concat(source, '_', doc_id, '.pdf')) AS n FROM documents)"""


def _classified_sql(rules, named: str) -> str:
    return f"""WITH lexicon(place, type_name, kw, must, may, excl) AS (VALUES {_lexicon_sql(rules)}),
{named},
hits AS (SELECT *,
    list_transform(kw, lambda k: CASE WHEN contains(t, k) THEN 2 WHEN contains(n, k) THEN 1 ELSE 0 END) AS w,
    len(list_filter(may, lambda k: contains(t, k))) AS n_may,
    len(list_filter(must, lambda k: contains(t, k) OR contains(n, k))) AS n_must,
    len(list_filter(excl, lambda k: contains(t, k))) AS n_excl
  FROM named CROSS JOIN lexicon),
scored AS (SELECT *,
    greatest(least((coalesce(list_sum(w), 0) + n_may * 0.5::DOUBLE) / (2 * len(kw) + len(may)), 1.0::DOUBLE),
             CASE WHEN len(must) > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS conf,
    len(list_filter(w, lambda x: x = 1)) AS name_hits
  FROM hits WHERE n_must = len(must) AND n_excl = 0),
boosted AS (SELECT * REPLACE (CASE WHEN name_hits > 0 AND trim(t, E' \\n\\t\\r') = ''
                              THEN greatest(conf, 0.3::DOUBLE) ELSE conf END AS conf) FROM scored),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, place) AS rank,
    array_to_string(list_concat(list_concat(
      list_transform(must, lambda k: concat('Contiene ''', k, ''' (requerido)')),
      list_filter(list_transform(kw, lambda k: CASE WHEN contains(t, k) THEN concat('texto: ''', k, '''')
        WHEN contains(n, k) THEN concat('nombre: ''', k, '''') END), lambda r: r IS NOT NULL)),
      list_transform(list_filter(may, lambda k: contains(t, k)), lambda k: concat('puede tener: ''', k, ''''))),
      ' | ') AS reasons
  FROM boosted WHERE conf > CASE WHEN name_hits > 0 THEN 0.15 ELSE 0.2 END),
classified AS (SELECT d.doc_id, d.source, d.text, d.filename,
    coalesce(k.type_name, 'otro') AS document_type,
    coalesce(k.conf, 0.0) AS confidence, coalesce(k.reasons, '{NO_TYPE_REASON}') AS reasons
  FROM named d LEFT JOIN kept k ON d.doc_id = k.doc_id AND k.rank = 1)
"""


CLASSIFIED = _classified_sql(DOCUMENT_LEXICON, _NAMED)


@register(
    "classified_documents",
    "E1 E2 E3 E4 E5 E6 E7 E8",
    CLASSIFIED
    + "SELECT doc_id, document_type, round(confidence, 6) AS confidence, reasons FROM classified",
)
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, confidence and reasons of every document."""
    return _classified(spark, sf_dir).select(
        "doc_id",
        "document_type",
        F.round("confidence", 6).alias("confidence"),
        F.array_join("reasons", " | ").alias("reasons"),
    )


_SHIPPED = cls.default_lexicon()
_GUIDES = [r.type_name for r in _SHIPPED].index(cls.SUBNUMBERED)


def _terms(column: str) -> list[list[str]]:
    return [list(getattr(rule, column)) for rule in _SHIPPED]


def _nested(column: str) -> str:
    return "[" + ", ".join(_list(terms) for terms in _terms(column)) + "]"


def claim_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with terms of one of the shipped types written below it.

    The type goes by doc_id; two of 18 documents get none.  Every fifth document has its
    first keyword in the file name, every seventh no text of its own.
    """
    kind = F.pmod("doc_id", F.lit(18)).cast("int")

    def of_kind(column: str) -> Column:
        lists = F.array(*[F.array(*[F.lit(t) for t in terms]).cast("array<string>") for terms in _terms(column)])
        return F.coalesce(F.get(lists, kind), F.array().cast("array<string>"))

    def some(column: str, step: int) -> Column:
        return F.filter(of_kind(column), lambda _, i: F.pmod(i + F.col("doc_id"), F.lit(step)) != 0)

    written = F.concat_ws(
        "\n",
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise(""),
        F.array_join(of_kind("must_have"), " y "),
        F.array_join(some("keywords", 3), ", "),
        F.array_join(some("may_have", 2), "; "),
        F.when(kind == _GUIDES, F.concat(F.lit("Destinatario: CLIENTE "), "doc_id")),
    )
    first = F.when(F.col("doc_id") % 5 == 0, F.get(of_kind("keywords"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        written.alias("text"),
        F.concat_ws("_", F.lit("doc"), first, F.concat("doc_id", F.lit(".pdf"))).alias("filename"),
    )


_LETTERS = f"""picked AS (SELECT *, doc_id % 18 AS kind,
    coalesce(list_extract({_nested('must_have')}, (doc_id % 18 + 1)::INT), []::VARCHAR[]) AS p_must,
    coalesce(list_extract({_nested('keywords')}, (doc_id % 18 + 1)::INT), []::VARCHAR[]) AS p_kw,
    coalesce(list_extract({_nested('may_have')}, (doc_id % 18 + 1)::INT), []::VARCHAR[]) AS p_may FROM documents),
lettered AS (SELECT doc_id, source, concat_ws(E'\n', CASE WHEN doc_id % 7 <> 0 THEN text ELSE '' END,
    array_to_string(p_must, ' y '),
    array_to_string(list_filter(p_kw, lambda x, i: (i - 1 + doc_id) % 3 <> 0), ', '),
    array_to_string(list_filter(p_may, lambda x, i: (i - 1 + doc_id) % 2 <> 0), '; '),
    CASE WHEN kind = {_GUIDES} THEN concat('Destinatario: CLIENTE ', doc_id) END) AS text,
  concat_ws('_', 'doc', CASE WHEN doc_id % 5 = 0 THEN p_kw[1] END, concat(doc_id, '.pdf')) AS filename FROM picked),
named AS (SELECT *, lower(text) AS t, lower(filename) AS n FROM lettered)"""
_RECIPIENT = "coalesce(" + ", ".join(
    f"CASE WHEN length(trim(regexp_extract(text, '(?i){p}', 1), E' \\t\\r')) BETWEEN 4 AND 99 "
    f"THEN trim(regexp_extract(text, '(?i){p}', 1), E' \\t\\r') END"
    for p in RECIPIENT_PATTERNS
) + ")"


@register(
    "classified_letters",
    "E1 E2 E3 E4 E5 E6 E7 E8 E11",
    _classified_sql(_SHIPPED, _LETTERS)
    + f"""SELECT doc_id, document_type, round(confidence, 6) AS confidence,
  concat_ws(' | ', reasons, CASE WHEN document_type = '{cls.SUBNUMBERED}'
    THEN concat('Destinatario detectado: ', {_RECIPIENT}) END) AS reasons
FROM classified""".replace("concat('Destinatario detectado: ', ", "('Destinatario detectado: ' || "),
)
def classified_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, confidence and reasons by the shipped lexicon, all its types reached."""
    return cls.classify(claim_letters(spark, sf_dir)).select(
        "doc_id",
        "document_type",
        F.round("confidence", 6).alias("confidence"),
        F.array_join("reasons", " | ").alias("reasons"),
    )


_COUNTED = " , ".join(
    f"({' + '.join(f'''(contains(t, '{w}') OR contains(n, '{w}'))::INT''' for w in words)}) AS n_{kind}"
    for kind, words in DOCUMENT_DETECTOR.items()
)
_COUNT_KINDS = list(DOCUMENT_DETECTOR)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@register(
    "simple_detectors",
    "E12 E13 E14",
    f"""WITH {_NAMED}, counted AS (SELECT doc_id, t, n, {_COUNTED} FROM named),
best AS (SELECT *, greatest({', '.join(f'n_{k}' for k in _COUNT_KINDS)}) AS top FROM counted)
SELECT doc_id,
  CASE WHEN top = 0 THEN 'otro' {' '.join(f"WHEN n_{k} = top THEN '{k}'" for k in _COUNT_KINDS)} END AS by_count,
  CASE {' '.join(f"WHEN {_any('t', w)} OR {_any('n', w)} THEN '{k}'" for k, w in DOCUMENT_DETECTOR.items())}
       ELSE 'otro' END AS by_first_hit,
  CASE {' '.join(f"WHEN {_any('n', w)} THEN '{k}'" for k, w in DOCUMENT_NAME_DETECTOR.items())}
       ELSE 'otro' END AS by_name
FROM best""",
)
def simple_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three small detectors side by side."""
    text, name = F.col("text"), F.col("filename")
    return named_documents(spark, sf_dir).select(
        "doc_id",
        cls.detect_by_count(text, name, DOCUMENT_DETECTOR).alias("by_count"),
        cls.detect_first(text, name, DOCUMENT_DETECTOR).alias("by_first_hit"),
        cls.detect_by_name(name, DOCUMENT_NAME_DETECTOR).alias("by_name"),
    )


@register(
    "recipients",
    "E11",
    """WITH found AS (SELECT doc_id,
    trim(regexp_extract(text, '(\\S+@\\S+)', 1)) AS a,
    trim(regexp_extract(text, '(?i)token = "?([0-9a-f]+)', 1)) AS b FROM documents)
SELECT doc_id, CASE WHEN length(a) BETWEEN 4 AND 99 THEN a
                    WHEN length(b) BETWEEN 4 AND 99 THEN b END AS recipient
FROM found WHERE recipient IS NOT NULL""",
)
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pattern whose match has a usable length."""
    found = cls.recipient("text", DOCUMENT_RECIPIENT_PATTERNS)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", found.alias("recipient"))
        .filter("recipient IS NOT NULL")
    )


@register(
    "fallback_requests",
    "E9",
    CLASSIFIED
    + "SELECT doc_id, md5(array_to_string(['Elige uno de estos tipos de documento:', "
    + "'" + cls.type_guide(DOCUMENT_LEXICON).replace("'", "''") + "'"
    + """, concat('Archivo: ', filename), 'Texto del documento:', text], E'\\n')) AS prompt_md5
FROM classified WHERE document_type = 'otro'""",
)
def fallback_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for the documents no rule recognised."""
    requests = cls.fallback_requests(_classified(spark, sf_dir), DOCUMENT_LEXICON, "doc_id")
    return requests.select("doc_id", F.md5("prompt").alias("prompt_md5"))


_TYPES = [r.type_name for r in DOCUMENT_LEXICON]


@register(
    "ingested_type_answers",
    "E10",
    f"""WITH answers AS (SELECT d.doc_id, l.quality, concat('t_', CASE WHEN source = 'src3' THEN source ELSE lang END) AS kind,
    (50 + 50 * l.quality - 25 * l.toxic) / 100.0::DOUBLE AS conf, source, lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
checked AS (SELECT *, list_contains({_list([*_TYPES, 'otro'])}, kind) AS known,
    source = 'src5' AS broken, source IN ('src7', 'src9') AS lacking FROM answers)
SELECT doc_id,
  CASE WHEN known AND NOT broken AND NOT lacking THEN kind ELSE 'otro' END AS document_type,
  round(CASE WHEN broken OR lacking THEN 0.0 WHEN known THEN conf ELSE conf * 0.5 END, 6) AS confidence,
  CASE WHEN broken THEN 'Error parsing LLM' WHEN lacking THEN 'Error LLM'
       WHEN known AND quality = 1 THEN concat('idioma ', lang, ' | fuente ', source, ' | calidad | cuarta')
       WHEN known THEN concat('idioma ', lang, ' | fuente ', source)
       WHEN quality = 1 THEN concat('idioma ', lang, ' | fuente ', source, ' | calidad | cuarta | {UNKNOWN_TYPE_REASON.replace("'", "''")}')
       ELSE concat('idioma ', lang, ' | fuente ', source, ' | {UNKNOWN_TYPE_REASON.replace("'", "''")}') END AS reasons
FROM checked""",
)
def ingested_type_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an outside model (JSON text, some fenced, some cut off) to rows."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    kind = F.concat(
        F.lit("t_"), F.when(F.col("source") == "src3", F.col("source")).otherwise(F.col("lang"))
    )
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("idioma "), "lang"),
            F.concat(F.lit("fuente "), "source"),
            F.when(F.col("quality") == 1, F.lit("calidad")),
            F.when(F.col("quality") == 1, F.lit("cuarta")),
        )
    )
    body = F.to_json(
        F.struct(
            kind.alias("document_type"),
            F.when(
                F.col("source") != "src7", (50 + 50 * F.col("quality") - 25 * F.col("toxic")) / 100.0
            ).alias("confidence"),
            F.when(F.col("source") != "src9", reasons).alias("reasons"),
        )
    )
    answer = (
        F.when(F.col("source") == "src5", F.substring(body, 1, 20))
        .when(F.col("toxic") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    answers = documents.join(labels, "doc_id").withColumn("answer", answer)
    return cls.ingest_answers(answers, _TYPES, "doc_id").select(
        "doc_id",
        "document_type",
        F.round("confidence", 6).alias("confidence"),
        F.array_join("reasons", " | ").alias("reasons"),
    )


@register(
    "type_distribution",
    "E23 E26",
    CLASSIFIED
    + """, total AS (SELECT count(*) AS total FROM classified)
SELECT document_type, count(*) AS n, round(count(*) * 100.0 / max(total), 1) AS percent,
       99 AS priority
FROM classified, total GROUP BY document_type""",
)
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls.type_distribution(_classified(spark, sf_dir))


@register(
    "claim_type_distribution",
    "E23 E26",
    f"""WITH kinds AS (SELECT list_extract(['informe_preliminar_del_ajustador', 'poliza_de_la_aseguradora',
    'carta_de_reclamacion_formal_a_la_aseguradora', 'carpeta_de_investigacion', 'poliza', 'otro'],
    CAST(l_partkey % 6 + 1 AS INTEGER)) AS document_type FROM lineitem)
SELECT document_type, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 1) AS percent,
       CASE document_type {' '.join(f"WHEN '{t}' THEN {p}" for t, p in PRIORITY_PROFILES["module"].items())}
            ELSE 99 END AS priority
FROM kinds GROUP BY document_type""",
)
def claim_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the claim documents in the order reports list them."""
    from legajo.plans.bindings import CLAIM_TYPES

    kind = F.element_at(
        F.array(*[F.lit(t) for t in CLAIM_TYPES]), (F.col("l_partkey") % 6 + 1).cast("int")
    )
    return cls.type_distribution(
        table(spark, sf_dir, "lineitem").select(kind.alias("document_type"))
    )


@register(
    "classification_metrics",
    "E24",
    CLASSIFIED
    + """SELECT count(*) AS total_files, count(*) FILTER (confidence >= 0.6) AS classified_by_rules,
  count(*) FILTER (confidence < 0.6) AS classified_by_fallback,
  round(count(*) FILTER (confidence < 0.6) / count(*), 6) AS fallback_rate,
  count(*) FILTER (document_type = 'otro') AS true_fallback,
  round(avg(confidence), 6) AS mean_confidence FROM classified""",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls.classification_metrics(_classified(spark, sf_dir))


# --- routing and naming ------------------------------------------------------------
@register(
    "extraction_routes",
    "E15 E16 E17 E18",
    """WITH files AS (SELECT doc_id, text,
    concat(source, '_', doc_id, list_extract(['.pdf', '.JPG', '.png', '.docx', '.csv', '.xlsx'],
           CAST(n_chars % 6 + 1 AS INTEGER))) AS filename,
    list_extract(['.pdf', '.jpg', '.png', '.docx', '.csv', '.xlsx'], CAST(n_chars % 6 + 1 AS INTEGER)) AS ext,
    CASE WHEN lang = 'es' THEN 'poliza_de_la_aseguradora' WHEN lang = 'de' THEN 'reporte_gps'
         ELSE 'denuncia' END AS document_type FROM documents),
marked AS (SELECT *, length(text) < 100 OR
    length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) / length(text)::DOUBLE > 0.3 AS scanned FROM files),
routed AS (SELECT doc_id, scanned,
    CASE WHEN document_type = 'poliza_de_la_aseguradora' THEN 'direct_ai'
         WHEN document_type = 'reporte_gps' THEN 'ocr_text'
         WHEN ext IN ('.jpg', '.png') THEN 'direct_ai'
         WHEN ext = '.pdf' AND scanned THEN 'direct_ai' ELSE 'ocr_text' END AS route,
    CASE WHEN ext IN ('.jpg', '.png') THEN 'direct_ai' ELSE 'ocr_text' END AS organiser_route
  FROM marked)
SELECT *, CASE route WHEN 'direct_ai' THEN 'gpt-5-mini' ELSE 'gpt-5' END AS model FROM routed""",
)
def extraction_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route by type, then extension, then how much of the text is symbols."""
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".JPG", ".png", ".docx", ".csv", ".xlsx")])
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.concat(
            "source", F.lit("_"), "doc_id",
            F.element_at(suffixes, (F.col("n_chars") % 6 + 1).cast("int")),
        ).alias("filename"),
        F.when(F.col("lang") == "es", "poliza_de_la_aseguradora")
        .when(F.col("lang") == "de", "reporte_gps")
        .otherwise("denuncia")
        .alias("document_type"),
    )
    scanned = org.is_scanned(F.col("text"), F.lit(0))
    return files.select("doc_id", "filename", "document_type", scanned.alias("scanned")).select(
        "doc_id",
        "scanned",
        org.extraction_route("document_type", "filename", F.col("scanned")).alias("route"),
        org.organiser_route("filename").alias("organiser_route"),
    ).withColumn("model", org.task_model(F.lit("extraction"), F.col("route")))


_STAGED = (
    CLASSIFIED
    + """, kinds AS (SELECT doc_id, source, filename,
    CASE document_type WHEN 't_de' THEN 'guias_y_facturas' WHEN 't_fr' THEN 'reporte_gps'
         ELSE document_type END AS document_type, reasons FROM classified),
staged AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY filename) AS position,
    CASE WHEN document_type = 'guias_y_facturas' THEN count(*) FILTER (document_type = 'guias_y_facturas')
         OVER (PARTITION BY source ORDER BY filename ROWS UNBOUNDED PRECEDING) END AS sub_number
  FROM kinds)
SELECT source AS batch, filename, position, sub_number,
  CASE WHEN sub_number IS NULL THEN document_type ELSE concat(document_type, '_', sub_number) END AS display_type,
  concat(CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0') ELSE CAST(position AS VARCHAR) END,
    '__', CASE document_type WHEN 'guias_y_facturas' THEN 'GUIA' WHEN 'reporte_gps' THEN 'REPORTE'
                   WHEN 'otro' THEN 'OTROS' ELSE document_type END,
    '__OCR__', regexp_replace(filename, '\\.pdf$', ''), '.pdf') AS staged_name
FROM staged"""
)


@register("staged_files", "E19 E20 E21 E22", _STAGED)
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, sub-number and staged name of each file of its batch."""
    kind = (
        F.when(F.col("document_type") == "t_de", "guias_y_facturas")
        .when(F.col("document_type") == "t_fr", "reporte_gps")
        .otherwise(F.col("document_type"))
    )
    files = _classified(spark, sf_dir).select(
        F.col("source").alias("batch"), "filename", kind.alias("document_type")
    )
    return org.staging_plan(files).select(
        "batch", "filename", "position", "sub_number", "display_type", "staged_name"
    )
