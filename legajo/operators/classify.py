"""Document classification by weighted keyword rules, and its side tables.

The lexicon is a parameter (a list of ``Rule``).  It is folded into literal
expressions, so a document is scored inside one projection: no cross join with
the rules, no row explosion and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.fixed_values import (
    CLASSIFIER_LEXICON,
    COUNTING_DETECTOR,
    FIRST_HIT_DETECTOR,
    NAME_DETECTOR,
    NO_TYPE_REASON,
    ORGANISER_RECIPIENT_PATTERNS,
    PRIORITY_PROFILES,
    RECIPIENT_PATTERNS,
    UNKNOWN_TYPE_REASON,
)
from legajo.functions.text import contains_any, count_hits, lookup, strip

OTHER = "otro"
SUBNUMBERED = "guias_y_facturas"


class Rule(NamedTuple):
    """Terms of one document type."""

    type_name: str
    keywords: Sequence[str]
    must_have: Sequence[str]
    may_have: Sequence[str]
    exclude: Sequence[str]
    description: str = ""


def default_lexicon() -> list[Rule]:
    return [Rule(*entry) for entry in CLASSIFIER_LEXICON]


# --- scoring ------------------------------------------------------------------
def _counts(rule: Rule, text: Column, name: Column) -> Column:
    """What of one type was found, in one long: weight, hits in the name only, optional terms, gates."""
    weight, name_hits, passes = F.lit(0), F.lit(0), F.lit(True)
    for term in rule.keywords:
        in_text, in_name = text.contains(term.lower()), name.contains(term.lower())
        weight = weight + F.when(in_text, 2).when(in_name, 1).otherwise(0)
        name_hits = name_hits + (~in_text & in_name).cast("int")
    for term in rule.must_have:
        passes = passes & (text.contains(term.lower()) | name.contains(term.lower()))
    passes = passes & ~contains_any(text, [t.lower() for t in rule.exclude])
    optional = count_hits([text], [t.lower() for t in rule.may_have])
    total = F.lit(0).cast("bigint")
    for place, part in enumerate((weight, name_hits, optional, passes.cast("int"))):
        total = total + F.shiftleft(part.cast("bigint"), 12 * place)
    return total


def _confidence(rule: Rule, counts: Column) -> Column:
    """Confidence of one type, null when a gate or the threshold rejects it."""
    weight, names, optional, passes = (
        F.shiftright(counts, 12 * place).bitwiseAND(F.lit(4095)) for place in range(4)
    )
    possible = 2 * len(rule.keywords) + len(rule.may_have)
    if possible:
        score = F.least((weight + optional * 0.5) / F.lit(float(possible)), F.lit(1.0))
    else:
        score = F.lit(0.5 if rule.must_have else 0.0)
    floor = F.lit(0.3) if rule.must_have else F.when((names > 0) & F.col("_blank"), 0.3).otherwise(0.0)
    score = F.greatest(score, floor)
    return F.when((passes > 0) & (score > F.when(names > 0, 0.15).otherwise(0.2)), score)


def _reasons(rules: Sequence[Rule], text: Column, name: Column, place: Column) -> Column:
    """One sentence per hit of the rule at a place: required terms, keywords, optional terms.

    The terms are literal rows looked up by the place, so the plan holds one expression.
    """
    terms = F.get(
        F.array(
            *[
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("term"), F.lit(t.lower()).alias("low"))
                        for kind, some in (("must", r.must_have), ("key", r.keywords), ("may", r.may_have))
                        for t in some
                    ]
                ).cast("array<struct<kind:string,term:string,low:string>>")
                for r in rules
            ]
        ),
        place,
    )

    def sentence(at: Column) -> Column:
        in_text, in_name = text.contains(at["low"]), name.contains(at["low"])
        quoted = F.concat(at["term"], F.lit("'"))
        return (
            F.when(at["kind"] == "must", F.concat(F.lit("Contiene '"), quoted, F.lit(" (requerido)")))
            .when((at["kind"] == "key") & in_text, F.concat(F.lit("texto: '"), quoted))
            .when((at["kind"] == "key") & in_name, F.concat(F.lit("nombre: '"), quoted))
            .when((at["kind"] == "may") & in_text, F.concat(F.lit("puede tener: '"), quoted))
        )

    return F.array_compact(F.transform(terms, sentence))


def classify(
    documents: DataFrame,
    lexicon: Sequence[Rule] | None = None,
    text: str = "text",
    name: str = "filename",
) -> DataFrame:
    """Add document_type, confidence and reasons; ties go to the earlier rule."""
    rules = list(lexicon or default_lexicon())
    low_text, low_name = F.col("_text"), F.col("_name")
    scores = F.array(
        *[
            F.struct(
                _confidence(rule, F.col(f"_counts{position}")).alias("confidence"),
                F.lit(-position).alias("place"),
                F.lit(rule.type_name).alias("type"),
            )
            for position, rule in enumerate(rules)
        ]
    )
    found = F.col("_best.confidence").isNotNull()
    reasons = F.when(found, _reasons(rules, low_text, low_name, -F.col("_best.place"))).otherwise(
        F.array(F.lit(NO_TYPE_REASON))
    )
    scored = (
        documents.withColumns(
            {
                "_text": F.lower(F.coalesce(F.col(text), F.lit(""))),
                "_name": F.lower(F.coalesce(F.col(name), F.lit(""))),
            }
        )
        .withColumn("_blank", strip("_text") == "")
        .withColumns({f"_counts{i}": _counts(r, low_text, low_name) for i, r in enumerate(rules)})
        .withColumn("_best", F.array_max(scores))
        .withColumns(
            {
                "document_type": F.when(
                    F.col("_best.confidence").isNotNull(), F.col("_best.type")
                ).otherwise(F.lit(OTHER)),
                "confidence": F.coalesce(F.col("_best.confidence"), F.lit(0.0)),
            }
        )
        .withColumn("reasons", reasons)
    )
    note = F.concat(F.lit("Destinatario detectado: "), recipient(text))
    return scored.withColumn(
        "reasons",
        F.when(
            (F.col("document_type") == SUBNUMBERED) & note.isNotNull(),
            F.array_append("reasons", note),
        ).otherwise(F.col("reasons")),
    ).drop("_text", "_name", "_best", "_blank", *[f"_counts{i}" for i in range(len(rules))])


# --- recipient ------------------------------------------------------------------
def recipient(
    text: str,
    patterns: Sequence[str] = tuple(RECIPIENT_PATTERNS),
    strip_symbols: bool = False,
) -> Column:
    """First pattern whose match has 4 to 99 characters, else null."""
    found = []
    for pattern in patterns:
        match = strip(F.regexp_extract(F.col(text), f"(?iu){pattern}", 1))
        if strip_symbols:
            match = F.regexp_replace(match, r"(?U)[^\w\s.\-]", "")
        found.append(F.when(F.length(match).between(4, 99), match))
    return F.coalesce(*found)


def organiser_recipient(text: str) -> Column:
    return recipient(text, tuple(ORGANISER_RECIPIENT_PATTERNS), strip_symbols=True)


# --- simple detectors --------------------------------------------------------------
def detect_by_count(
    text: Column, name: Column, terms: Mapping[str, Sequence[str]] = COUNTING_DETECTOR
) -> Column:
    """Type with most terms in text or name; the earlier type wins ties."""
    columns = [F.lower(text), F.lower(name)]
    scores = F.array(
        *[
            F.struct(
                count_hits(columns, words).alias("n"),
                F.lit(-position).alias("place"),
                F.lit(kind).alias("type"),
            )
            for position, (kind, words) in enumerate(terms.items())
        ]
    )
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["type"]).otherwise(F.lit(OTHER))


def detect_first(
    text: Column | None, name: Column, terms: Mapping[str, Sequence[str]] = FIRST_HIT_DETECTOR
) -> Column:
    """First type with any term in the name or, if given, the text."""
    result = F.lit(OTHER)
    for kind, words in reversed(list(terms.items())):
        hit = contains_any(F.lower(name), words)
        if text is not None:
            hit = hit | contains_any(F.lower(text), words)
        result = F.when(hit, F.lit(kind)).otherwise(result)
    return result


def detect_by_name(name: Column, terms: Mapping[str, Sequence[str]] = NAME_DETECTOR) -> Column:
    return detect_first(None, name, terms)


# --- model fallback -------------------------------------------------------------------
def type_guide(lexicon: Sequence[Rule]) -> str:
    lines = [f"- {rule.type_name}: {rule.description}" for rule in lexicon]
    lines.append(f"- {OTHER}: documentos que no encajan en las categorías anteriores")
    return "\n".join(lines)


def fallback_requests(
    classified: DataFrame, lexicon: Sequence[Rule], key: str, text: str = "text",
    name: str = "filename", sample: int | None = None,
) -> DataFrame:
    """Requests for documents the rules left as 'otro'; the call is made outside.

    They hold the whole text, or its first ``sample`` characters.
    """
    shown = F.col(text) if sample is None else F.substring(F.col(text), 1, sample)
    return classified.filter(F.col("document_type") == OTHER).select(
        key,
        F.concat_ws(
            "\n",
            F.lit("Elige uno de estos tipos de documento:"),
            F.lit(type_guide(lexicon)),
            F.concat(F.lit("Archivo: "), F.col(name)),
            F.lit("Texto del documento:"),
            shown,
        ).alias("prompt"),
    )


def ingest_answers(
    answers: DataFrame, valid_types: Sequence[str], key: str, answer: str = "answer",
    max_reasons: int | None = None,
) -> DataFrame:
    """Model answers to (type, confidence, reasons).

    Text that is no JSON, and an answer without type, confidence or reasons, give
    'otro' with confidence 0 and one reason.
    """
    body = strip(
        F.replace(F.replace(F.col(answer), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    )
    parsed = F.from_json(
        body, "document_type STRING, confidence DOUBLE, reasons ARRAY<STRING>"
    )
    known = F.col("_a.document_type").isin([*valid_types, OTHER])
    broken = F.try_parse_json(body).isNull()
    failed_of = (
        broken
        | F.col("_a.document_type").isNull()
        | F.col("_a.confidence").isNull()
        | F.col("_a.reasons").isNull()
    )
    reasons = F.when(known, F.col("_a.reasons")).otherwise(
        F.array_append("_a.reasons", F.lit(UNKNOWN_TYPE_REASON))
    )
    kept = reasons if max_reasons is None else F.slice(reasons, 1, max_reasons)
    error = F.when(F.col("_broken"), "Error parsing LLM").otherwise("Error LLM")
    failed = F.col("_failed")
    flagged = answers.withColumn("_a", parsed).withColumns({"_broken": broken, "_failed": failed_of})
    return flagged.select(
        key,
        F.when(known & ~failed, F.col("_a.document_type"))
        .otherwise(F.lit(OTHER))
        .alias("document_type"),
        F.when(failed, 0.0)
        .when(known, F.col("_a.confidence"))
        .otherwise(F.col("_a.confidence") * 0.5)
        .alias("confidence"),
        F.when(failed, F.array(error))
        .otherwise(kept)
        .alias("reasons"),
    )


# --- metrics ------------------------------------------------------------------------------
def type_priority(kind: str, profile: str = "class") -> Column:
    return lookup(PRIORITY_PROFILES[profile], kind, 99)


def type_distribution(classified: DataFrame, profile: str = "module") -> DataFrame:
    """Count and percent per type, in priority order (99 when unknown)."""
    counts = classified.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per type
    return (
        counts.select(
            "document_type",
            "n",
            F.round(F.col("n") * 100.0 / whole, 1).alias("percent"),
            type_priority("document_type", profile).alias("priority"),
        )
        .orderBy("priority", "document_type")
    )


def classification_metrics(classified: DataFrame, fallback_on: bool = True) -> DataFrame:
    """Totals, the fallback rate as reported, and the share that really falls back."""
    low = (F.col("confidence") < 0.6) & F.lit(fallback_on)
    other = low & (F.col("document_type") == OTHER)
    total = F.count(F.lit(1))
    return classified.agg(
        total.alias("total_files"),
        F.count_if(~low).alias("classified_by_rules"),
        F.count_if(low).alias("classified_by_fallback"),
        F.round(F.try_divide(F.count_if(low), total), 6).alias("fallback_rate"),
        F.count_if(other).alias("true_fallback"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def field_coverage(option_rows: DataFrame) -> DataFrame:
    """Documents with a value, per field, from the long extraction table."""
    return (
        option_rows.filter("value IS NOT NULL AND value <> ''")
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_documents"))
    )
