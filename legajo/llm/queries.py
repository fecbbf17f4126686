"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import (
    bpe,
    decontaminate,
    divergence,
    exact_dedup,
    html_text,
    language,
    mixture,
    orc_tokens,
    prefix_trie,
    quality,
    simhash,
    token_counts,
    toxicity,
)
from legajo.llm.common import fold, shared_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        @wraps(function)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op2_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two compression dictionaries."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "size_difference",
    )


@register("op3_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@register("op4_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


@register("op5_token_counts")
def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, each distinct text encoded once."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


@register("op6_toxic_passages")
def toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its significant passages."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@register("op7_orc_tokens")
def orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents written and read back."""
    folder = shared_folder(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    orc_tokens.write_token_files(table(spark, sf_dir, "documents"), folder, path)
    return orc_tokens.token_offsets(orc_tokens.read_token_files(spark, folder))


@register("op8_language_spans")
def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its labelled spans."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


@register("op9_main_text")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op10_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, sha256({LOWER_AZ}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM n JOIN g USING (text_sha256)
    """,
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@register("op11_source_mixture")
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the weighted mix of all sources takes of every document."""
    return mixture.mix(table(spark, sf_dir, "documents"))


@register(
    "op12_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT row, lang, source, unnest(words) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
    langs AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
    used AS (SELECT t.lang, t.source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    sizes AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g
      LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY 1, 2),
    p AS (SELECT s.lang, s.source, k.term, coalesce(u.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 2)) // (s.n + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
      FROM sizes s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
      LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
      FROM p WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of every language, and the terms that mark them."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op13_prefix_trie")
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations with its roll-ups."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
