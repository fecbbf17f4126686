"""The queries over the smallest tables and the pipeline's stages."""

from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
import pytest
from compare_twins import connect, rows_of
from pyspark.sql import functions as F

from legajo.llm import bpe, decontaminate, simhash
from legajo.llm.common import BATCH, RELEASE
from legajo.llm.queries import ORACLES, QUERIES
from legajo.session import ensure_checkpoint_dir


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_has_one_row_per_input(spark, small, name):
    result = QUERIES[name](spark, small)
    table = "pages" if name.startswith("op9_") else "documents"
    source = spark.read.parquet(f"{small}/{table}.parquet")
    if name.startswith("op3_"):
        assert {"doc_id", "item_id"} <= set(result.columns)
    elif name.startswith("op12_"):
        assert result.count() > source.select("lang", "source").distinct().count()
    elif name.startswith("op13_"):
        assert result.filter("depth = 0 and parent_conv_id is null").count() == 1
    else:
        assert result.count() == source.count()
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    result = QUERIES[name](spark, small)
    cursor = connect(small).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(result.columns, result.collect()) == rows_of(columns, cursor.fetchall())


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert docs.select(lower).distinct().count() == before
    result = corpus_pipeline.run(spark, small)
    assert result.count() == before
    texts = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    assert result.join(texts, "doc_id").filter("sha <> decoded_sha256").count() == 0


def test_stages_leave_only_what_their_result_reads(spark, small):
    ensure_checkpoint_dir(spark)
    shared = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    before = set(shared.iterdir())
    near = simhash.drop_near_duplicates(docs)
    clean = decontaminate.drop_contaminated(docs, benchmark)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before)
    assert left == ["contaminated", "near-copies"]
    assert 0 < near.count() < docs.count() and 0 < clean.count() < docs.count()
    assert spark.conf.get(RELEASE) == "false"


def test_token_stage_holds_little_at_once(spark, small, monkeypatch):
    seen, before, split = [], spark.conf.get(BATCH), bpe.split_blocks

    def noted(*args):
        seen.append(args[-1])
        return split(*args)

    def kept(df, name):
        seen.append(spark.conf.get(BATCH))
        return df

    monkeypatch.setattr(bpe, "split_blocks", noted)
    monkeypatch.setattr(corpus_pipeline, "stored", kept)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    result = corpus_pipeline.token_stage(spark, docs, small)
    assert seen == [8 << 20, 8 << 20, "8m"] and spark.conf.get(BATCH) == before
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    same = result.join(texts, "doc_id").filter("sha = decoded_sha256")
    assert same.count() == result.count() == docs.count()
