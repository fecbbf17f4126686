"""A table of case records that replaces whole cases, read either before or after a write.

Rows lie in buckets of the case id.  A write puts new versions of the touched buckets
beside the old ones, in a folder of its own, and then appends one file to the log of
manifests: a row per bucket with the folder that holds it.  That file appears by one
rename, so a reader takes the newest complete manifest and sees all of a write or
nothing; a writer that dies before leaves files no manifest names.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.session import stored

MANIFEST = "version BIGINT, bucket INT, folder STRING"


def create(spark: SparkSession, path: str) -> None:
    """An empty table; its first manifest names no bucket."""
    _switch(spark.createDataFrame([(0, None, None)], MANIFEST), path)


def _switch(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifests")


def manifest_of(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version and the folder of each bucket (one row per bucket)."""
    log = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    newest = log.agg(F.max("version")).first()[0]
    rows = log.filter(F.col("version") == newest).filter("bucket IS NOT NULL").collect()
    return newest, {r["bucket"]: r["folder"] for r in rows}


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest version."""
    return _rows(spark, path, schema, manifest_of(spark, path)[1])


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: dict[int, str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths)


def replace_cases(rows: DataFrame, path: str, case: str = "case_id", buckets: int = 64) -> int:
    """Put the given rows in the place of all stored rows of their cases; the new version.

    Only buckets with a written case are rewritten.  ``buckets`` bounds a manifest and must
    stay the same for a table.  Null cases are a case.
    """
    spark = rows.sparkSession
    version, folders = manifest_of(spark, path)
    bucket = F.pmod(F.xxhash64(case), F.lit(buckets)).cast("int")
    written = stored(rows, "written-cases")
    touched = [r[0] for r in written.select(bucket).distinct().collect()]  # ``buckets`` at most
    old = _rows(spark, path, rows.schema, {b: folders[b] for b in touched if b in folders})
    cases = written.select(F.col(case).alias("_case")).distinct()
    kept = old.join(cases, F.col(case).eqNullSafe(F.col("_case")), "left_anti")
    folder = f"{version + 1}-{uuid.uuid4().hex}"
    (
        kept.unionByName(written)
        .withColumn("bucket", bucket)
        .hint("rebalance", "bucket")  # large buckets and cases are split
        .write.partitionBy("bucket")
        .parquet(f"{path}/data/{folder}")
    )
    named = folders | dict.fromkeys(touched, folder)
    lines = [(version + 1, b, f) for b, f in named.items()] or [(version + 1, None, None)]
    _switch(spark.createDataFrame(lines, MANIFEST), path)
    return version + 1
