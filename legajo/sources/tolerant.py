"""JSON records that may be broken: what can be read, what was rejected and why, what is new.

Every record of the files becomes one row.  A record is

* ``read`` if it is an object that fits the schema; keys it lacks are null, keys the
  schema lacks are named in ``unknown_keys`` and change nothing else,
* ``wrong type`` if it is an object with a value of another type than the schema's,
* ``malformed`` if it is no JSON object, cut files and empty documents included.

Rejected records keep their text and file, so that they can be mended and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def json_records(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """(file, text, state, record, unknown_keys) of JSON lines, or of one document per file.

    Lines without text are no records.  ``record`` is null unless the state is ``read``.
    """
    lines = spark.read.text(path, wholetext=whole_files).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    if not whole_files:
        lines = lines.filter(F.trim("text") != "")
    fields = T.StructType.fromDDL(schema)
    tolerant = T.StructType([*fields.fields, T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    keys = F.json_object_keys("text")
    parsed = lines.withColumn("_parsed", F.from_json("text", tolerant, options)).withColumn(
        "_keys", F.when(F.trim("text").startswith("{"), keys)
    )
    state = (
        F.when(F.col("_keys").isNull(), "malformed")
        .when(F.col("_parsed").isNull() | F.col(f"_parsed.{BROKEN}").isNotNull(), "wrong type")
        .otherwise("read")
    )
    record = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in fields.fields])
    known = F.array(*[F.lit(f.name) for f in fields.fields])
    return parsed.withColumn("state", state).select(
        "file",
        "text",
        "state",
        F.when(F.col("state") == "read", record).alias("record"),
        F.coalesce(F.array_except("_keys", known), F.array().cast("array<string>")).alias(
            "unknown_keys"
        ),
    )


def readable(records: DataFrame) -> DataFrame:
    """The columns of the records that were read, and the file of each."""
    return records.filter("state = 'read'").select("record.*", "file")


def rejected(records: DataFrame) -> DataFrame:
    """File, text and reason of the records that were not read."""
    return records.filter("state <> 'read'").select("file", "text", F.col("state").alias("reason"))


def drift(records: DataFrame) -> DataFrame:
    """How many readable records hold each key that the schema lacks."""
    return (
        records.filter("state = 'read'")
        .select(F.explode("unknown_keys").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
