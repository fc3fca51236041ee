"""Documents as JSON lines: strict and lenient reading, and publishing in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Columns of a raw document file. Everything is text; ids in mixed notations stay as they are.
DOCUMENT = StructType([StructField(c, StringType()) for c in ("doc_id", "title", "text", "url", "wikidata_qid", "wikipedia_pageid", "approx_tokens")])
_CORRUPT = "_corrupt"


class CorruptInput(ValueError):
    """A line that is no JSON object of the schema."""


def read_lenient(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """All lines but blank ones; those that don't parse have null columns and themselves in ``_corrupt``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r")).select("r.*")


def read_strict(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """As :func:`read_lenient`, but one bad line fails the whole input before anything is used."""
    rows = read_lenient(spark, path, schema)
    bad = rows.where(f"{_CORRUPT} is not null").select(_CORRUPT).head(1)
    if bad:
        raise CorruptInput(f"not a JSON object of the schema: {bad[0][0][:200]}")
    return rows.drop(_CORRUPT)


def publish(df: DataFrame, path: str, staging: str) -> None:
    """Write JSON lines to ``staging``, then rename to ``path``, so that a reader sees all or nothing. An existing ``path`` is an error and stays as it is."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source = hadoop.Path(path), hadoop.Path(staging)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.mode("errorifexists").json(staging)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        fs.delete(source, True)
        raise OSError(f"could not publish {path}")
