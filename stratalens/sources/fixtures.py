"""Evaluation fixtures: one folder each with input.txt and expected.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fixtures(spark: SparkSession, root: str) -> DataFrame:
    """fixture, question, expected_files, expected_symbols; folders that lack a file or hold invalid JSON are left out."""
    rows = spark.read.text(f"{root.rstrip('/')}/*/*", wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    rows = rows.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("fixture"), F.regexp_extract("p", r"([^/]+)$", 1).alias("file"), "value")
    asked = rows.filter(F.col("file") == "input.txt").select("fixture", F.trim("value").alias("question"))
    want = rows.filter(F.col("file") == "expected.json").withColumn("e", F.from_json("value", "files array<string>, symbols array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    empty = F.array().cast("array<string>")
    want = want.filter(F.col("e._bad").isNull()).select("fixture", F.coalesce("e.files", empty).alias("expected_files"), F.coalesce("e.symbols", empty).alias("expected_symbols"))
    return asked.join(want, "fixture")
