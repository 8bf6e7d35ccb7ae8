import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute


@pytest.fixture(scope="session")
def docs(spark):
    """Hard documents, with a column whose name an operator could use itself."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(brute.rows(), brute.DOCS).withColumn("h", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("spans", F.lit(2.5)).repartition(3)


@pytest.fixture(scope="session")
def files(spark, docs, tmp_path_factory):
    """The same, read from Parquet."""
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], brute.DOCS)
