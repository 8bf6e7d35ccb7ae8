"""A Spark session with the settings the library is tuned for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "stratalens", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; on a cluster the master comes from the submitter."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers.

    In local mode the workers don't inherit what the driver put on sys.path; on a
    cluster the package is shipped with the job (--py-files) or installed."""
    root = str(Path(__file__).resolve().parents[1])
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as shuffles have, four for each core at least; adaptive execution would merge them by their bytes, whatever hangs on a row."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
