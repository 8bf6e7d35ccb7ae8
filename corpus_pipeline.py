"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm import bpe, domains, mixing, neardup, secrets, toxicity
from stratalens.llm._store import materialize, read_table
from stratalens.session import reachable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored toxic.  The field is trained on docs and the labels table; a null text stays."""
    field = toxicity.fit(docs, read_table(reachable(spark), sf_dir, "labels"))
    return toxicity.keep_below(docs.select(*COLUMNS), field, TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8),
    the one with the smallest doc_id; of rows that repeat a doc_id, one of those that stay
    by their own text.  Null doc_ids stay."""
    reachable(spark)
    docs = docs.select(*COLUMNS)
    kept = materialize(neardup.near_duplicates(docs, k=5, percent=80, named=True).filter("kept and doc_id is not null").select("doc_id", "h1", "h2"), "kept")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    single = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").join(repeated, "doc_id", "left_anti")
    # which of several rows stays is told by its set's name
    named = neardup.with_set_names(docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS), 5)
    named = named.join(kept.select("doc_id", neardup.set_name("h1", "h2").alias("set_name")).distinct(), ["doc_id", "set_name"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*COLUMNS), "text")
    first = named.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return single.select(*COLUMNS).unionByName(first.select(*COLUMNS)).unionByName(docs.filter("doc_id is null"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows.  A null text stays null."""
    return secrets.redact_documents(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the production tree's weights, each document at most once."""
    out = mixing.mix(docs.select(*COLUMNS), domains.domain_of(F.col("source")), domains.TARGETS, fraction=0.9, max_epochs=1, seed=17)
    return out.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), text_sha256 of the decoded text."""
    import public_tokenizers

    reachable(spark)
    out = bpe.encode_decode(docs.select(*COLUMNS), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("secrets", redacted),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Training a field, sketches and tokenizing have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
