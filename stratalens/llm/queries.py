"""The queries over the synthetic tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, domains, langid, mixing, neardup, pages, passages, quality, search, secrets, sql, toxicity
from ._store import fold, read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold() != 1))
    held = F.coalesce(fold() == 1, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(docs.filter(fold() != 1), read_table(spark, sf_dir, "labels").filter(fold() != 1))
    held = F.coalesce(fold() == 1, F.lit(False))
    predicted = (F.col("score") >= 0.7).cast("int")
    return toxicity.score(docs, field).select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(read_table(spark, sf_dir, "pages"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeated_passages(read_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = mixing.mix(docs, domains.domain_of(F.col("source")), domains.TARGETS, fraction=0.6, max_epochs=2, seed=17)
    return out.select(F.col("row.doc_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_near_duplicates, op3_language_id, op4_exact_top_k, op5_bpe, op6_toxicity, op7_secrets, op8_html_text, op9_repeated_passages, op10_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": sql.OP2, "op4_exact_top_k": sql.OP4, "op9_repeated_passages": sql.OP9}
