"""Differences of a fresh scan to the stored index, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, MOVE, REPLACE, INSERT, DELETE = "KEEP", "MOVE", "REPLACE", "INSERT", "DELETE"


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, action (KEEP, REPLACE, INSERT, DELETE), old_hash, new_hash by content hash."""
    o = old.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select("path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("now"))
    action = F.when(F.col("now").isNull(), DELETE).when(F.col("was").isNull(), INSERT).when(F.col("old_hash").eqNullSafe(F.col("new_hash")), KEEP).otherwise(REPLACE)
    return o.join(n, "path", "full_outer").select("path", action.alias("action"), "old_hash", "new_hash")


_KEY = ("path", "qualified_name", "signature", "ordinal")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_id, action for each key (file, qualified name, signature, ordinal):
    KEEP the same; MOVE: only lines differ; REPLACE: another content hash, so the
    embedding goes; INSERT; DELETE."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in (*_KEY, "symbol_id", "content_hash", "start_line", "end_line")])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in (*_KEY, "symbol_id", "content_hash", "start_line", "end_line")])
    on = [F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in _KEY]
    lines = (F.col("o_start_line") == F.col("n_start_line")) & (F.col("o_end_line") == F.col("n_end_line"))
    action = (
        F.when(F.col("n_symbol_id").isNull(), DELETE).when(F.col("o_symbol_id").isNull(), INSERT)
        .when(~F.col("o_content_hash").eqNullSafe(F.col("n_content_hash")), REPLACE).when(lines, KEEP).otherwise(MOVE)
    )
    return o.join(n, on, "full_outer").select(F.coalesce("n_symbol_id", "o_symbol_id").alias("symbol_id"), action.alias("action"))


def merge_symbols(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The symbols after files changed: unchanged files keep theirs, others take
    the fresh ones; a docstring written for a symbol that had none stays while its
    hash does."""
    kept = old.join(changes.filter(F.col("action") == KEEP).select("path"), "path", "left_semi")
    written = old.select("symbol_id", F.col("content_hash").alias("was"), F.col("docstring").alias("written"))
    fresh = fresh.join(written, "symbol_id", "left")
    doc = F.when(F.col("docstring").isNull() & F.col("was").eqNullSafe(F.col("content_hash")), F.col("written")).otherwise(F.col("docstring"))
    return kept.select(*old.columns).unionByName(fresh.withColumn("docstring", doc).select(*old.columns))


def surviving(table: DataFrame, key: str, alive: DataFrame, alive_key: str = "symbol_id") -> DataFrame:
    """Rows of a dependent table whose parent still exists."""
    return table.join(alive.select(F.col(alive_key).alias(key)).distinct(), key, "left_semi").select(*table.columns)


def surviving_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return surviving(surviving(edges, "src_symbol_id", symbols), "dst_symbol_id", symbols)


def to_embed(symbols: DataFrame, kept: DataFrame) -> DataFrame:
    """Symbols that have none of the kept embeddings."""
    return symbols.join(kept.select("symbol_id"), "symbol_id", "left_anti")


def still_there(old_files: DataFrame, scanned: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored files that are listed but could not be read this time: they keep their rows."""
    unread = listed.select("path").join(scanned.select("path"), "path", "left_anti")
    return old_files.join(unread, "path", "left_semi")


def reusable_embeddings(embeddings: DataFrame, symbols: DataFrame, model: str) -> DataFrame:
    """Embeddings whose symbol still has the hash and that come from this model."""
    return embeddings.filter(F.col("model") == model).join(symbols.select("symbol_id", "content_hash"), ["symbol_id", "content_hash"], "left_semi").select(*embeddings.columns)
