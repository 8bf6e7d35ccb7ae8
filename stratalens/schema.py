"""Tables of the concept index: schemas, value domains and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2

SYMBOL_KINDS = (
    "class", "function", "method", "constructor", "interface", "struct", "enum", "enum_constant", "record", "type_alias", "constant", "property", "module",
)
EDGE_KINDS = ("call", "inherit", "import", "implement", "override")
ROLES = ("interface", "implementation", "orchestrator", "entry_point", "domain_model", "infrastructure", "cross_cutting")
STATUSES = ("pending", "running", "done", "failed", "skipped")

FILES = "file_id long, path string, language string, content_hash string, size_bytes long"
SYMBOLS = (
    "symbol_id long, file_id long, path string, language string, name string, qualified_name string, kind string, signature string, "
    "start_line int, end_line int, docstring string, ordinal int, content_hash string"
)
EXTRACTED = "name string, qualified_name string, kind string, signature string, start_line int, end_line int, docstring string"
REFERENCES = "src_symbol_id long, dst_symbol_id long, kind string"
SYMBOL_EMBEDDINGS = "symbol_id long, content_hash string, model string, embedding array<float>"
CONCEPTS = "concept_id long, package string, name string, description string, role string, centroid array<float>, member_count int, member_hash string"
CONCEPT_MEMBERS = "concept_id long, symbol_id long, distance_to_centroid double"
CONCEPT_EMBEDDINGS = "concept_id long, embedding array<float>"
PIPELINE_RUNS = "stage string, status string, completed_at long, input_hash string, params string"
BUILD_CONFIG = "key string, value string"

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "references": REFERENCES, "symbol_embeddings": SYMBOL_EMBEDDINGS, "concepts": CONCEPTS,
    "concept_members": CONCEPT_MEMBERS, "concept_embeddings": CONCEPT_EMBEDDINGS, "pipeline_runs": PIPELINE_RUNS, "build_config": BUILD_CONFIG,
}

_DOMAINS = {"symbols": ("kind", SYMBOL_KINDS), "references": ("kind", EDGE_KINDS), "concepts": ("role", ROLES), "pipeline_runs": ("status", STATUSES)}


def checked(df: DataFrame, table: str) -> DataFrame:
    """df, failing at run time on a value outside the table's domain (null is allowed for a role)."""
    if table not in _DOMAINS:
        return df
    column, values = _DOMAINS[table]
    bad = F.col(column).isNotNull() & ~F.col(column).isin(list(values))
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{table}.{column}: "), F.col(column)))).otherwise(F.col(column)))
