"""A source tree as rows of files."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excluded, suffix_of
from ..operators.languages import EXTENSIONS

SKIPPED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".tox")


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, size_bytes of all files."""
    base = unquote(urlparse(root).path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    here = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^/+", "/")
    return files.select(F.substring(here, len(base) + 2, 1 << 30).alias("path"), "content", F.col("length").alias("size_bytes"))


def scan_repo(spark: SparkSession, root: str, exclude_paths: tuple[str, ...] | DataFrame = (), exclude_patterns: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), language, content, content_hash, size_bytes of the tree's
    source files: known suffix, not below a skipped or dot folder, not excluded.

    Files that can't be read are left out; list_repo tells that they are there."""
    return source_files(_tree(spark, root), exclude_paths, exclude_patterns)


#: A language's external index counts only where one of these lies at the tree's top.
BUILD_FILES = {"go": ("go.mod", "go.work"), "python": ("pyproject.toml", "setup.py", "setup.cfg"), "java": ("pom.xml", "build.gradle", "build.gradle.kts")}


def has_build_file(spark: SparkSession, root: str, language: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = BUILD_FILES.get(language, ())
    return not names or any(fs.exists(path(f"{root.rstrip('/')}/{n}")) for n in names)


def list_repo(spark: SparkSession, root: str, exclude_paths: tuple[str, ...] | DataFrame = (), exclude_patterns: tuple[str, ...] = ()) -> DataFrame:
    """path of the same files, and of those that can't be read: no file is opened."""
    return _wanted(_tree(spark, root).select("path"), exclude_paths, exclude_patterns).select("path")


def not_below(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose path is none of ``folders`` (path) and below none: a list of any
    length, matched on the path's own prefixes."""
    parts = F.split("path", "/")
    spread = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_folder"))
    hit = spread.join(folders.select(F.rtrim("path", F.lit("/")).alias("_folder")).distinct(), "_folder", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_anti")


def _wanted(rows: DataFrame, exclude_paths: tuple[str, ...] | DataFrame, exclude_patterns: tuple[str, ...]) -> DataFrame:
    if isinstance(exclude_paths, DataFrame):
        rows, exclude_paths = not_below(rows, exclude_paths), ()
    known = F.create_map(*[F.lit(x) for pair in sorted(EXTENSIONS.items()) for x in pair])
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda x: x.isin(list(SKIPPED_FOLDERS)) | F.startswith(x, F.lit(".")))
    return rows.withColumn("language", F.try_element_at(known, suffix_of(F.col("path")))).filter(F.col("language").isNotNull() & ~skipped & ~excluded(F.col("path"), exclude_paths, exclude_patterns))


def source_files(rows: DataFrame, exclude_paths: tuple[str, ...] | DataFrame = (), exclude_patterns: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows of (path, content, size_bytes) from anywhere; content is pruned until a path is known to be wanted."""
    return _wanted(rows, exclude_paths, exclude_patterns).select(F.xxhash64("path").alias("file_id"), "path", "language", F.sha2("content", 256).alias("content_hash"), "size_bytes", "content")
