"""Continuous ingest: new versions of files arrive in a folder and refresh the symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff, extract
from ..sources.repo import source_files
from ..sources.store import TableStore


def upsert(store: TableStore, batch: DataFrame) -> None:
    """Applies a batch of (path, content, size_bytes, modified): the newest version of
    each path replaces the stored one; a repeated batch changes nothing.

    What is written is in proportion to the batch.  Embeddings, members and edges of
    symbols that went stay until the next index run; every reader joins them to the
    symbols, so they show nowhere."""
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("size_bytes")))
    files = source_files(batch.withColumn("n", newest).filter("n = 1")).persist()
    try:
        paths = F.broadcast(files.select("path"))  # a batch's
        old_files = store.read("files").join(paths, "path", "left_semi")
        changes = diff.file_changes(old_files, files.select("path", "content_hash"))
        renewed = files.join(changes.filter(F.col("action").isin(diff.INSERT, diff.REPLACE)).select("path"), "path", "left_semi")
        if renewed.isEmpty():
            return
        old_symbols = store.read("symbols").join(paths, "path", "left_semi")
        changed = renewed.select("path")
        fresh = diff.merge_symbols(old_symbols, extract.extract_symbols(renewed), changes.filter(F.col("action") != diff.KEEP))
        with store.transaction():
            store.change("symbols", fresh, changed)
            store.change("files", renewed.select("file_id", "path", "language", "content_hash", "size_bytes"), changed)
    finally:
        files.unpersist()


def start(spark: SparkSession, landing: str, store: TableStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Watches ``landing``; a file's path below it is its path in the tree.  ``once`` takes what is there and stops."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(landing)
    root = landing.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", r"^[a-z]+:/*" + root + "/", "")
    rows = stream.select(path.alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(store, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
