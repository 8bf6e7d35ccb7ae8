"""Tables between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests), a temporary folder is
    set; on a cluster an unset folder is an error, never a machine-local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_strata_dir", None)
        if not folder:
            folder = spark.sparkContext._strata_dir = f"file://{tempfile.mkdtemp(prefix='strata-')}"
    return folder.rstrip("/")


#: Tables written and not yet removed, with their sessions.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts
    lineage, and a lost executor costs no more than the tasks it was running.

    The table stays until it is dropped, or the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/strata-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that materialize wrote and that nothing will read again."""
    for t in tables:
        _remove(getattr(t, "_strata_path", None))


def _remove(path: str | None) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001 - the session may be gone; its cluster's cleaner has the folder then
            _written.pop(path, None)


#: A key with more than one in SHARE of all rows, and more than SPLIT, is hot; there can't be more than SHARE of those.
SHARE, SPLIT = 1000, 1000


def join_keys(rows: DataFrame, keys: DataFrame, on: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with keys, which holds each ``on`` (a number or string) once.

    Hot keys, SHARE at most, are joined by broadcast where their rows lie, the others by
    hash: no key's rows gather in one task.  counts (on, n) tells how many rows keys have; without it rows are counted."""
    from pyspark.sql import functions as F

    counts = rows.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts
    sizes = counts.filter(F.col("n") > SPLIT).orderBy(F.desc("n")).limit(SHARE).select(on, "n").collect()
    if not sizes:
        return rows.join(keys, on)
    total = counts.agg(F.sum("n")).first()[0]
    hot = F.col(on).isin([r[0] for r in sizes if r.n * SHARE > total])
    return rows.filter(~hot).join(keys.filter(~hot), on).unionByName(rows.filter(hot).join(F.broadcast(keys.filter(hot)), on))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 3; null for a null id."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3


def lowest_by_hash(df: DataFrame, label: str, counts: DataFrame, per_label: int, seed: int, slack: int = 8) -> DataFrame:
    """df with ``rank`` 1 to per_label: of each label the rows with the lowest hash of doc_id.

    counts (label, n) tells about how many rows a label has.  Rows whose hash is far
    above the expected limit are left out before ranking, so that the ranking
    reads a few times per_label rows of a label at most, however many there are."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    h = F.xxhash64("doc_id", F.lit(seed))
    near = (h.cast("double") / 2.0**64 + 0.5) * F.col("n") < slack * per_label
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, "doc_id"))
    return join_keys(df, counts, label, counts).filter(near).drop("n").withColumn("rank", rank).filter(F.col("rank") <= per_label)
