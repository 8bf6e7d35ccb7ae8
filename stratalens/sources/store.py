"""Index tables as Parquet folders.

Every write makes a new folder; one small pointer file says which folder each table
is, and is replaced in one step.  Readers see the old tables or the new ones, and a
crash leaves the old ones in place.  Folders that the last but one commit replaced are removed.

A table with a path column can also be changed file by file: a small folder beside the
others holds the new rows, and which paths they stand for; earlier rows of those paths no
longer count.  After MOST_CHANGES of them the table is written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .. import schema

POINTER, MOST_CHANGES = "_tables.json", 16


class TableStore:
    """Named tables under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: dict[str, list[str]] | None = None

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path(POINTER).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        fs, path = self._fs(), self._path(POINTER)
        if not fs.exists(path):
            return {"tables": {}, "replaced": []}
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _tables(self) -> dict[str, list[str]]:
        return self._pointer()["tables"] | (self._pending or {})

    def _commit(self, fresh: Mapping[str, list[str]]) -> None:
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        old = self._pointer()
        new = {"tables": old["tables"] | dict(fresh), "replaced": [f for n, kept in fresh.items() for f in old["tables"].get(n, []) if f not in kept]}
        draft = self._path(f".{POINTER}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(draft), fs.makeQualified(self._path(POINTER)), how)
        for folder in old["replaced"]:
            fs.delete(self._path(folder), True)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes inside become visible to others together at its end, or not at all."""
        if self._pending is not None:
            yield
            return
        self._pending = {}
        try:
            yield
            if self._pending:
                self._commit(self._pending)
        except BaseException:
            before = {f for folders in self._pointer()["tables"].values() for f in folders}
            for folder in {f for folders in self._pending.values() for f in folders} - before:
                self._fs().delete(self._path(folder), True)
            raise
        finally:
            self._pending = None

    def exists(self, name: str) -> bool:
        return name in self._tables()

    def read(self, name: str) -> DataFrame:
        """The table; an empty one if it was never written."""
        kind = schema.TABLES.get(name)
        folders = self._tables().get(name)
        if folders is None:
            if kind is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], kind)
        out, later = None, None
        for folder in reversed(folders):
            reader = self.spark.read.schema(kind) if kind else self.spark.read
            rows = reader.parquet(f"{self.root}/{folder}" + ("/rows" if folder.startswith("change-") else ""))
            rows = rows if later is None else rows.join(later, "path", "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
            if folder.startswith("change-"):
                own = self.spark.read.schema("path string").parquet(f"{self.root}/{folder}/paths")
                later = own if later is None else later.unionByName(own)
        return out

    def _set(self, name: str, folders: list[str]) -> DataFrame:
        if self._pending is None:
            self._commit({name: folders})
        else:
            before = self._pointer()["tables"].get(name, [])
            dropped = [f for f in self._pending.get(name, []) if f not in folders and f not in before]
            self._pending[name] = folders
            for folder in dropped:
                self._fs().delete(self._path(folder), True)
        return self.read(name)

    def change(self, name: str, rows: DataFrame, paths: DataFrame) -> DataFrame:
        """Replaces the rows of ``paths`` (path) by ``rows``; costs what they hold, not what the table does."""
        folders = self._tables().get(name, [])
        if not folders or len(folders) > MOST_CHANGES:
            old = self.read(name)
            return self.write(name, old.join(paths.select("path").distinct(), "path", "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))
        folder = f"change-{name}-{uuid.uuid4().hex}"
        schema.checked(rows, name).write.parquet(f"{self.root}/{folder}/rows")
        paths.select("path").distinct().write.parquet(f"{self.root}/{folder}/paths")
        return self._set(name, [*folders, folder])

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Replaces the table; df may be derived from its old content."""
        folder = f"{name}-{uuid.uuid4().hex}"
        writer = schema.checked(df, name).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        return self._set(name, [folder])

    def config(self) -> dict[str, object]:
        return {r.key: json.loads(r.value) for r in self.read("build_config").collect()}

    def put_config(self, values: Mapping[str, object]) -> None:
        both = {k: json.dumps(v) for k, v in (self.config() | dict(values)).items()}
        self.write("build_config", self.spark.createDataFrame(sorted(both.items()), schema.BUILD_CONFIG).coalesce(1))
