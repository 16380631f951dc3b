"""Intermediate tables in the folder that every executor can reach, and tables that are replaced atomically.

A plan that loops, or whose result several later plans read, is cut by writing
it as Parquet below ``spark.checkpoint.dir``.  The files survive the loss of any
executor, which a local checkpoint or a cached block does not.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode without one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set("spark.checkpoint.dir", own)
    sc.setCheckpointDir(own)
    return own


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds Arrow batches, so that a batch of very long texts fits a Python worker.

    Values that the session has set lower stay.
    """
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(spark.conf.get(name).rstrip("bB"))
        except Exception:  # a setting that this version of Spark doesn't know
            now = 0
        if not 0 < now <= value:
            spark.conf.set(name, str(value))


class Scratch:
    """Writes tables below the shared folder and drops those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.made = 0

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` and returns the written table; its lineage ends there."""
        self.made += 1
        path = f"{self.base}/{self.made:03d}-{label}"
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
        fs, p = self._fs(path)
        fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that ``cut`` made and that no open plan reads any more."""
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                fs, p = self._fs(path)
                fs.delete(p, True)


class Pointer:
    """A small JSON document that is swapped atomically; every version is a numbered file that is put in place by a rename.

    Two writers that start from one version can't both succeed: the second finds the
    next number taken.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        folder = self._path()
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The last version (or the one asked for) and its document; 0 and nothing ahead of the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        path = self._path(f"{version:012d}")
        stream = path.getFileSystem(self.conf).open(path)
        try:
            return version, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap(self, version: int, document: dict) -> int:
        """Puts the document in place as the version behind ``version``; raises Taken if there is one already."""
        jvm = self.spark.sparkContext._jvm
        staged, path = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{version + 1:012d}")
        stream = staged.getFileSystem(self.conf).create(staged, False)
        try:
            stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(self.conf).getUri(), self.conf).rename(staged, path, options)
        except Exception as e:
            staged.getFileSystem(self.conf).delete(staged, False)
            if version + 1 in self.versions():
                raise Taken(f"{self.folder}: version {version + 1} is there already") from e
            raise
        return version + 1

    def forget(self, keep: int = 2) -> list[dict]:
        """Deletes all but the last versions; the documents that are left."""
        versions = self.versions()
        for v in versions[:-keep]:
            path = self._path(f"{v:012d}")
            path.getFileSystem(self.conf).delete(path, False)
        return [self.read(v)[1] for v in versions[-keep:]]


class Taken(RuntimeError):
    """Another writer was first."""


class Versioned:
    """A table whose readers see one whole version, whatever a writer is doing.

    Rows are written to a folder of their own; then the pointer is swapped.  A write
    that fails leaves the version before it, and files that no version names.  A table
    may be replaced as a whole or by partitions: the pointer names each partition's folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, f"{self.path}/_pointer")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of its last version, or the one asked for; None ahead of the first."""
        _, now = self.pointer.read(version)
        if not now:
            return None
        schema = T.StructType.fromJson(now["schema"])
        folders = [f"{self.path}/{p}" for p in now["parts"].values()]
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _stage(self, rows: DataFrame, by: list[str]) -> tuple[str, dict[str, str]]:
        name = f"_data/{uuid.uuid4().hex}"
        # the partition's own columns stay in the files
        kept = rows.withColumns({f"__{c}": F.col(c) for c in by}) if by else rows
        writer = kept.write.option("compression", "snappy")
        (writer.partitionBy(*(f"__{c}" for c in by)) if by else writer).parquet(f"{self.path}/{name}")
        parts = {"": name}
        for _ in by:
            inner = {}
            for key, folder in parts.items():
                path = self.pointer._path(f"../{folder}")
                for s in path.getFileSystem(self.pointer.conf).listStatus(path):
                    if s.isDirectory():
                        inner[f"{key}/{s.getPath().getName()}"] = f"{folder}/{s.getPath().getName()}"
            parts = inner
        return name, parts

    def replace(self, rows: DataFrame, by: tuple[str, ...] = ()) -> int:
        """``rows`` instead of the table, in partitions if ``by`` names columns; the new version."""
        version, _ = self.pointer.read()
        return self.pointer.swap(version, {"schema": rows.schema.jsonValue(), "by": list(by), "parts": self._stage(rows, list(by))[1]})

    def replace_partitions(self, rows: DataFrame) -> int:
        """``rows`` instead of the partitions that they are in; the others are untouched, their files too.  The new version."""
        version, now = self.pointer.read()
        if not now.get("by"):
            raise ValueError("the table has no partitions")
        schema = T.StructType.fromJson(now["schema"])
        fresh = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        return self.pointer.swap(version, now | {"parts": now["parts"] | self._stage(fresh, now["by"])[1]})

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions but for the last, and folders that none of those names.  No write may be under way."""
        used = {p.split("/")[1] for d in self.pointer.forget(keep) for p in d["parts"].values()}
        data = self.pointer._path("../_data")
        fs = data.getFileSystem(self.pointer.conf)
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
