"""Folders of blobs as tables, by Spark's own readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EMPTY = "path string, length long"


def listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(path, length) below a folder, paths relative to it, by path; a missing folder is empty. Contents aren't read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        return spark.createDataFrame([], _EMPTY)
    bare = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + bare + "\\E/", "")
    return files.select(relative.alias("path"), "length").where(F.col("path").startswith(prefix)).orderBy("path")


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


class Target:
    """A folder to back up to, in any file system that Spark reads: whole small files by relative path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, relative: str):
        if not relative or relative.startswith("/") or ".." in relative.split("/"):
            raise ValueError(f"{relative!r} isn't a path below the target")
        return self._path(f"{self.root}/{relative}")

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self._at(relative))

    def write(self, relative: str, content: bytes) -> None:
        """Under another name first, so that readers see all of it or nothing."""
        at, part = self._at(relative), self._at(relative + ".part")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        self._fs.delete(at, True)
        if not self._fs.rename(part, at):
            raise OSError(f"{relative} couldn't be put in place")

    def read(self, relative: str) -> bytes | None:
        if not self.exists(relative):
            return None
        stream = self._fs.open(self._at(relative))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, relative: str) -> bool:
        """Whether there was something; folders go with all below."""
        return self._fs.delete(self._at(relative), True)

    def listing(self, prefix: str = "") -> DataFrame:
        return listing(self.spark, self.root, prefix)


class Targets:
    """Targets by id."""

    def __init__(self) -> None:
        self._known: dict[str, Target] = {}

    def register(self, target_id: str, target: Target) -> None:
        self._known[target_id] = target

    def resolve(self, target_id: str) -> Target:
        if target_id not in self._known:
            raise KeyError(f"no target {target_id!r}")
        return self._known[target_id]

    def ids(self) -> list[str]:
        return sorted(self._known)
