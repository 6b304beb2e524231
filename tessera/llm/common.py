"""What the training-data operators share: tables, words, staging, joins that stand hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fold(text: str) -> str:
    """``crc32(doc_id as text) mod k`` as SQL, the contract's way to hold rows out."""
    return f"crc32(cast({text} as string))"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary folder serves a local master (tests); on a
    cluster that would lose files, so it is an error there.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back: later plans start there.

    Unlike a cached table it survives lost executors. The shuffle files of the
    job that wrote it are dropped as soon as it ends, since nothing reads them.
    """
    spark = df.sparkSession
    path, key = path or scratch(spark, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it, if it is there."""
    path, fs = _file_system(spark, folder)
    fs.delete(path, True)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """The paths in a folder; none in one that isn't there."""
    path, fs = _file_system(spark, folder)
    return [f.getPath().toString() for f in fs.listStatus(path)] if fs.exists(path) else []


def drop_staged(df: DataFrame, only: str = "") -> None:
    """Delete the files of a staged table, or of its partition ``only``, that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f"/{only}" in f}:
        delete(spark, folder)


def keyed_lookup(big: DataFrame, small: DataFrame, key: str, weight: str = "n", hot: int = 1000) -> DataFrame:
    """``big`` left-joined with ``small``, which has one row per ``key``; null is a key like others.

    ``small[weight]`` says how many rows of ``big`` a key has. The ``hot`` heaviest
    keys (a fixed number of rows, so a bounded broadcast) are answered without a
    shuffle, wherever their rows are; each other key has under 1/``hot`` of all
    rows, and these are joined by a shuffle in which answered rows go anywhere.
    """
    values = [c for c in small.columns if c not in (key, weight)]
    top = small.orderBy(F.desc(weight), F.col(key).asc_nulls_last()).limit(hot)
    top = F.broadcast(top.select(F.col(key).alias("__hk"), F.struct(F.lit(True).alias("__is"), *values).alias("__hv")))
    rest = small.select(F.xxhash64(key).alias("__sj"), F.col(key).alias("__sk"), F.struct(F.lit(True).alias("__is"), *values).alias("__sv"))
    found = big.join(top, F.col(key).eqNullSafe(F.col("__hk")), "left")
    found = found.withColumn("__bj", F.when(F.col("__hv").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    found = found.join(rest, (F.col("__bj") == F.col("__sj")) & F.col("__hv").isNull() & F.col(key).eqNullSafe(F.col("__sk")), "left")
    got = F.coalesce("__hv", "__sv")
    return found.select(*big.columns, *[got[c].alias(c) for c in values])
