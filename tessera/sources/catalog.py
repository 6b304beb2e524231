"""The object catalog: read, write, and a deterministic one over test documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import hashing
from tessera.functions.attributes import attribute, attributes
from tessera.model import ENTRY, STATES, TIERS


#: Folders are named by the namespace behind this mark, so that the blank one has a folder, too.
MARK = "n-"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as written by ``write``; the namespace prunes folders."""
    held = T.StructType([*[f for f in ENTRY.fields if f.name != "namespace_id"], T.StructField("folder", T.StringType())])
    rows = spark.read.schema(held).parquet(path)
    return rows.select(*[F.substring("folder", len(MARK) + 1, 1 << 30).alias(n) if n == "namespace_id" else n for n in ENTRY.names])


def write(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows = entries.withColumn("folder", F.concat(F.lit(MARK), "namespace_id")).drop("namespace_id")
    rows.write.mode(mode).partitionBy("folder").parquet(path)


def scan(entries: DataFrame, namespace: str | None = None) -> DataFrame:
    """All entries, or those of a namespace, by hash."""
    rows = entries if namespace is None else entries.where(F.col("namespace_id") == namespace)
    return rows.orderBy("content_hash")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each distinct text of ``documents``, made from its highest doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    size = F.octet_length("text").cast("long")
    rows = docs.select(hashing.content_hash("text").alias("content_hash"), F.struct("doc_id", "lang", "source", "n_chars", size.alias("size")).alias("d"))
    rows = rows.groupBy("content_hash").agg(F.max("d").alias("d")).select("content_hash", "d.*")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    rows = rows.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    key = F.concat(F.lit("/"), "lang", F.lit("/"), F.lpad(i.cast("string"), 8, "0"), F.lit(".txt"))
    values = attributes(
        n_chars=attribute(F.col("n_chars"), "long"),
        quality=attribute(F.col("quality"), "long"),
        ratio=attribute(F.col("n_chars").cast("double") / F.nullif(F.col("size").cast("double"), F.lit(0.0)), "double"),
    )
    return rows.select(
        "content_hash",
        F.coalesce("source", F.lit("default")).alias("namespace_id"),
        F.when(i % 97 != 0, key).alias("object_key"),
        F.create_map(F.lit("lang"), "lang", F.lit("bucket"), (i % 5).cast("string")).alias("tags"),
        values.alias("attributes"),
        pick(TIERS, i).alias("tier"),
        F.col("size").alias("size_bytes"),
        F.lit("text/plain").alias("content_type"),
        created.alias("created_at"),
        (created + F.expr("make_dt_interval(0, cast(doc_id % 7 as int), 0, 0)")).alias("modified_at"),
        pick(STATES, i).alias("state"),
    )


def shown(entries: DataFrame, *more: str) -> DataFrame:
    """Entries as scalar columns."""
    return entries.select(
        "content_hash",
        "namespace_id",
        "object_key",
        F.col("tags")["lang"].alias("lang"),
        F.col("tags")["bucket"].alias("bucket"),
        F.col("attributes")["n_chars"]["l"].alias("n_chars"),
        F.col("attributes")["quality"]["l"].cast("string").alias("quality"),
        F.col("attributes")["ratio"]["d"].alias("ratio"),
        "tier",
        "size_bytes",
        "content_type",
        "created_at",
        "modified_at",
        "state",
        *more,
    )
