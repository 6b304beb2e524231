"""The catalog as JSON documents, {"Version": .., "Entries": [..]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tessera.functions.attributes import from_variant
from tessera.model import ENTRY, STATES, TIERS

#: JSON names of the fields, in order.
NAMES = {"ContentHash": "content_hash", "NamespaceId": "namespace_id", "ObjectKey": "object_key", "Tags": "tags", "Attributes": "attributes", "Tier": "tier", "SizeBytes": "size_bytes", "ContentType": "content_type", "CreatedAt": "created_at", "ModifiedAt": "modified_at", "State": "state"}


#: Entries of a document, about; a larger catalog has several.
PER_DOCUMENT = 10_000


def write(entries: DataFrame, path: str) -> None:
    """Documents of bounded size, each in a folder of its own below ``path``, dealt by hash and in the order of hashes; nulls left out, attributes as plain values."""
    plain = F.expr("transform_values(attributes, (k, v) -> case v.kind when 'string' then cast(v.s as variant) when 'bool' then cast(v.b as variant) when 'long' then cast(v.l as variant) else cast(v.d as variant) end)")
    column = {
        "attributes": plain,
        **{c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in ("created_at", "modified_at")},
    }
    entry = F.to_json(F.struct(*[column.get(c, F.col(c)).alias(n) for n, c in NAMES.items()]))
    parts = max(1, -(-entries.count() // PER_DOCUMENT))
    rows = entries.select(F.pmod(F.xxhash64("content_hash"), F.lit(parts)).cast("int").alias("part"), "content_hash", entry.alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("content_hash", "e"))), lambda x: x["e"]), ",\n")
    documents = rows.groupBy("part").agg(F.concat(F.lit('{"Version":1,"Entries":['), body, F.lit("]}")).alias("value"))
    documents.write.mode("overwrite").partitionBy("part").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A missing file, a malformed document or one without entries is an empty catalog.

    Names of enumerations are read in any case; unknown ones are Hot and Pending.
    """
    fields = [T.StructField(n, T.MapType(T.StringType(), T.StringType()) if n == "Tags" else T.StringType()) for n in NAMES]
    schema = T.StructType([T.StructField("Version", T.StringType()), T.StructField("Entries", T.ArrayType(T.StructType(fields)))])
    try:
        docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)
    e = docs.select(F.explode("Entries").alias("e")).select("e.*")
    tier, state = (F.initcap(F.lower(c)) for c in ("Tier", "State"))
    tokens = F.expr("from_json(Attributes, 'map<string,variant>')")
    return e.where("ContentHash is not null").select(
        F.col("ContentHash").alias("content_hash"),
        F.coalesce("NamespaceId", F.lit("")).alias("namespace_id"),
        F.col("ObjectKey").alias("object_key"),
        F.coalesce("Tags", F.expr("cast(map() as map<string,string>)")).alias("tags"),
        F.coalesce(F.map_filter(F.transform_values(tokens, lambda k, v: from_variant(v)), lambda k, v: v.isNotNull()), F.expr(f"cast(map() as {ENTRY['attributes'].dataType.simpleString()})")).alias("attributes"),
        F.when(tier.isin(*TIERS), tier).otherwise("Hot").alias("tier"),
        F.coalesce(F.col("SizeBytes").try_cast("long"), F.lit(0).cast("long")).alias("size_bytes"),
        F.col("ContentType").alias("content_type"),
        F.col("CreatedAt").try_cast("timestamp_ntz").alias("created_at"),
        F.col("ModifiedAt").try_cast("timestamp_ntz").alias("modified_at"),
        F.when(state.isin(*STATES), state).otherwise("Pending").alias("state"),
    )
