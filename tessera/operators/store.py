"""Catalog rows in and out: upsert, patch, delete, get. Each takes tables and returns the table after."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import DEFAULT_NAMESPACE, ENTRY

COLUMNS = ENTRY.names
_TAGS, _ATTRIBUTES = (ENTRY[c].dataType.simpleString() for c in ("tags", "attributes"))


def moment(as_of: datetime | None) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")


def latest(rows: DataFrame, order: list[Column], key: str = "content_hash") -> DataFrame:
    """One row of each key, the last in order; rows combine before they move."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("__r")).select(*[F.col("__r")[n].alias(n) for n in names])


def upsert(base: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """New rows replace old ones of their hash; of new ones, the highest ``seq`` stays."""
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    rows = base.select(*COLUMNS, F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__seq"))
    rows = rows.unionByName(new.select(*COLUMNS, F.lit(1).alias("__new"), order.alias("__seq")))
    return latest(rows, [F.col("__new"), F.col("__seq")]).select(*COLUMNS)


def delete(base: DataFrame, hashes: DataFrame) -> DataFrame:
    return base.join(hashes.select("content_hash"), "content_hash", "left_anti").select(*base.columns)


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)


def get(base: DataFrame, content_hash: str) -> DataFrame:
    return base.where(F.col("content_hash") == content_hash).limit(1)


def get_many(base: DataFrame, requests: DataFrame, repeats: bool = True) -> DataFrame:
    """Entries of (pos, content_hash) in the order of pos; missing ones are skipped. Without repeats, each once, where first asked."""
    asked = requests.select("pos", "content_hash")
    if not repeats:
        asked = asked.groupBy("content_hash").agg(F.min("pos").alias("pos"))
    return base.join(asked, "content_hash").select("pos", *base.columns).orderBy("pos")


def rows_of_puts(puts: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Index rows of stored objects (content_hash, namespace_id, size_bytes; object_key, content_type, tags, attributes, tier if known)."""
    have = set(puts.columns)

    def known(c: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(c), otherwise) if c in have else otherwise

    null = F.lit(None).cast("string")
    return puts.select(
        "content_hash",
        "namespace_id",
        known("object_key", null).alias("object_key"),
        known("tags", F.expr(f"cast(map() as {_TAGS})")).alias("tags"),
        known("attributes", F.expr(f"cast(map() as {_ATTRIBUTES})")).alias("attributes"),
        known("tier", F.lit("Hot")).alias("tier"),
        known("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
        known("content_type", null).alias("content_type"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("modified_at"),
        known("state", F.lit("Stored")).alias("state"),
    )


def merged(base: Column, patch: Column, removed: Column, kind: str) -> Column:
    """Maps merged, the patch wins; then removed keys go."""
    empty = F.expr(f"cast(map() as {kind})")
    old, new = F.coalesce(base, empty), F.coalesce(patch, empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(kept, new), lambda k, v: ~F.coalesce(F.array_contains(removed, k), F.lit(False)))


def patch(base: DataFrame, patches: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Fields of ``patches`` (one row a hash) that aren't null overwrite; tags and attributes merge, then remove_tags and remove_attributes go.

    An unknown hash makes a row in the default namespace.
    """
    have = set(patches.columns)
    b, p = base.select(F.struct(*COLUMNS).alias("b")), patches.select(F.struct(*patches.columns).alias("p"))
    both = b.join(p, F.col("b.content_hash") == F.col("p.content_hash"), "full_outer")
    defaults = {"namespace_id": F.lit(DEFAULT_NAMESPACE), "tier": F.lit("Hot"), "size_bytes": F.lit(0).cast("long"), "created_at": moment(as_of), "state": F.lit("Pending")}
    out = []
    for c in COLUMNS:
        old, new = F.col(f"b.{c}"), F.col(f"p.{c}") if c in have else F.lit(None)
        if c in ("tags", "attributes"):
            kind = ENTRY[c].dataType.simpleString()
            removed = F.col(f"p.remove_{c}") if f"remove_{c}" in have else F.lit(None).cast("array<string>")
            value = merged(old, new.cast(kind) if c not in have else new, removed, kind)
        elif c == "modified_at":
            value = F.when(F.col("p").isNotNull(), F.coalesce(new.cast("timestamp_ntz"), moment(as_of))).otherwise(old)
        else:
            value = F.coalesce(new.cast(ENTRY[c].dataType), old, *([defaults[c]] if c in defaults else []))
        out.append(value.alias(c))
    return both.select(*out)


def persist_hot(hot: DataFrame, path: str) -> None:
    """Write the hot hashes beside the catalog, for the next start."""
    hot.select("content_hash").write.mode("overwrite").json(path)


def warm(base: DataFrame, path: str) -> DataFrame:
    """The entries of the hashes that ``persist_hot`` wrote; none where it didn't. Hashes that have gone are skipped."""
    try:
        hot = base.sparkSession.read.schema("content_hash string").json(path)
    except AnalysisException:
        return clear(base)
    return base.join(hot.distinct(), "content_hash", "left_semi")


def hot_set(accesses: DataFrame, capacity: int = 512, threshold: int = 3) -> DataFrame:
    """(content_hash, accesses, last_tick) of the hashes read at least ``threshold`` times: the most read, then the latest, up to ``capacity``."""
    counts = accesses.groupBy("content_hash").agg(F.count("*").alias("accesses"), F.max("tick").alias("last_tick"))
    return counts.where(F.col("accesses") >= threshold).orderBy(F.desc("accesses"), F.desc("last_tick"), "content_hash").limit(capacity)
