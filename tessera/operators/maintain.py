"""Consistency of the catalog with the blocks it points to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import store


def missing(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hashes of entries whose block is gone; blank hashes are skipped."""
    rows = entries.where(F.length(F.trim("content_hash")) > 0).select("content_hash")
    return rows.join(blocks.select("content_hash"), "content_hash", "left_anti")


def orphans(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hashes of blocks without an entry (an extension)."""
    return blocks.select("content_hash").distinct().join(entries.select("content_hash"), "content_hash", "left_anti")


def mismatches(entries: DataFrame, states: DataFrame) -> DataFrame:
    """(content_hash, state, stored) where the catalog and the state store differ (an extension)."""
    stored = states.select("content_hash", F.col("state").alias("stored"))
    return entries.select("content_hash", "state").join(stored, "content_hash").where("state <> stored")


def verify(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: n_entries, n_missing, is_consistent."""
    gone = missing(entries, blocks).select(F.lit(0).alias("entry"), F.lit(1).alias("gone"))
    rows = entries.select(F.lit(1).alias("entry"), F.lit(0).alias("gone")).unionByName(gone)
    n = F.coalesce(F.sum("gone"), F.lit(0))
    return rows.agg(F.coalesce(F.sum("entry"), F.lit(0)).alias("n_entries"), n.alias("n_missing"), (n == 0).alias("is_consistent"))


def repair(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The entries whose block is there."""
    return store.delete(entries, missing(entries, blocks))


def rebuild(entries: DataFrame) -> DataFrame:
    """An empty catalog."""
    return store.clear(entries)
