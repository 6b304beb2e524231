"""Backups: candidates, full and incremental manifests, restore, verification, listing.

A backup is a row of points and its entries, rows of a manifest table that all
backups share; sets of both are plain tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.model import DEFAULT_NAMESPACE
from tessera.operators import store

ENTRY = ("content_hash", "namespace_id", "object_key", "tags", "size_bytes", "tier", "state")


def candidates(entries: DataFrame, namespace: str | None = None, states: list[str] | None = None, key_prefix: str | None = None) -> DataFrame:
    """What a scope holds; a blank namespace is the default one."""
    rows = entries.where(F.col("namespace_id") == (namespace if namespace and namespace.strip() else DEFAULT_NAMESPACE))
    if states is not None:
        rows = rows.where(F.col("state").isin(states))
    return rows if key_prefix is None else rows.where(F.col("object_key").startswith(key_prefix))


def manifest_rows(rows: DataFrame, backup_id: str) -> DataFrame:
    return rows.select(F.lit(backup_id).alias("backup_id"), *ENTRY, hashing.block_path("content_hash").alias("block_path"))


def full(scope: DataFrame, backup_id: str) -> DataFrame:
    """The manifest of a full backup of the candidates."""
    return manifest_rows(scope, backup_id)


def added(scope: DataFrame, parent: DataFrame) -> DataFrame:
    """The candidates that the parent's manifest doesn't have."""
    return scope.join(parent.select("content_hash"), "content_hash", "left_anti")


def incremental(scope: DataFrame, parent: DataFrame, backup_id: str) -> DataFrame:
    """The manifest of parent and new entries."""
    return united(parent, manifest_rows(added(scope, parent), backup_id), backup_id)


def united(old: DataFrame, new: DataFrame, backup_id: str) -> DataFrame:
    """Two manifests as one; of a hash in both, the new entry."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).withColumn("backup_id", F.lit(backup_id))
    return store.latest(rows, [F.col("__new")]).drop("__new")


def to_copy(manifest: DataFrame, target_blocks: DataFrame) -> DataFrame:
    """Hashes whose block the target still needs."""
    return manifest.select("content_hash").distinct().join(target_blocks.select("content_hash"), "content_hash", "left_anti")


def totals(manifest: DataFrame) -> DataFrame:
    """(backup_id, entry_count, total_bytes)."""
    return manifest.groupBy("backup_id").agg(F.count("*").alias("entry_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


_DIGEST = pa.schema([("backup_id", pa.string()), ("digest", pa.string())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state = None, None
    for batch in batches:
        for backup, content_hash in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is None or backup != current:
                if state is not None:
                    yield pa.RecordBatch.from_pylist([{"backup_id": current, "digest": state.hexdigest()}], _DIGEST)
                current, state = backup, hashlib.sha256()
            state.update(content_hash.encode())
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"backup_id": current, "digest": state.hexdigest()}], _DIGEST)


def digests(manifest: DataFrame) -> DataFrame:
    """(backup_id, digest): SHA-256 over a manifest's hashes, sorted and joined.

    The digest is sequential by definition; hashes stream through one task a
    backup, sorted by Spark (which spills), and none is held.
    """
    rows = manifest.select("backup_id", "content_hash").repartition("backup_id").sortWithinPartitions("backup_id", "content_hash")
    return rows.mapInArrow(_digested, "backup_id string, digest string")


def point(spark, backup_id: str, kind: str, created_at: datetime, target_id: str, manifest: DataFrame, parent_id: str | None = None, namespace: str | None = None, key_prefix: str | None = None) -> DataFrame:
    """The completed point of a manifest."""
    t, d = totals(manifest), digests(manifest)
    start = spark.createDataFrame([(backup_id, kind, parent_id, target_id, created_at, "Completed", namespace, key_prefix)], "backup_id string, kind string, parent_id string, target_id string, created_at timestamp_ntz, status string, namespace_id string, key_prefix string")
    out = start.join(t, "backup_id", "left").join(d, "backup_id", "left")
    return out.withColumns({"entry_count": F.coalesce("entry_count", F.lit(0)), "total_bytes": F.coalesce("total_bytes", F.lit(0)), "completed_at": F.col("created_at")})


def run(entries: DataFrame, blocks: DataFrame, root: str, backup_id: str, created_at: datetime, target_id: str, namespace: str | None = None, states: list[str] | None = None, key_prefix: str | None = None, parent_id: str | None = None) -> DataFrame:
    """A backup into the folder ``root``, full or on top of a parent there: the blocks it lacks, the manifest, then the point, which is returned.

    Blocks (content_hash, content) are appended, once each; manifest and point replace those of the same id.
    """
    spark = entries.sparkSession
    scope = candidates(entries, namespace, states, key_prefix)
    if parent_id is None:
        made = full(scope, backup_id)
    else:
        made = incremental(scope, read_manifest(spark, f"{root}/manifests", parent_id, full(scope, backup_id).schema), backup_id)
    write_manifests(made, f"{root}/manifests")
    held = read_manifest(spark, f"{root}/manifests", backup_id, made.schema)
    wanted = to_copy(held, target_blocks(spark, root))
    blocks.join(wanted, "content_hash", "left_semi").select("content_hash", "content").dropDuplicates(["content_hash"]).write.mode("append").parquet(f"{root}/blocks")
    out = point(spark, backup_id, "Full" if parent_id is None else "Incremental", created_at, target_id, held, parent_id, namespace, key_prefix)
    write_points(out, f"{root}/points")
    return read_points(spark, f"{root}/points").where(F.col("backup_id") == backup_id)


def target_blocks(spark, root: str) -> DataFrame:
    """The blocks of a target's folder; none before its first backup."""
    schema = "content_hash string, content binary"
    try:
        return spark.read.schema(schema).parquet(f"{root}/blocks")
    except AnalysisException:
        return spark.createDataFrame([], schema)


POINT = "kind string, parent_id string, target_id string, created_at timestamp_ntz, status string, namespace_id string, key_prefix string, entry_count long, total_bytes long, digest string, completed_at timestamp_ntz"


def write_points(points: DataFrame, path: str) -> None:
    """Points replace those of their id; a file each."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backup_id").json(path)


def read_points(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{POINT}, backup_id string").json(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{POINT}, backup_id string")


def cancel(points: DataFrame, backup_id: str, at: datetime) -> DataFrame:
    """The point as failed at this time; an unknown one changes nothing."""
    hit = F.col("backup_id") == backup_id
    return points.withColumns({"status": F.when(hit, "Failed").otherwise(F.col("status")), "completed_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("completed_at"))})


def listing(points: DataFrame, kind: str | None = None, created_after: datetime | None = None, target_id: str | None = None) -> DataFrame:
    """Points, the latest first."""
    for test in ([F.col("kind") == kind] if kind else []) + ([F.col("created_at") >= created_after] if created_after else []) + ([F.col("target_id") == target_id] if target_id else []):
        points = points.where(test)
    return points.orderBy(F.desc("created_at"), "backup_id")


def latest_completed(points: DataFrame) -> DataFrame:
    return points.where("status = 'Completed'").orderBy(F.desc("created_at"), "backup_id").limit(1)


def subset(manifest: DataFrame, hashes: DataFrame | None = None, key_prefix: str | None = None, namespace: str | None = None) -> DataFrame:
    """The entries that a restore asks for."""
    if hashes is not None:
        manifest = manifest.join(hashes.select("content_hash"), "content_hash", "left_semi")
    if namespace is not None:
        manifest = manifest.where(F.col("namespace_id") == namespace)
    return manifest if key_prefix is None else manifest.where(F.col("object_key").startswith(key_prefix))


def restored(wanted: DataFrame, target_blocks: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(content_hash, outcome): restored, skipped (there already), or failed (missing, or other bytes than its hash)."""
    b = target_blocks.select("content_hash", F.sha2("content", 256).alias("__found"))
    rows = wanted.join(b, "content_hash", "left")
    if blocks is not None:
        rows = rows.join(blocks.select("content_hash", F.lit(True).alias("__there")).distinct(), "content_hash", "left")
    else:
        rows = rows.withColumn("__there", F.lit(None).cast("boolean"))
    outcome = F.when(F.coalesce(F.col("__found") != F.col("content_hash"), F.lit(True)), "failed").when(F.col("__there"), "skipped").otherwise("restored")
    return rows.withColumn("outcome", outcome).drop("__found", "__there")


def restore_report(outcomes: DataFrame) -> DataFrame:
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(n("restored").alias("restored_count"), n("skipped").alias("skipped_count"), n("failed").alias("failed_count"), (n("failed") == 0).alias("succeeded"))


def restored_entries(entries: DataFrame, outcomes: DataFrame, as_of: datetime) -> DataFrame:
    """The catalog with what was restored, from the manifest."""
    rows = outcomes.where("outcome <> 'failed'").select("content_hash", "namespace_id", "object_key", "tags", "size_bytes", "tier", "state")
    return store.patch(entries, rows, as_of)


def verify(manifest: DataFrame, target_blocks: DataFrame) -> DataFrame:
    """(backup_id, verified_count, missing_count, ok) by what is there."""
    there = target_blocks.select("content_hash", F.lit(True).alias("__there")).distinct()
    rows = manifest.join(there, "content_hash", "left")
    gone = F.count_if(F.col("__there").isNull())
    return rows.groupBy("backup_id").agg((F.count("*") - gone).alias("verified_count"), gone.alias("missing_count"), (gone == 0).alias("ok"))


def rehash(manifest: DataFrame, target_blocks: DataFrame) -> DataFrame:
    """Hashes of the manifest whose block has other bytes (an extension)."""
    b = target_blocks.select("content_hash", F.sha2("content", 256).alias("found"))
    return manifest.select("content_hash").distinct().join(b, "content_hash").where("found <> content_hash").select("content_hash")


def garbage(target_blocks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Blocks that no manifest names (an extension)."""
    return target_blocks.select("content_hash").join(manifests.select("content_hash"), "content_hash", "left_anti")


def write_manifests(manifest: DataFrame, path: str) -> None:
    """Manifests replace those of their ids."""
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backup_id").json(path)


def read_manifest(spark, path: str, backup_id: str, schema) -> DataFrame:
    """The entries of a backup; none for an unknown one."""
    return spark.read.schema(schema).json(path).where(F.col("backup_id") == backup_id)


def schedule(schedules: DataFrame, new: DataFrame) -> DataFrame:
    """Schedules with ``new`` ones, which replace those of their schedule_id. Cron expressions are kept, not evaluated."""
    return schedules.join(new.select("schedule_id"), "schedule_id", "left_anti").select(*schedules.columns).unionByName(new.select(*schedules.columns))


def unschedule(schedules: DataFrame, schedule_id: str) -> DataFrame:
    return schedules.where(F.col("schedule_id") != schedule_id)


def schedule_listing(schedules: DataFrame) -> DataFrame:
    return schedules.orderBy("schedule_id")


def unknown_targets(schedules: DataFrame, targets: DataFrame) -> DataFrame:
    """Schedules that name a target that isn't there."""
    return schedules.join(targets.select("target_id"), "target_id", "left_anti")


def delete_backup(points: DataFrame, manifests: DataFrame, backup_id: str) -> tuple[DataFrame, DataFrame]:
    """Points and manifests without a backup; its blocks stay until ``garbage`` finds them."""
    other = F.col("backup_id") != backup_id
    return points.where(other), manifests.where(other)
