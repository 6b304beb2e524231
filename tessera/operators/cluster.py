"""Consistent hashing, shards, capacity, topology and tiers.

A ring is configuration (nodes times virtual nodes), not data: its points are a
small table of fixed size. Keys find their successor by an equi-join: the hash
space is cut into cells, and each cell knows the arcs that touch it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.model import THRESHOLDS

VIRTUAL_NODES, DISK_VIRTUAL_NODES, LEAST_VIRTUAL = 96, 128, 4
CELLS = 4096
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def ring(nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(point, node_id): ``virtual`` points a node (4 at least); of nodes with one point, the last in the order of ids."""
    v = max(LEAST_VIRTUAL, virtual)
    rows = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("i"))
    points = rows.select(hashing.stable_hash(F.concat("node_id", F.lit(":"), F.col("i").cast("string"))).alias("point"), "node_id")
    return points.groupBy("point").agg(F.max("node_id").alias("node_id"))


def arcs(ring_: DataFrame, replicas: int = 1) -> list[tuple[int, int, list[str]]]:
    """(low, high, nodes): hashes from low to high, both included, belong to these nodes, the next ``replicas`` distinct ones clockwise."""
    points = sorted((r["point"], r["node_id"]) for r in ring_.collect())
    n, distinct = len(points), len({node for _, node in points})
    out = []
    for k, (p, _) in enumerate(points):
        nodes: list[str] = []
        for step in range(n):
            node = points[(k + step) % n][1]
            if node not in nodes:
                nodes.append(node)
            if len(nodes) >= min(max(1, replicas), distinct):
                break
        out.append((points[k - 1][0] + 1 if k else _LOW, p, nodes))
    if points and points[-1][0] < _HIGH:
        out.append((points[-1][0] + 1, _HIGH, out[0][2]))
    return out


def _cell(h):
    """Which of the cells a hash is in."""
    return F.floor((h / F.lit(float(1 << 64)) + 0.5) * CELLS).cast("int")


def place(keys: DataFrame, key: str, arcs_: list[tuple[int, int, list[str]]]) -> DataFrame:
    """``keys`` with ``nodes``, those that a key's hash belongs to, the first its owner."""
    spark = keys.sparkSession
    table = spark.createDataFrame(arcs_ or [(_LOW, _HIGH, [])], "low long, high long, nodes array<string>")
    table = table.withColumn("cell", F.explode(F.sequence(F.greatest(_cell(F.col("low")) - 1, F.lit(0)), _cell(F.col("high")) + 1)))
    rows = keys.withColumn("__h", hashing.stable_hash(key)).withColumn("__c", _cell(F.col("__h")))
    hit = (F.col("__c") == F.col("cell")) & (F.col("__h") >= F.col("low")) & (F.col("__h") <= F.col("high"))
    return rows.join(F.broadcast(table), hit).drop("__h", "__c", "low", "high", "cell")


def select_nodes(keys: DataFrame, key: str, nodes: DataFrame, replicas: int, virtual: int = VIRTUAL_NODES) -> DataFrame:
    return place(keys, key, arcs(ring(nodes, virtual), replicas))


def select_pool(entries: DataFrame, pools: DataFrame, virtual: int = DISK_VIRTUAL_NODES) -> DataFrame:
    """Entries with the ``pool_id`` of their block, among enabled pools that have an id."""
    usable = pools.where("enabled and length(trim(pool_id)) > 0").select(F.col("pool_id").alias("node_id"))
    rows = entries.withColumn("__k", F.concat(F.lit("block:"), "content_hash"))
    return place(rows, "__k", arcs(ring(usable, virtual))).withColumn("pool_id", F.get("nodes", F.lit(0))).drop("nodes", "__k")


def moved(entries: DataFrame, before: DataFrame, after: DataFrame, virtual: int = DISK_VIRTUAL_NODES) -> DataFrame:
    """(content_hash, from_pool, to_pool) of blocks that a change of pools moves (an extension)."""
    a = select_pool(entries.select("content_hash"), before, virtual).withColumnRenamed("pool_id", "from_pool")
    return select_pool(a, after, virtual).withColumnRenamed("pool_id", "to_pool").where("from_pool <> to_pool")


def capacity_state(ratio):
    """Normal, Warning, Critical or Full."""
    out = None
    for name, least in sorted(THRESHOLDS.items(), key=lambda t: -t[1]):
        out = F.when(ratio >= least, name) if out is None else out.when(ratio >= least, name)
    return out.otherwise("Normal")


def capacity(usage: DataFrame, pools: DataFrame) -> DataFrame:
    """(pool_id, used_bytes, capacity_bytes, used_ratio, state) of each pool, and of all together as the null one."""
    used = usage.groupBy("pool_id").agg(F.sum("size_bytes").alias("used"))
    rows = pools.join(used, "pool_id", "left").select("pool_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("capacity_bytes", F.lit(0)).alias("capacity"))
    sums = rows.rollup("pool_id").agg(F.sum("used").alias("used_bytes"), F.sum("capacity").alias("capacity_bytes"))
    r = hashing.ratio("used_bytes", "capacity_bytes")
    return sums.withColumn("used_ratio", r).withColumn("state", capacity_state(r))


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pool_id, was, state) of pools whose state is another than before: what a threshold callback hears."""
    was = before.select(F.col("pool_id").alias("__p"), F.col("state").alias("was"))
    return after.join(was, F.col("pool_id").eqNullSafe(F.col("__p"))).where("was <> state").select("pool_id", "was", "state")


class Topology:
    """Nodes by role, with a version that each listing raises by one."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.version = nodes, 0

    def list(self, role: str | None = None) -> DataFrame:
        self.version += 1
        return topology(self.nodes, role).withColumn("version", F.lit(self.version))


def topology(nodes: DataFrame, role: str | None = None) -> DataFrame:
    return (nodes if role is None else nodes.where(F.col("role") == role)).orderBy("node_id")


def tiers(rows: DataFrame) -> DataFrame:
    """Tier definitions by priority; of one name, the last registered (``seq``)."""
    last = rows.groupBy("tier").agg(F.max_by("priority", "seq").alias("priority"))
    return last.orderBy("priority", "tier")


def shards(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("shard-"), F.col("id").cast("string")).alias("shard_id")).orderBy("shard_id")


def resolve_shard(rows: DataFrame, n: int, namespace: str = "namespace_id") -> DataFrame:
    return rows.withColumn("shard_id", hashing.shard(namespace, n))


def migrate_shard(rows: DataFrame, shard_id: str, node_id: str) -> DataFrame:
    """Nothing moves: shards are names computed from namespaces, held nowhere by themselves."""
    return rows


def rebalance_progress(moves: DataFrame, done: DataFrame) -> DataFrame:
    """(total, moved, ratio, is_complete) of the blocks to move, by those that have (an extension)."""
    there = done.select("content_hash", F.lit(1).alias("done")).distinct()
    sums = moves.join(there, "content_hash", "left").agg(F.count("*").alias("total"), F.count("done").alias("moved"))
    r = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("moved") / F.col("total"))
    return sums.withColumn("ratio", r).withColumn("is_complete", F.col("moved") == F.col("total"))


def tier_migrations(log: DataFrame, new: DataFrame) -> DataFrame:
    """The record of migrations with new ones; they are recorded, the tier is metadata."""
    return log.unionByName(new)
