import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_query import row

from tessera import config
from tessera.model import ENTRY
from tessera.operators import backup, cluster

AS_OF = datetime(2024, 6, 1)


def sha(b):
    return hashlib.sha256(b).hexdigest()


CONTENTS = [b"one", b"two", b"three"]


def entries(spark, n=3):
    return spark.createDataFrame([row(sha(c), f"/k{i}", "x", "Hot", "Available", len(c), i, "default") for i, c in enumerate(CONTENTS[:n])] + [row("other", "/o", "x", "Hot", "Deleted", 9, 1, "ns2")], ENTRY)


def blocks(spark, n=3):
    return spark.createDataFrame([(sha(c), c) for c in CONTENTS[:n]], "content_hash string, content binary")


def test_full_and_incremental(spark):
    scope = backup.candidates(entries(spark), " ", ["Available"], "/k")
    assert scope.count() == 3 and backup.candidates(entries(spark), "ns2", ["Available"]).count() == 0
    parent = backup.full(backup.candidates(entries(spark, 2), None), "b1")
    new = backup.added(scope, parent).collect()
    assert [r.content_hash for r in new] == [sha(b"three")]
    child = backup.incremental(scope, parent, "b2")
    assert sorted(r.content_hash for r in child.collect()) == sorted(map(sha, CONTENTS)) and {r.backup_id for r in child.collect()} == {"b2"}
    assert tuple(backup.totals(child).first()) == ("b2", 3, 11)
    assert backup.digests(child).first().digest == sha("".join(sorted(map(sha, CONTENTS))).encode())
    assert backup.to_copy(child, blocks(spark, 2)).count() == 1
    p = backup.point(spark, "b2", "Incremental", AS_OF, "t", child, "b1").first()
    assert (p.status, p.entry_count, p.total_bytes, p.parent_id) == ("Completed", 3, 11, "b1")
    empty = backup.point(spark, "b0", "Full", AS_OF, "t", child.limit(0)).first()
    assert (empty.entry_count, empty.total_bytes) == (0, 0)


def test_restore_and_verify(spark):
    manifest = backup.full(backup.candidates(entries(spark)), "b1")
    target = blocks(spark, 2).unionByName(spark.createDataFrame([(sha(b"three"), b"rotten")], "content_hash string, content binary"))
    out = backup.restored(manifest, target, blocks(spark, 1))
    assert {r.content_hash: r.outcome for r in out.collect()} == {sha(b"one"): "skipped", sha(b"two"): "restored", sha(b"three"): "failed"}
    assert tuple(backup.restore_report(out).first()) == (1, 1, 1, False)
    back = backup.restored_entries(spark.createDataFrame([], ENTRY), out, AS_OF).collect()
    assert {(r.object_key, r.namespace_id, r.state) for r in back} == {("/k0", "default", "Available"), ("/k1", "default", "Available")}
    assert backup.subset(manifest, blocks(spark, 2), "/k1").count() == 1 and backup.subset(manifest, namespace="no").count() == 0
    assert tuple(backup.verify(manifest, target).first()) == ("b1", 3, 0, True)
    assert tuple(backup.verify(manifest, blocks(spark, 2)).first()) == ("b1", 2, 1, False)
    assert [r.content_hash for r in backup.rehash(manifest, target).collect()] == [sha(b"three")]
    assert backup.garbage(blocks(spark), backup.full(backup.candidates(entries(spark, 1)), "b")).count() == 2


def test_listing_and_files(spark, tmp_path):
    day = [datetime(2024, 1, d) for d in (1, 2, 3)]
    points = spark.createDataFrame([("a", "Full", day[0], "t1", "Completed", None), ("b", "Incremental", day[1], "t2", "Completed", None), ("c", "Full", day[2], "t1", "Running", None)], "backup_id string, kind string, created_at timestamp_ntz, target_id string, status string, completed_at timestamp_ntz")
    assert [r.backup_id for r in backup.listing(points).collect()] == ["c", "b", "a"]
    assert [r.backup_id for r in backup.listing(points, "Full", day[1], "t1").collect()] == ["c"]
    assert backup.latest_completed(points).first().backup_id == "b"
    gone = {r.backup_id: (r.status, r.completed_at) for r in backup.cancel(points, "c", AS_OF).collect()}
    assert gone["c"] == ("Failed", AS_OF) and gone["a"][0] == "Completed"
    assert backup.cancel(points, "no", AS_OF).exceptAll(points).count() == 0
    manifest = backup.full(backup.candidates(entries(spark)), "b1")
    backup.write_manifests(manifest, str(tmp_path / "m"))
    back = backup.read_manifest(spark, str(tmp_path / "m"), "b1", manifest.schema)
    assert back.select("content_hash", "size_bytes").exceptAll(manifest.select("content_hash", "size_bytes")).count() == 0 and back.count() == 3
    assert backup.read_manifest(spark, str(tmp_path / "m"), "no", manifest.schema).count() == 0


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def owners(spark, key, names, replicas, virtual):
    keys = spark.createDataFrame([(key,)], "k string")
    return cluster.select_nodes(keys, "k", nodes(spark, *names), replicas, virtual).first().nodes


def test_ring(spark):
    assert owners(spark, "block:key", "abc", 2, 64) == ["b", "a"]
    assert owners(spark, "k", "abc", 5, 96) == ["b", "a", "c"]
    assert owners(spark, "k", "a", 3, 96) == ["a"]
    assert cluster.ring(nodes(spark, "a", "b"), 1).count() == 8


def stable(text):
    r = 0
    for b in hashlib.sha256(text.encode()).digest()[:16]:
        r = (r * 31 + b) % 2**64
    return r - 2**64 if r >= 2**63 else r


def test_pools_match_a_walk_around_the_ring(spark):
    pools = spark.createDataFrame([("p1", True), ("p2", True), ("p3", False), (" ", True)], "pool_id string, enabled boolean")
    df = spark.createDataFrame([(f"h{i}",) for i in range(400)], "content_hash string")
    points = sorted((stable(f"{p}:{i}"), p) for p in ("p1", "p2") for i in range(128))
    for r in cluster.select_pool(df, pools).collect():
        h = stable("block:" + r.content_hash)
        assert r.pool_id == next((p for at, p in points if at >= h), points[0][1])
    grown = cluster.moved(df, pools, pools.withColumn("enabled", F.lit(True))).collect()
    assert 0 < len(grown) < 300 and {r.to_pool for r in grown} == {"p3"}


def test_capacity(spark):
    pools = spark.createDataFrame([("a", 100), ("b", 10_000_000), ("c", None)], "pool_id string, capacity_bytes long")
    usage = spark.createDataFrame([("a", 90), ("a", 5), ("b", 10)], "pool_id string, size_bytes long")
    got = {r.pool_id: (r.used_bytes, r.state) for r in cluster.capacity(usage, pools).collect()}
    assert got == {"a": (95, "Full"), "b": (10, "Normal"), "c": (0, "Normal"), None: (105, "Normal")}
    before = cluster.capacity(usage.where("size_bytes = 90"), pools)
    assert [tuple(r) for r in cluster.state_changes(before, cluster.capacity(usage, pools)).collect()] == [("a", "Critical", "Full")]


def test_topology_tiers_shards(spark):
    df = spark.createDataFrame([("b", "Index"), ("a", "Storage")], "node_id string, role string")
    assert [r.node_id for r in cluster.topology(df).collect()] == ["a", "b"] and cluster.topology(df, "Storage").count() == 1
    rows = spark.createDataFrame([("Hot", 5, 1), ("Hot", 1, 2), ("Cold", 0, 3)], "tier string, priority int, seq int")
    assert [tuple(r) for r in cluster.tiers(rows).collect()] == [("Cold", 0), ("Hot", 1)]
    assert [r.shard_id for r in cluster.shards(spark, 2).collect()] == ["shard-0", "shard-1"]


def valid():
    o = config.Options()
    o.storage.pools = [config.PoolOptions("p", "/data")]
    o.cluster.node_id = "n"
    return o


def test_valid_options():
    assert config.validate(valid()) == []
    assert config.validate(None)[0].domain == "root"


@pytest.mark.parametrize(
    "change,field",
    [
        (lambda o: setattr(o.state_machine, "transition_timeout", timedelta(0)), "transition_timeout"),
        (lambda o: setattr(o.state_machine, "max_optimistic_retries", -1), "max_optimistic_retries"),
        (lambda o: setattr(o.storage, "pools", []), "pools"),
        (lambda o: setattr(o.storage.pools[0], "root_path", " "), "root_path"),
        (lambda o: o.storage.pools.append(config.PoolOptions("p", "/x")), "pool_id"),
        (lambda o: setattr(o.storage.pipeline, "buffer_size", 0), "buffer_size"),
        (lambda o: setattr(o.storage.pipeline, "max_concurrency", 0), "max_concurrency"),
        (lambda o: setattr(o.index, "default_page_size", 2000), "default_page_size"),
        (lambda o: setattr(o.index, "max_page_size", 0), "max_page_size"),
        (lambda o: setattr(o.index.sharding, "shard_count", 0), "shard_count"),
        (lambda o: o.backup.schedules.append(config.BackupScheduleOptions("s", target_id="no")), "schedules"),
        (lambda o: setattr(o.backup, "default_target_id", "no"), "default_target_id"),
        (lambda o: setattr(o.cluster.replication, "read_quorum", 1), "replication"),
        (lambda o: setattr(o.cluster, "node_id", " "), "node_id"),
        (lambda o: (setattr(o.lifecycle, "archive_after", timedelta(2)), setattr(o.lifecycle, "delete_after", timedelta(1))), "archive_after"),
    ],
)
def test_invalid_options(change, field):
    o = valid()
    change(o)
    assert field in {p.field for p in config.validate(o)}


def test_notifier():
    n, heard = config.Notifier(valid()), []
    stop = n.subscribe(heard.append)
    assert n.reload(valid()) == [] and len(heard) == 1
    assert n.reload(config.Options()) and len(heard) == 1
    stop()
    n.reload(valid())
    assert len(heard) == 1
