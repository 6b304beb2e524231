"""What was written and read back: plans, replaced keys, kinds that survive."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_query import row

from tessera.functions import hashing
from tessera.model import ENTRY
from tessera.operators import backup, cluster, lifecycle, store
from tessera.plans import query
from tessera.plans.query import Query
from tessera.sources import catalog, json_store, kv


@pytest.fixture
def path(spark, tmp_path):
    rows = [row(f"h{i}", f"/{'ab'[i % 2]}/{i}", "x", "Hot", "Available", i, i, ["", "src1", "a b/c"][i % 3]) for i in range(30)]
    catalog.write(spark.createDataFrame(rows, ENTRY), str(tmp_path / "c"))
    return str(tmp_path / "c")


def test_blank_and_odd_namespaces_survive(spark, path):
    held = catalog.read(spark, path)
    assert held.columns == ENTRY.names and held.count() == 30
    for name in ("", "src1", "a b/c"):
        got = query.filtered(held, Query(name)).collect()
        assert len(got) == 10 and {r.namespace_id for r in got} == {name}


def test_namespace_prunes_and_predicates_are_pushed(spark, path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = query.filtered(catalog.read(spark, path), Query("src1", key_prefix="/a/", size=(3, None))).select("content_hash")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "folder" in filters and "src1" in filters and "StringStartsWith(object_key,/a/)" in plan and "GreaterThanOrEqual(size_bytes,3)" in plan
    scan = plan[plan.index("ReadSchema") :]
    assert "tags" not in scan and "attributes" not in scan and "created_at" not in scan
    assert df.count() == 5


def test_repeated_keys_of_a_batch(spark):
    t = spark.createDataFrame([(b"a", b"old")], "key binary, value binary")
    new = spark.createDataFrame([(b"a", b"z", 1), (b"a", None, 2), (b"b", b"1", 1)], "key binary, value binary, seq int")
    assert sorted((bytes(r.key), bytes(r.value)) for r in kv.put(t, new).collect()) == [(b"a", b""), (b"b", b"1")]
    assert sorted((bytes(r.key), bytes(r.value)) for r in kv.put(t, new.drop("seq")).collect()) == [(b"a", b"z"), (b"b", b"1")]


def test_manifest_saved_twice_is_one(spark, tmp_path):
    rows = spark.createDataFrame([row(f"h{i}", f"/{i}", "x", "Hot", "Available", i, i, "default") for i in range(3)], ENTRY)
    m, at = backup.full(rows, "b1"), str(tmp_path / "m")
    backup.write_manifests(m, at)
    backup.write_manifests(backup.full(rows.limit(1), "b2"), at)
    backup.write_manifests(m.limit(2), at)
    assert [backup.read_manifest(spark, at, b, m.schema).count() for b in ("b1", "b2", "none")] == [2, 1, 0]


def test_json_documents_keep_kinds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_store, "PER_DOCUMENT", 4)
    rows = spark.createDataFrame([row(f"h{i}", f"/{i}", "x", "Hot", "Available", i, i, "n") for i in range(20)], ENTRY)
    from tessera.functions.attributes import attribute, attributes

    n = F.col("size_bytes")
    rows = rows.withColumn("attributes", attributes(a=attribute(n, "long"), b=attribute(n.cast("double"), "double"), c=attribute(F.lit('q"}|{"v":1'), "string"), d=attribute(n > 3, "bool")))
    json_store.write(rows, str(tmp_path / "j"))
    got = json_store.read(spark, str(tmp_path / "j"))
    assert sorted(got.select("content_hash", "attributes").collect()) == sorted(rows.select("content_hash", "attributes").collect())
    assert len(list((tmp_path / "j").glob("part=*"))) > 1


def test_hot_object_is_folded_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "PIECE", 20)
    names = ["Put", "Index", "Audit", "Publish", "Archive", "Restore", "Expire", "Purge"]
    steps = [(1, datetime(2024, 1, 1), i, names[i % 6]) for i in range(600)] + [(k, datetime(2024, 1, k), 1, "Put") for k in range(2, 9)]
    df = spark.createDataFrame(steps, "object_id long, ts timestamp_ntz, seq long, trigger string")
    from tessera.model import TRANSITIONS

    table, now = {(t, a): b for t, a, b in TRANSITIONS}, "Pending"
    for *_, t in steps[:600]:
        now = table.get((t, now), now)
    got = {r.object_id: (r.state, r.n_steps) for r in lifecycle.fold(df).collect()}
    assert got == {1: (now, 600), **{k: ("Stored", 1) for k in range(2, 9)}}


def test_stable_hash_is_the_fold_of_bytes(spark):
    import hashlib

    texts = ["", "a", "node1:7", "é", "x" * 1000, *map(str, range(200))]

    def fold(t):
        r = 0
        for b in hashlib.sha256(t.encode()).digest()[:16]:
            r = (r * 31 + b) % 2**64
        return r - 2**64 if r >= 2**63 else r

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.stable_hash("t").alias("h")).collect()
    assert all(r.h == fold(r.t) for r in got)


def test_topology_and_warm_start(spark, tmp_path):
    t = cluster.Topology(spark.createDataFrame([("a", "Storage"), ("b", "Index")], "node_id string, role string"))
    assert [r.version for r in t.list("Index").collect()] == [1] and [r.version for r in t.list().collect()] == [2, 2]
    rows = spark.createDataFrame([row(f"h{i}", "/", "x", "Hot", "Available", 1, 1, "n") for i in range(3)], ENTRY)
    assert store.warm(rows, str(tmp_path / "none")).count() == 0
    store.persist_hot(spark.createDataFrame([("h1",), ("gone",)], "content_hash string"), str(tmp_path / "hot"))
    assert [r.content_hash for r in store.warm(rows, str(tmp_path / "hot")).collect()] == ["h1"]
    assert cluster.migrate_shard(rows, "shard-0", "a") is rows


def test_stream_in_event_time(spark, tmp_path):
    """Triggers that arrive out of order, over several micro-batches, are applied in order; a guard holds some back."""
    import random

    from tessera.model import TRANSITIONS
    from tessera.streaming import lifecycle as stream

    rnd = random.Random(3)
    names = ["Put", "Index", "Audit", "Publish", "Archive", "Restore", "Delete", "Purge"]
    steps = [(k, datetime(2024, 1, 1, i // 60, i % 60), i, names[i // 3 % 8] if rnd.random() < 0.8 else rnd.choice(names)) for k in (1, 2) for i in range(40)]
    arrive = sorted(steps, key=lambda s: s[2] + rnd.randint(0, 8))
    schema = "object_id long, ts timestamp, seq long, trigger string"
    source = tmp_path / "in"
    for n in range(4):
        part = arrive[n * 20 : (n + 1) * 20]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    # one far behind them all lets the watermark pass
    spark.createDataFrame([(9, datetime(2024, 1, 3), 0, "Put")], schema).coalesce(1).write.mode("append").parquet(str(source))
    rows, got = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), {}

    def keep(batch, n):
        for r in batch.collect():
            got[r.object_id] = (r.state, r.n_steps)

    guard = F.col("seq") % 7 != 0
    out = stream.states_in_order(rows, "20 minutes", guard=guard)
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    table = {(t, a): b for t, a, b in TRANSITIONS}
    for k in (1, 2):
        now = "Pending"
        for o, _, i, t in steps:
            if o == k and i % 7:
                now = table.get((t, now), now)
        assert got[k] == (now, 40)
