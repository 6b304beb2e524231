import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_query import row

from tessera.model import ENTRY, TRANSITIONS
from tessera.operators import lifecycle, store
from tessera.streaming import lifecycle as streaming

AS_OF = datetime(2024, 6, 1)


def brute(steps, start="Pending"):
    table = {(t, a): b for t, a, b in TRANSITIONS}
    out: dict = {}
    for o, _, _, t in sorted(steps, key=lambda s: (s[1], s[2])):
        state, n = out.get(o, (start, 0))
        out[o] = table.get((t, state), state), n + 1
    return out


def steps(seed, n):
    rnd = random.Random(seed)
    names = sorted({t for t, _, _ in TRANSITIONS}) + ["Nothing"]
    weights = [3 if t in ("Put", "Index", "Audit", "Publish") else 1 for t in names]
    return [(rnd.choice([1, 1, 1, 2, 3, 4]), datetime(2024, 1, 1) + timedelta(hours=rnd.randint(0, 200)), i, rnd.choices(names, weights)[0]) for i in range(n)]


SCHEMA = "object_id long, ts timestamp_ntz, seq long, trigger string"


@pytest.mark.parametrize("n", [0, 5, 300])
def test_fold(spark, n):
    data = steps(n, n)
    got = lifecycle.fold(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.object_id: (r.state, r.n_steps) for r in got} == brute(data)


def test_fold_goes_on_from_known_states(spark):
    data = [(1, AS_OF, 1, "Archive"), (2, AS_OF, 1, "Archive")]
    known = spark.createDataFrame([(1, "Available")], "object_id long, state string")
    got = lifecycle.fold(spark.createDataFrame(data, SCHEMA), known).collect()
    assert {r.object_id: r.state for r in got} == {1: "Archived", 2: "Pending"}


def entries(spark):
    states = ["Pending", "Stored", "Available", "Archived", "Deleted", "Expired", "Purged"]
    return spark.createDataFrame([row(s.lower(), "k", "x", "Hot", s, 10 * i, i) for i, s in enumerate(states)], ENTRY)


def after(df):
    return {r.content_hash: r.state for r in df.collect()}


def test_fire(spark):
    put = after(lifecycle.fire(entries(spark), lifecycle.default_registry(), "Put"))
    assert put["pending"] == "Stored" and put["stored"] == "Stored"
    purge = after(lifecycle.fire(entries(spark), lifecycle.default_registry(), "Purge"))
    assert (purge["deleted"], purge["expired"], purge["purged"], purge["available"]) == ("Purged", "Purged", "Purged", "Available")
    denied = lifecycle.default_registry(archive=F.lit(False))
    assert after(lifecycle.fire(entries(spark), denied, "Archive"))["available"] == "Available"
    with pytest.raises(lifecycle.GuardDenied):
        lifecycle.fire(entries(spark), denied, "Archive", throw=True)
    some = lifecycle.default_registry(archive=F.col("size_bytes") > 5)
    assert after(lifecycle.fire(entries(spark), some, "Archive"))["available"] == "Archived"


def test_registry(spark):
    r = lifecycle.Registry()
    r.on("Go").from_("A").to("B").guard(F.col("size_bytes") > 1).do(lambda rows: rows.withColumn("tier", F.lit("Cold")))
    with pytest.raises(ValueError):
        r.on("Go").from_("A").to("C")
    df = spark.createDataFrame([row("x", "k", "o", "Hot", "A", 2, 1), row("y", "k", "o", "Hot", "A", 1, 1), row("z", "k", "o", "Hot", "B", 9, 1)], ENTRY)
    got = {x.content_hash: (x.state, x.tier, x.moved) for x in lifecycle.fire(df, r, "Go").collect()}
    assert got == {"x": ("B", "Cold", True), "y": ("A", "Hot", False), "z": ("B", "Hot", False)}
    assert r.table(spark).count() == 1 and lifecycle.default_registry().table(spark).count() == 11


def test_log_and_versions(spark):
    moved = lifecycle.fire(entries(spark), lifecycle.default_registry(), "Delete")
    assert sorted(tuple(r) for r in lifecycle.transition_log(moved, "Delete").collect()) == [
        ("archived", "object.delete", "[state-machine] Archived --(Delete)--> Deleted"),
        ("available", "object.delete", "[state-machine] Available --(Delete)--> Deleted"),
    ]
    saves = spark.createDataFrame([("a", "Stored", 1), ("a", "Indexed", 2), ("b", "Stored", 5)], "content_hash string, state string, seq int")
    assert sorted(tuple(r) for r in lifecycle.versions(saves).collect()) == [("a", "Indexed", 2), ("b", "Stored", 1)]
    asked = spark.createDataFrame([("a",), ("c",)], "content_hash string")
    assert {r.content_hash: r.state for r in lifecycle.load_states(asked, lifecycle.versions(saves)).collect()} == {"a": "Indexed", "c": "Pending"}


def test_scan_asks_in_all_namespaces(spark):
    df = entries(spark).unionByName(spark.createDataFrame([row("far", "k", "x", "Hot", "Available", 99, 1, "other"), row("keep", "k", "x", "Hot", "Available", 1, 1)], ENTRY))
    got = lifecycle.scan(df, F.col("size_bytes") >= 20, F.col("size_bytes") >= 50).collect()
    assert {r.content_hash: r.trigger for r in got} == {"available": "Archive", "far": "Expire"}


def test_put_get_delete_archive_restore(spark):
    none = spark.createDataFrame([], ENTRY)
    blocks = spark.createDataFrame([], "content_hash string, content binary")
    puts = spark.createDataFrame([("app", b"data", "/k", 1), ("ns2", b"data", "/k2", 2), ("app", b"bad", "/b", 3)], "namespace_id string, content binary, object_key string, seq int")
    blocks, df, result = lifecycle.put(none, blocks, puts, AS_OF, F.col("object_key") != "/b")
    got = df.collect()
    assert len(got) == 1 and (got[0].namespace_id, got[0].size_bytes, got[0].state, got[0].object_key) == ("ns2", 4, "Available", "/k2")
    assert blocks.count() == 2 and sorted(r.succeeded for r in result.collect()) == [False, True, True]
    again = lifecycle.put(df, blocks, puts.where("seq = 1"), AS_OF)
    assert again[0].count() == 2 and again[2].first().deduplicated
    with pytest.raises(ValueError):
        lifecycle.put(none, blocks, puts.withColumn("namespace_id", F.lit(" ")), AS_OF)
    h = df.select("content_hash")
    r = lifecycle.get(df, blocks, h, 1, 2).first()
    assert (bytes(r.content), r.length) == (b"at", 2)
    df, done = lifecycle.archive(df, h, AS_OF)
    assert done.first().succeeded and (df.first().state, df.first().tier) == ("Archived", "Cold")
    assert lifecycle.get(df, blocks, h).first().content is None
    df, _ = lifecycle.restore(df, h, AS_OF)
    assert (df.first().state, df.first().tier) == ("Available", "Cold")
    df, _ = lifecycle.delete(df, h, AS_OF)
    assert df.first().state == "Deleted" and not lifecycle.archive(df, h, AS_OF)[1].first().succeeded
    ghost, _ = lifecycle.delete(df, spark.createDataFrame([("unknown",)], "content_hash string"), AS_OF)
    assert store.get(ghost, "unknown").first().namespace_id == "default"
    assert lifecycle.sync_index(df, spark.createDataFrame([(" ", "Purged")], "content_hash string, state string"), AS_OF).count() == 1


def test_stream_ends_where_the_fold_does(spark, tmp_path):
    data = sorted(steps(7, 120), key=lambda s: (s[1], s[2]))
    for i in range(0, 120, 40):
        spark.createDataFrame(data[i : i + 40], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = streaming.states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        last = spark.sql("select object_id, max_by(state, n_steps) s, max(n_steps) n from states group by 1").collect()
    finally:
        query.stop()
    assert {r.object_id: (r.s, r.n) for r in last} == brute(data)
    topics = streaming.transitions(stream, str(tmp_path / "out"), str(tmp_path / "c2"))
    try:
        topics.processAllAvailable()
    finally:
        topics.stop()
    assert spark.read.parquet(str(tmp_path / "out")).where("topic like 'object.%'").count() == 120
