import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_query import attr, row

from tessera.functions import hashing
from tessera.model import ENTRY
from tessera.operators import blobs, maintain, store
from tessera.sources import files, json_store, kv

AS_OF = datetime(2024, 6, 1)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_upsert_delete_get(spark):
    base = table(spark, row("a", "k", "x", "Hot", "Stored", 1, 1), row("b", "k", "x", "Hot", "Stored", 2, 1))
    new = table(spark, row("b", "k2", "y", "Cold", "Stored", 3, 1, "ns2"), row("b", "k3", "y", "Cold", "Stored", 4, 1, "ns2"), row("c", None, "y", "Cold", "Stored", 5, 1))
    got = {r.content_hash: r for r in store.upsert(base, new.withColumn("seq", F.col("size_bytes")), "seq").collect()}
    assert {h: (r.size_bytes, r.namespace_id) for h, r in got.items()} == {"a": (1, "app"), "b": (4, "ns2"), "c": (5, "app")}
    assert got["b"].tags == {"owner": "y"}
    assert [r.content_hash for r in store.delete(base, new).collect()] == ["a"]
    assert store.get(base, "a").count() == 1 and store.get(base, "zz").count() == 0 and store.clear(base).count() == 0


def test_get_many(spark):
    base = table(spark, *[row(h, "k", "x", "Hot", "Stored", 1, 1) for h in "abc"])
    asks = spark.createDataFrame([(1, "c"), (2, "a"), (3, "missing"), (4, "c")], "pos int, content_hash string")
    assert [r.content_hash for r in store.get_many(base, asks).collect()] == ["c", "a", "c"]
    assert [r.content_hash for r in store.get_many(base, asks, repeats=False).collect()] == ["c", "a"]


def test_patch_merges_and_removes(spark):
    base = table(spark, row("a", "k", "x", "Hot", "Stored", 1, 1, attributes=attr(n=1, m=2)), row("b", "k", "x", "Hot", "Stored", 1, 1))
    change = spark.createDataFrame(
        [("a", "Cold", {"owner": "y", "t": "1"}, ["t"], attr(n=9, s="new"), ["m"], None), ("new", None, None, None, None, None, "Deleted")],
        "content_hash string, tier string, tags map<string,string>, remove_tags array<string>, attributes " + ENTRY["attributes"].dataType.simpleString() + ", remove_attributes array<string>, state string",
    )
    got = {r.content_hash: r for r in store.patch(base, change, AS_OF).collect()}
    a, b, new = got["a"], got["b"], got["new"]
    assert a.tags == {"owner": "y"} and a.tier == "Cold" and a.state == "Stored" and a.modified_at == AS_OF
    assert {k: v.l if v.kind == "long" else v.s for k, v in a.attributes.items()} == {"n": 9, "s": "new"}
    assert b.modified_at != AS_OF and b.tier == "Hot"
    assert (new.namespace_id, new.tier, new.state, new.tags) == ("default", "Hot", "Deleted", {})


def test_json_document(spark, tmp_path):
    path = str(tmp_path / "doc")
    rows = [row("a", '/a/"q"', "x}|{", "Hot", "Available", 7, 1, attributes=attr(owner='tr"ac}', reviews=3, enabled=True, score=4.5)), row("b", None, "y", "Cold", "Stored", 1, 1, "ns2")]
    json_store.write(table(spark, *rows), path)
    got = sorted(json_store.read(spark, path).collect())
    want = sorted(table(spark, *rows).collect())
    assert [{k: v for k, v in r.asDict(True).items()} for r in got] == [r.asDict(True) for r in want]
    assert json_store.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text('{"Version": 1, "Entries": [{')
    assert json_store.read(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "odd.json").write_text('{"Version":1,"Entries":[{"ContentHash":"h","Tier":"cOLD","State":"odd","Attributes":{"x":[1,2],"n":null,"big":99999999999999999999}}]}')
    r = json_store.read(spark, str(tmp_path / "odd.json")).first()
    assert (r.tier, r.state, r.tags, set(r.attributes)) == ("Cold", "Pending", {}, {"x", "big"})
    assert r.attributes["x"].s == "[1,2]" and r.attributes["big"].kind == "double"


def test_kv(spark):
    t = spark.createDataFrame([(bytes([b]), bytes([b, b])) for b in (1, 127, 128, 255)], "key binary, value binary")
    assert [bytes(r.key) for r in kv.scan(t, F.lit(b"\x7f"), F.lit(b"\xff")).collect()] == [b"\x7f", b"\x80"]
    assert kv.scan(t).count() == 4
    t = kv.put(t, spark.createDataFrame([(b"\x01", None), (b"\x01\x02", b"z")], "key binary, value binary"))
    assert [(bytes(r.key), bytes(r.value)) for r in kv.scan(t, None, F.lit(b"\x02")).collect()] == [(b"\x01", b""), (b"\x01\x02", b"z")]
    assert kv.exists(t, F.lit(b"\xff")) and not kv.exists(kv.delete(t, t.where("hex(key) = 'FF'")), F.lit(b"\xff"))


def test_hot_set(spark):
    reads = [(h, i) for i, h in enumerate("aaabbbbccddd")]
    df = spark.createDataFrame(reads, "content_hash string, tick int")
    assert [r.content_hash for r in store.hot_set(df, 2).collect()] == ["b", "d"]
    assert store.hot_set(df, 9, 4).count() == 1


def content(n):
    return bytes((i * 2654435761 & 0xFFFFFFFF) >> 24 for i in range(n))


def test_hashes_and_paths(spark):
    vectors = {"block:key": -87528722646906127, "k": 586830749541163500, "a:0": -3589110263367432331, "b:0": 3010171193796573848, "c:0": 7894565180159900327, "ns1": 7387677137047548330, "app": -912780995554162657, "default": 4935489562400929948}
    df = spark.createDataFrame([(k,) for k in vectors], "k string")
    assert {r.k: r.h for r in df.withColumn("h", hashing.stable_hash("k")).collect()} == vectors
    shards = {r.k: r.s for r in df.withColumn("s", hashing.shard("k", 4)).collect()}
    assert (shards["ns1"], shards["app"], shards["default"]) == ("shard-2", "shard-1", "shard-0")
    r = spark.createDataFrame([("abcdef",)], "h string").select(hashing.block_path("h").alias("b"), hashing.manifest_path("h").alias("m"), hashing.backup_manifest_path("h").alias("x"), hashing.block_path(F.lit(" ")).alias("none")).first()
    assert tuple(r) == ("blocks/ab/cd/abcdef", "manifests/ab/cd/abcdef.manifest", "backups/abcdef/manifest.json", None)


def test_chunks_and_ranges(spark):
    sizes = (100, 1000, 1024, 3000, 0)
    df = spark.createDataFrame([(n, content(n)) for n in sizes], "n int, content binary")
    m = blobs.manifest(df, 1024)
    rows = m.orderBy("pos").collect()
    assert [(r.pos, r.begin, r.end, r.total_size) for r in rows] == [(0, 0, 1024, 3000), (1, 1024, 2048, 3000), (2, 2048, 3000, 3000)]
    assert rows[0].content_hash == "416b6d6783fba12823f4180fe7b9b7a238932d6eed210a91e66122650cce468d"
    assert [r.chunk_hash[:8] for r in rows] == ["40e6fe33", "43ded373", "763581aa"]
    whole, blocks = content(3000), blobs.chunk_blobs(df, 1024)
    for offset, length, want in [(1021, 9, whole[1021:1030]), (0, -1, whole), (2999, 50, whole[2999:]), (-5, 9, whole[:9])]:
        assert bytes(blobs.read_chunked(m, blocks, offset, length).first().slice) == want
    assert blobs.read_chunked(m, blocks, 5000, 3).count() == 0
    for offset, length, want in [(0, 3, content(1000)[:3]), (100, 10, content(1000)[100:110]), (995, -1, content(1000)[995:]), (-5, 2, content(1000)[:2]), (2000, 5, b"")]:
        assert bytes(blobs.read_range(df.where("n = 1000"), offset, length).first().slice) == want


def test_dedup_and_erase(spark):
    df = spark.createDataFrame([(1, b"one" * 500), (2, b"one" * 500), (3, b"two" * 500), (4, b"small")], "id int, content binary")
    new = blobs.new_blobs(df)
    assert new.count() == 3 and blobs.new_blobs(df, new).count() == 0
    assert {r.content_hash for r in new.collect()} == {hashlib.sha256(b).hexdigest() for b in (b"one" * 500, b"two" * 500, b"small")}
    m, chunks = blobs.manifest(df.where("id <> 2"), 600), blobs.chunk_blobs(df, 600)
    entries = blobs.hashed(df.where("id <> 2")).select("content_hash")
    gone = entries.where(F.col("content_hash") == hashlib.sha256(b"one" * 500).hexdigest())
    e, b, left = blobs.erase(entries, chunks, m, gone)
    assert e.count() == 2 and left.select("content_hash").distinct().count() == 1
    assert {r.content_hash for r in b.collect()} == {r.chunk_hash for r in left.collect()}


def test_erased_bytes_that_others_use_stay(spark):
    df = spark.createDataFrame([(b"one" * 300 + b"This.",), (b"This.",), (b"two" * 300 + b"De.",), (b"De.",), (b"A.",)], "content binary")
    sha = lambda *bs: {hashlib.sha256(b).hexdigest() for b in bs}
    m = blobs.manifest(df, 900)
    store_ = blobs.new_blobs(df.where("octet_length(content) <= 900")).select("content_hash", "content").unionByName(blobs.chunk_blobs(df, 900)).dropDuplicates(["content_hash"])
    gone = spark.createDataFrame([(h,) for h in sha(b"This.", b"two" * 300 + b"De.", b"A.")], "content_hash string")
    e, b, left = blobs.erase(blobs.hashed(df).select("content_hash"), store_, m, gone)
    assert {r.content_hash for r in e.collect()} == sha(b"one" * 300 + b"This.", b"De.")
    assert {r.content_hash for r in b.collect()} == sha(b"one" * 300, b"This.", b"De.")
    assert {r.chunk_hash for r in left.collect()} == sha(b"one" * 300, b"This.")


def test_maintenance(spark):
    entries = table(spark, row("there", "k", "x", "Hot", "Stored", 1, 1), row("gone", "k", "x", "Hot", "Stored", 1, 1), row(" ", "k", "x", "Hot", "Stored", 1, 1))
    blocks = spark.createDataFrame([("there",), ("loose",)], "content_hash string")
    assert [r.content_hash for r in maintain.missing(entries, blocks).collect()] == ["gone"]
    assert sorted(r.content_hash for r in maintain.repair(entries, blocks).collect()) == [" ", "there"]
    assert [r.content_hash for r in maintain.orphans(entries, blocks).collect()] == ["loose"]
    assert tuple(maintain.verify(entries, blocks).first()) == (3, 1, False)
    assert tuple(maintain.verify(entries.limit(0), blocks).first()) == (0, 0, True)
    assert maintain.rebuild(entries).count() == 0
    states = spark.createDataFrame([("there", "Purged")], "content_hash string, state string")
    assert maintain.mismatches(entries, states).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "blobs" / "x").mkdir(parents=True)
    (tmp_path / "blobs" / "x" / "a.bin").write_bytes(b"123")
    (tmp_path / "blobs" / "b.bin").write_bytes(b"4567")
    root = str(tmp_path / "blobs")
    assert [tuple(r) for r in files.listing(spark, root).collect()] == [("b.bin", 4), ("x/a.bin", 3)]
    assert [r.path for r in files.listing(spark, root, "x/").collect()] == ["x/a.bin"]
    assert files.folder_size(spark, root).first().bytes == 7
    assert files.folder_size(spark, root + "none").first().bytes == 0
    assert files.blobs(spark, root).count() == 2


@pytest.mark.parametrize("n", [0, 1])
def test_rows_of_puts_have_defaults(spark, n):
    r = store.rows_of_puts(spark.createDataFrame([("h", "ns")] * n, "content_hash string, namespace_id string"), AS_OF).collect()
    assert len(r) == n and (not n or (r[0].tier, r[0].state, r[0].size_bytes, r[0].tags, r[0].created_at) == ("Hot", "Stored", 0, {}, AS_OF))
