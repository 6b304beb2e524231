import pytest
from pyspark.sql import functions as F
from test_query import row

from tessera.functions import hashing
from tessera.model import ENTRY
from tessera.operators import backup, cluster, lifecycle
from tessera.plans.query import decode_cursor
from tessera.sources import files


def test_targets(spark, tmp_path):
    t = files.Target(spark, str(tmp_path / "t"))
    t.write("blocks/aa/x", b"\x00\xff123")
    t.write("blocks/aa/x", b"again")
    assert t.exists("blocks/aa/x") and t.read("blocks/aa/x") == b"again" and t.read("none") is None
    t.write("blocks/bb/y", b"\x00\xff")
    assert t.read("blocks/bb/y") == b"\x00\xff"
    assert [r.path for r in t.listing("blocks/").collect()] == ["blocks/aa/x", "blocks/bb/y"]
    assert t.delete("blocks") and not t.exists("blocks/aa/x") and not t.delete("blocks")
    with pytest.raises(ValueError):
        t.read("../x")
    known = files.Targets()
    known.register("a", t)
    assert known.resolve("a") is t and known.ids() == ["a"]
    with pytest.raises(KeyError):
        known.resolve("b")


def test_schedules(spark):
    schema = "schedule_id string, cron string, target_id string"
    s = backup.schedule(spark.createDataFrame([("b", "0 1 * * *", "t")], schema), spark.createDataFrame([("a", "x", "u"), ("b", "y", "t")], schema))
    assert [(r.schedule_id, r.cron) for r in backup.schedule_listing(s).collect()] == [("a", "x"), ("b", "y")]
    assert backup.unschedule(s, "a").count() == 1
    assert [r.schedule_id for r in backup.unknown_targets(s, spark.createDataFrame([("t",)], "target_id string")).collect()] == ["a"]
    two = spark.createDataFrame([("x",), ("y",)], "backup_id string")
    assert [d.count() for d in backup.delete_backup(two, two, "x")] == [1, 1]


def test_observers_and_retries(spark):
    df = spark.createDataFrame([row("a", "k", "o", "Hot", "Available", 1, 1), row("b", "k", "o", "Hot", "Stored", 1, 1)], ENTRY)
    moved, heard = lifecycle.fire(df, lifecycle.default_registry(), "Archive"), []

    def fails(rows):
        raise RuntimeError("deaf")

    assert len(lifecycle.observe(moved, [fails, lambda rows: heard.append(rows.count())])) == 1 and heard == [1]
    with pytest.raises(RuntimeError):
        lifecycle.observe(moved, [fails], fail_fast=True)
    tries = iter([ValueError(), ValueError(), None])

    def save():
        if (e := next(tries)) is not None:
            raise e

    assert lifecycle.persist(save, backoff=0) == 3
    with pytest.raises(RuntimeError):
        lifecycle.persist(lambda: fails(None), 1, 0)


def test_cursor_columns(spark):
    df = spark.createDataFrame([(5, "h1"), (None, "h2")], "size_bytes long, content_hash string")
    rows = df.withColumn("t", hashing.cursor("size_bytes", "content_hash")).withColumn("h", hashing.cursor_hash("t")).collect()
    assert [decode_cursor(r.t, "SizeBytes") for r in rows] == [(5, "h1"), (None, "h2")] and [r.h for r in rows] == ["h1", "h2"]
    assert df.select(hashing.cursor_hash(F.lit("no base64!")).alias("x")).first().x is None


def test_rebalance(spark):
    moves = spark.createDataFrame([("a",), ("b",)], "content_hash string")
    assert tuple(cluster.rebalance_progress(moves, moves.limit(1)).first()) == (2, 1, 0.5, False)
    assert tuple(cluster.rebalance_progress(moves.limit(0), moves).first()) == (0, 0, 1.0, True)
    assert cluster.tier_migrations(moves, moves).count() == 4
