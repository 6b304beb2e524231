from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.attributes import attribute
from tessera.model import ENTRY
from tessera.plans.query import AttributeRange, Query, decode_cursor, encode_cursor, filtered, ordered, page, page_frame, pages, selectivity
from tessera.sources import catalog

NOW = datetime(2024, 5, 1, 12)
SEED = [
    ("a1", "/docs/a.txt", "alice", "Hot", "Available", 50, 5),
    ("a2", "/docs/b.txt", "bob", "Hot", "Available", 5000, 10),
    ("a3", "/docs/c.txt", "bob", "Warm", "Available", 50000, 25),
    ("a4", "/media/photo.png", "alice", "Cold", "Archived", 1048576, 40),
    ("a5", "/logs/old.log", "sys", "Cold", "Available", 200, 2),
]


def attr(**values):
    kinds = {bool: ("bool", 2), int: ("long", 3), float: ("double", 4), str: ("string", 1)}
    out = {}
    for k, v in values.items():
        kind, place = kinds[type(v)]
        row = [kind, None, None, None, None]
        row[place] = v
        out[k] = tuple(row)
    return out


def row(h, key, owner, tier, state, size, age, ns="app", attributes=None):
    at = NOW - timedelta(minutes=age)
    return (h, ns, key, {"owner": owner}, attributes or {}, tier, size, "application/octet-stream", at, at, state)


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([row(*r) for r in SEED] + [row("zz", "/docs/z", "alice", "Hot", "Available", 1, 1, "other")], ENTRY).cache()


def hashes(df):
    return [r.content_hash for r in df.collect()]


@pytest.mark.parametrize(
    "query,want",
    [
        (Query("app", key_prefix="/docs/"), ["a1", "a2", "a3"]),
        (Query("app", tags={"owner": "alice"}), ["a1", "a4"]),
        (Query("app", tiers=["Cold"], states=["Available"]), ["a5"]),
        (Query("app", size=(1000, 100000)), ["a2", "a3"]),
        (Query("app", created=(NOW - timedelta(minutes=3), NOW - timedelta(minutes=1))), ["a5"]),
        (Query("app", modified=(None, NOW - timedelta(minutes=25))), ["a3", "a4"]),
        (Query("app"), ["a1", "a2", "a3", "a4", "a5"]),
        (Query("app", tags={"owner": "nobody"}), []),
        (Query("app", tiers=[]), []),
        (Query(), []),
    ],
)
def test_predicates(entries, query, want):
    assert sorted(hashes(filtered(entries, query))) == want


def test_orders(entries):
    assert hashes(ordered(entries, Query("app"))) == ["a4", "a3", "a2", "a1", "a5"]
    assert hashes(ordered(entries, Query("app", sort="SizeBytes", descending=True))) == ["a4", "a3", "a2", "a5", "a1"]
    assert hashes(ordered(entries, Query("app", sort="what"))) == ["a4", "a3", "a2", "a1", "a5"]


def test_null_keys_come_first_up_and_last_down(spark):
    df = spark.createDataFrame([row("b", None, "x", "Hot", "Stored", 1, 1), row("a", None, "x", "Hot", "Stored", 1, 1), row("c", "k", "x", "Hot", "Stored", 1, 1)], ENTRY)
    assert hashes(ordered(df, Query("app", sort="ObjectKey"))) == ["a", "b", "c"]
    assert hashes(ordered(df, Query("app", sort="ObjectKey", descending=True))) == ["c", "a", "b"]
    assert filtered(df, Query("app", key_prefix="")).count() == 1


@pytest.mark.parametrize("sort", ["CreatedAt", "SizeBytes", "ObjectKey", "ModifiedAt", "ContentHash"])
@pytest.mark.parametrize("down", [False, True])
def test_pages_walk_the_whole_order(spark, sort, down):
    df = spark.createDataFrame([row(f"h{i}", None if i % 4 == 0 else f"/k{i % 3}", "x", "Hot", "Stored", i % 3, i % 2) for i in range(11)], ENTRY).coalesce(1).cache()
    got = list(pages(df, Query("app", sort=sort, descending=down, page_size=3)))
    assert [len(p.items) for p in got] == [3, 3, 3, 2] and [p.has_more for p in got] == [True] * 3 + [False]
    assert [r.content_hash for p in got for r in p.items] == hashes(ordered(df, Query("app", sort=sort, descending=down)))


def test_page_sizes_and_bad_cursors(entries):
    assert len(page(entries, Query("app", page_size=0)).items) == 5
    first = page(entries, Query("app", page_size=2))
    assert first.has_more and [r.content_hash for r in first.items] == ["a4", "a3"]
    assert [r.content_hash for r in page(entries, Query("app", page_size=2, cursor="no base64!")).items] == ["a4", "a3"]
    assert decode_cursor(encode_cursor(None, "h"), "ObjectKey") == (None, "h")


def test_attribute_ranges(spark):
    values = [attr(n=5, s="m", b=True, d=4.5), attr(n=7, s="z", d=7.0), attr(n="text"), {}]
    df = spark.createDataFrame([row(f"h{i}", "k", "x", "Hot", "Stored", 1, 1, attributes=v) for i, v in enumerate(values)], ENTRY)

    def found(name, low=None, high=None):
        return sorted(hashes(filtered(df, Query("app", attribute_ranges=[AttributeRange(name, low, high)]))))

    assert found("n", 5, 6) == ["h0"] and found("n", 5.0, 7.0) == ["h0", "h1"] and found("n", None, 6) == ["h0"]
    assert found("d", 4, 5) == ["h0"] and found("d", 7, 7) == ["h1"]
    assert found("s", "a", "n") == ["h0"] and found("b", True, True) == ["h0"]
    assert found("n", "a", "u") == ["h2"] and found("n") == ["h0", "h1", "h2"] and found("none", 1, 2) == []


def test_plan_is_pushed_down(spark, entries, tmp_path):
    catalog.write(entries, str(tmp_path))
    df = page_frame(catalog.read(spark, str(tmp_path)), Query("app", key_prefix="/docs/", tiers=["Hot"], page_size=2))
    plan = df.select("content_hash", "created_at")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:120]
    assert "StringStartsWith(object_key,/docs/)" in plan and "TakeOrderedAndProject" in plan
    assert sorted(hashes(df)) == ["a1", "a2"]
    assert hashes(catalog.scan(catalog.read(spark, str(tmp_path)), "other")) == ["zz"]


def test_selectivity():
    assert selectivity(Query("app")) == [("FullScan", 1.0)]
    assert selectivity(Query("app", key_prefix="/docs/", tags={"a": "b"}, tiers=["Hot"])) == [("Tag", 1 / 64), ("Tier", 1 / 32), ("KeyPrefix", 1 / 7)]


def test_attribute_of_null_is_null(spark):
    assert spark.range(1).select(attribute(F.lit(None).cast("long"), "long").isNull().alias("x")).first().x
