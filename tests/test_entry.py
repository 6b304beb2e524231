"""Every query that has SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    result = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in result.fetchall()]
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["q_erase_entries", "q_erase"])
def test_erase_where_texts_are_chunks_of_others(spark, tmp_path, name):
    texts = ["This.", "a" * 1024 + "This.", "b" * 1024 + "De.", "De.", "c" * 1024, "c" * 2048 + "A.", "d" * 1024 + "A.", "e", "A."]
    con = duckdb.connect()
    con.execute("create table documents as select unnest(range(len($t)))::bigint as doc_id, unnest($t) as text, 'en' as lang, 'src0' as source, 9::bigint as n_chars", {"t": texts})
    con.execute("create table labels as select doc_id, 1 as quality, 0 as toxic from documents")
    for t in ("documents", "labels"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
