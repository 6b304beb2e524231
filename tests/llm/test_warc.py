import base64
import hashlib
import random
import struct

import pytest
import zstandard

from tessera.llm import warc


def rows(n=300):
    rnd = random.Random(4)
    words = ["<p>%s</p>" % "".join(rnd.choices("abcdefgh é", k=9)) for _ in range(80)]
    common = "".join(rnd.choices(words, k=40))
    out = []
    for i in range(n):
        html = rnd.choice([None, "", common, common, "<b>", "".join(rnd.choices(words, k=rnd.randint(1, 400)))])
        out.append((i, rnd.choice([None, f"http://x/{i}", "http://é/ a\r\nWARC-Type: evil"]), html, 1))
    out += [(None, "http://none", common, 1), (None, None, None, 1), (10**12, "http://long", "é" * 300_000, 1), (-5, "http://minus", common, 1)]
    out += out[:4]
    rnd.shuffle(out)
    return out


def brute(data, least):
    last: dict = {}
    for i, _, h, _ in data:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, _, h, _ in data:
        p = (h or "").encode()
        refers = last.get(p) if i is not None and last.get(p) != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,archive_bytes", [(0, 1 << 25), (4, 40_000)])
def test_round_trip(spark, tmp_path, least, archive_bytes):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string, key int")
    manifest = warc.write(df, least, archive_bytes)
    got = warc.read(manifest).collect()
    exported = warc.export(manifest, str(tmp_path / "files")).collect()
    assert {(r.archive, r.bytes) for r in exported} == {(r.archive, r.bytes) for r in manifest.collect()} == {(f.name, f.stat().st_size) for f in (tmp_path / "files").iterdir() if f.suffix == ".zst"}
    assert sorted(warc.read(warc.files(spark, str(tmp_path / "files"))).collect(), key=str) == sorted(got, key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data, least)
    html = {}
    for i, _, h, _ in data:
        html.setdefault(i, set()).add((h or "").encode())
    assert all(r.payload in html[r.page_id] if r.record_type == "response" else r.payload is None for r in got)
    assert sum(r.records for r in manifest.collect()) == len(data)
    urls = {r.page_id: r.url for r in got}
    assert {u for u in urls.values() if u and "evil" in u} == {"http://é/%20a%0D%0AWARC-Type:%20evil"}


def test_archives_are_frames_with_a_dictionary_first():
    records = [warc.record(i, f"http://x/{i}", (f"<p>{i} some text that all of them share, more or less</p>" * 5).encode(), None, False, "2024-01-01T00:00:00Z") for i in range(200)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size
    assert list(warc.records_of(data)) == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - size < 0.8 * plain
    for few in ([], records[:1], records[:9], [b"x" * 10], [warc.FULL_DICTIONARY * 9], [b"\0" * 5000] * 3, [b"a"]):
        made = warc.archive(few)
        assert list(warc.records_of(made)) == few
        assert bool(struct.unpack_from("<II", made)[1]) == bool(few)
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-3]))


def test_archives_of_few_large_records_have_a_dictionary():
    rnd = random.Random(6)
    words = ["<p>%s</p>" % "".join(rnd.choices("abcdefgh", k=9)) for _ in range(3000)]
    for n in (8, 15, 50):
        records = ["".join(rnd.choices(words, k=(33 << 20) // n // 16)).encode() for _ in range(n)]
        assert sum(map(len, records)) > warc.ARCHIVE_BYTES
        data = warc.archive(records)
        assert struct.unpack_from("<II", data)[1], n
        assert list(warc.records_of(data)) == records


def test_record_ids_hold_page_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 10**12):
        assert warc.page_of(f"<{warc.record_id(i)}>") == i
    assert warc.page_of(warc.record_id(None)) is None


def test_empty_table(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(manifest).count() == 0


def test_a_file_system_that_only_hadoop_knows(spark, tmp_path):
    """Archives are written and read, and exported, below a mount."""
    conf, key = spark._jsc.hadoopConfiguration(), "fs.viewfs.mounttable.archives.link./all"
    (tmp_path / "real").mkdir()
    conf.set(key, f"file://{tmp_path}/real")
    try:
        data = [(i, f"http://x/{i}", "<p>some text</p>" * i, 1) for i in range(30)]
        df = spark.createDataFrame(data, "page_id long, url string, html string, n int")
        held = warc.write(df, path="viewfs://archives/all/rows")
        assert sorted(r.page_id for r in warc.read(held).collect()) == list(range(30))
        warc.export(held, "viewfs://archives/all/files")
        assert warc.read(warc.files(spark, "viewfs://archives/all/files")).count() == 30
        assert list((tmp_path / "real" / "files").glob("*.warc.zst"))
    finally:
        conf.unset(key)


def test_names_of_file_systems():
    assert warc.SCHEMES["s3a"] == "s3"
