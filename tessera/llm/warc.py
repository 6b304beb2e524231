"""Dictionary-compressed WARC archives (.warc.zst).

An archive is a sequence of Zstandard frames. The first is skippable (magic
0x184D2A5D) and holds a dictionary built from the archive's own records, itself
compressed; then every WARC record is a frame of its own that uses it, so that a
reader can start at any record. Records that training finds no dictionary in (few
or short ones) are, as far as they fit, the dictionary themselves, as Zstandard
allows; an archive without records has an empty skippable frame.

Records with equal payloads of ``least`` bytes or more are written once, as the
response of the largest page_id; the others are revisits that refer to it.
Payloads are known by their SHA-256 and length; how many pages share one, and
the largest id, is counted before records move, so that a payload that a third
of all pages hold meets no task in full: its pages learn the id from a short
list of the commonest payloads and go anywhere.

Each task packs its rows into archives of about ``archive_bytes``; these are rows
(archive, records, bytes, data) that Spark writes and reads, in any file system
that it knows, so that a task that failed leaves nothing behind. ``export`` puts
them into files of their own, where Arrow can write; ``files`` reads such a folder.

Null html is an empty payload. A null url gives a record without target. Rows
without page_id are responses; rows that repeat both page_id and payload are
alike, so that all of the largest id are responses. Control characters and
spaces in urls are percent-encoded. Payloads are kept whole: one longer than an
archive has one of its own. Only page_id, url and html are read, so that other
columns can't clash. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed_lookup, stage, table

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Of an archive's records, spread over it, the dictionary is built from about so many bytes.
TRAINING_BYTES = 4 << 20
SAMPLE_BYTES = 128 << 10
SKIPPABLE = 0x184D2A5D
FULL_DICTIONARY = b"\x37\xa4\x30\xec"
#: Bytes of a record id's UUID that say it holds a page id, and its version and variant bits.
SPACE = 0x7E55E7A0
LEVEL = 3


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page id; a random one without."""
    if page_id is None:
        return f"urn:uuid:{uuid.uuid4()}"
    n = page_id & ((1 << 64) - 1)
    return f"urn:uuid:{uuid.UUID(int=SPACE << 96 | 8 << 76 | (n >> 62) << 64 | 2 << 62 | n & ((1 << 62) - 1))}"


def page_of(urn: str) -> int | None:
    u = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if u >> 96 != SPACE or u >> 76 & 15 != 8:
        return None
    n = (u >> 64 & 3) << 62 | u & ((1 << 62) - 1)
    return n - (1 << 64) if n >> 63 else n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has the payload's digest and length, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES, most: int = TRAINING_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from samples spread over all records, of about ``most`` bytes together; None without records."""
    total = sum(map(len, records))
    if not total:
        return None
    # all records in pieces, 16 of them at least; as far apart as leaves 8
    length = min(SAMPLE_BYTES, max(256, total // 16))
    pieces = [r[i : i + length] for r in records for i in range(0, len(r), length)]
    samples = pieces[:: max(1, min(-(-total // most), len(pieces) // 8))]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError as e:
            # what training says to samples that have too little in common; anything else is an error
            if not any(w in str(e) for w in ("Src size is incorrect", "not enough", "cannot train dict", "Error (generic)")):
                raise
    raw = b"".join(samples)[-size:]
    while raw[:4] == FULL_DICTIONARY:  # would be taken for a trained one
        raw = raw[1:]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """A dictionary in a skippable frame, then a frame for each record."""
    found = train(records)
    held = zstandard.ZstdCompressor(level=19).compress(found.as_bytes()) if found else b""
    options = {"dict_data": found} if found else {}
    compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("not a dictionary-compressed archive")
    held = data[8 : 8 + size]
    options = {"dict_data": zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held))} if held else {}
    d = zstandard.ZstdDecompressor(**options)
    rest = memoryview(data)[8 + size :]
    while rest:
        one = d.decompressobj()
        out = [one.decompress(rest[: 1 << 16])]
        at = min(1 << 16, len(rest))
        while not one.eof:
            if at >= len(rest):
                raise ValueError("the last record is cut off")
            out.append(one.decompress(rest[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(rest))
        rest = rest[at - len(one.unused_data) :]
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def resolve(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to, the id of the response that a revisit stands for."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    key = F.when((size >= least) & F.col("page_id").isNotNull(), F.concat(F.sha2("html", 256), F.lit(":"), size.cast("string")))
    rows = rows.withColumn("key", key)
    shared = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    # rows without a key go anywhere
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("alone:"), F.monotonically_increasing_id().cast("string"))))
    found = keyed_lookup(rows, stage(shared.where("n > 1"), "payloads"), "key")
    refers = F.when(F.col("response") != F.col("page_id"), F.col("response"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


ARCHIVES = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])


def write(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> DataFrame:
    """(archive, records, bytes, data) of (page_id, url, html), written to ``path``, or to a new folder in the shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal held, size
            data = archive(held)
            row = (f"{uuid.uuid4().hex}.warc.zst", len(held), len(data), data)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARCHIVES)], schema=ARCHIVES)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                refers = refers_to.as_py()
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers, refers is not None, date)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield full()
        if held:
            yield full()

    made = resolve(pages, least).mapInArrow(run, "archive string, records long, bytes long, data binary")
    # a few archives a row group, however large they are
    groups = {"compression": "none", "parquet.block.size": str(ARCHIVE_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return stage(made, "archives", path=path, options=groups)


#: Arrow's names of the file systems that Hadoop names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def folder_at(spark: SparkSession, path: str) -> str:
    """A folder's URI as Arrow has it: mounts resolved, on the driver, to what they stand for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(at)
    scheme, _, rest = fs.resolvePath(at).toString().partition(":")
    return f"{SCHEMES.get(scheme, scheme)}:{'//' + rest if scheme == 'file' and not rest.startswith('//') else rest}"


def export(archives: DataFrame, path: str) -> DataFrame:
    """Put archives into files in a folder, by Arrow's file systems (with their own credentials); returns (archive, bytes) when they are there."""
    uri = folder_at(archives.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                with fs.open_output_stream(f"{folder}/{name.as_py()}", compression=None) as out:
                    out.write(data.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64())], names=["archive", "bytes"])

    return stage(archives.select("archive", "data").mapInArrow(run, "archive string, bytes long"), "exported")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The archives of a folder of files, by Spark's reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of (archive, data). A revisit's payload is null; a response's is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for raw in records_of(data.as_py()):
                    h, payload = parse(raw)
                    told, response = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    if response and (digest(payload) != told or len(payload) != int(h["x-payload-length"])):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    refers = page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None
                    rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], refers, told, int(h["x-payload-length"]), payload if response and payloads else None))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)

    return archives.select("archive", "data").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op3(spark, sf_dir: str) -> DataFrame:
    archives = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
