"""Substring deduplication with a log-structured index of window fingerprints.

A window is ``width`` consecutive words of one document. Words covered by a
window that also starts in an earlier document are removed; windows are judged on
the input. Documents come in the order of their ids within one call of
``SubstringIndex.add``, and all of it after those of earlier calls, whatever
their ids.

Documents are cut into chunks, in that order. Batches of chunks enter the index
one after another, for one shard of the fingerprints after another:

1. every chunk of the batch gives a sorted run of its windows' fingerprints in
   the shard, split into buckets by a second, independent hash;
2. within each bucket, the sorted runs of the index and of the new chunks are
   merge-joined. A fingerprint's first chunk owns it; the other new chunks are
   told the fingerprints that are not theirs, and the owner;
3. the merged runs of the batch are one new immutable run of the shard, and
   when it has more than ``fan_in`` runs, they are compacted into one.

Each chunk then removes what it was told and what its own earlier documents
have. Every removed passage is a claim on its owner and is verified word by word
against the owner's text. One claim that fails (two windows with equal hashes)
makes the index enter all its chunks again with another salt, so that results are
exact. Bits and buckets follow from the number of windows, and an index that
outgrows them enters its chunks again with more.

An index is a folder: its chunks, its runs, and a small state that names them,
written after each call; ``SubstringIndex.open`` goes on from there.

Runs are byte planes of gaps between sorted numbers, 5 to 8 bytes a window, and
the window that a third of all documents share is one entry a chunk. A chunk gives
at most ``FAN`` rows: beyond so many buckets, ranges of buckets are split in a
second step, many chunks' windows together. Text moves as compressed chunks. No
task holds more than a bucket, a part of a range or a chunk.

Rows without doc_id neither remove nor lose anything, and are spread over all
chunks; rows that share a doc_id don't remove each other's words: from a chunk's
size on they have chunks of their own, of one group (one task reads them, as a
stream). Null texts have no words and stay null. Texts are read whole; a chunk
holds one document at least, however long. Extra columns are carried; those named
like results are replaced. Empty tables give empty results, and index nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textvec
from tessera.llm.common import BLANKS, delete, drop_staged, keyed_lookup, list_folder, scratch, stage, table

WIDTH = 13
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
WINDOWS_PER_BUCKET = 1 << 20
#: Slices of the fingerprints that are entered one after another: what moves at once is one of them.
SHARDS = 4
#: Rows that a chunk gives at most, and windows that are split together beyond so many buckets.
FAN, SPLIT_WINDOWS = 4096, 1 << 22
CLAIMS_PER_PART = 20_000
#: Batches a call, and runs a shard from which on they are compacted.
BATCHES, FAN_IN = 5, 3
SALTS = 8
#: Where a chunk's number has its group's, and its partition's.
PART_BITS, GROUP_BITS = 20, 40
RESULTS = ("n_words", "n_removed", "kept_text", "claims")


def packed(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


@dataclass(frozen=True)
class Layout:
    """What fingerprints are: ``bits`` of one hash, in one of ``buckets`` by another."""

    width: int = WIDTH
    buckets: int = 1
    bits: int = 64
    salt: int = 1

    @classmethod
    def of(cls, windows: int, width: int, windows_per_bucket: int) -> Layout:
        """So many bits that a false match among as many windows has a chance of 1 in 32, or all 64."""
        buckets = max(1, -(-windows // windows_per_bucket))
        bits = 2 * math.log2(max(2, windows)) + 4 - math.log2(buckets)
        return cls(width, buckets, min(64, max(16, math.ceil(bits))))

    def all_bits(self) -> float:
        return self.bits + math.log2(self.buckets)

    def shard(self, k: int) -> tuple[int, int]:
        return self.buckets * k // SHARDS, self.buckets * (k + 1) // SHARDS


class Chunk:
    """The windows of a chunk's documents, those in buckets from ``low`` to before ``high``."""

    def __init__(self, payload: bytes, layout: Layout, low: int = 0, high: int | None = None):
        width, buckets = layout.width, layout.buckets
        self.rows = unpacked(payload)
        self.texts = [t or b"" for t in self.rows.column("text").cast(pa.binary()).to_pylist()]
        ids = self.rows.column("doc_id").to_pylist()
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.buffer = np.frombuffer(b"\n".join(self.texts), np.uint8)
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.starts, self.ends = textvec.spans(self.buffer)
        words = textvec.span_hashes(self.buffer, self.starts, self.ends)
        self.doc = np.searchsorted(self.begins, self.starts, "right") - 1
        second = textvec.window_hashes(words, width, 2 * layout.salt + 1)
        n = len(second)
        inside = (self.doc[:n] == self.doc[width - 1 :]) if n else np.empty(0, bool)
        if n and None in ids:
            inside &= np.array([i is not None for i in ids])[self.doc[:n]]
        bucket = _scaled(second, buckets)
        if high is not None and high - low < buckets:
            inside &= (bucket >= low) & (bucket < high)
        self.at = np.flatnonzero(inside)
        self.print = textvec.window_hashes(words, width, 2 * layout.salt)[self.at] >> np.uint64(64 - layout.bits)
        self.bucket = bucket[self.at].astype(np.uint16 if buckets <= 65536 else np.uint32)
        # by bucket, then fingerprint, then place; places follow the order of ids
        order = np.argsort(self.print, kind="stable")
        self.order = order[np.argsort(self.bucket[order], kind="stable")]
        b, p = self.bucket[self.order], self.print[self.order]
        self.new = np.ones(len(b), bool)
        self.new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])

    def runs(self, chunk: int, low: int, per: int) -> Iterator[tuple]:
        """Entries of the distinct fingerprints in order: one a bucket, or one a range of ``per`` buckets from ``low`` on."""
        kept = self.order[self.new]
        b, p = self.bucket[kept], self.print[kept]
        if per == 1:
            for lo, hi in stretches(b):
                yield CHUNK_RUN, int(b[lo]), chunk, sorted_bytes(p[lo:hi]), None, None
        else:
            group = (b.astype(np.int64) - low) // per
            for lo, hi in stretches(group):
                inner = b[lo:hi].astype(np.uint64) - np.uint64(low + int(group[lo]) * per)
                yield RANGE, int(group[lo]), chunk, textvec.varint(p[lo:hi]), None, sorted_bytes(inner)

    def passage(self, first: int, n_words: int) -> bytes:
        """The words from a word on, one space apart."""
        return b" ".join(self.buffer[self.starts[first] : self.ends[first + n_words - 1]].tobytes().split())


def _scaled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes as numbers below ``n``, all as likely."""
    return (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def stretches(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    if not len(sorted_):
        return []
    edges = [0, *(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(sorted_)]
    return list(zip(edges, edges[1:]))


def sorted_bytes(numbers: np.ndarray) -> bytes:
    return textvec.varint(np.diff(numbers, prepend=np.uint64(0)))


def sorted_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(textvec.unvarint(data), dtype=np.uint64)


def cut_into_chunks(docs: DataFrame, width: int, chunk_bytes: int, base: int = 0) -> DataFrame:
    """(chunk, n_windows, payload): chunk numbers follow the doc_ids.

    A number is (base + partition, group, part). A chunk is a group of its own, but
    for rows of one id that don't fit a chunk: their chunks are parts of one group.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, group, part = base + TaskContext.get().partitionId() << GROUP_BITS, 0, 0
        # rows of ids that are complete, and of the current id
        held, held_bytes, held_rows, mine, mine_bytes, mine_rows = [], 0, 0, [], 0, 0

        def made(slices: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk = pa.Table.from_batches(slices)
            words = sum(max(0, len(t.split()) - width + 1) for t in chunk.column("text").cast(pa.binary()).to_pylist() if t)
            at = number | group << PART_BITS | part
            return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "n_windows": pa.array([words], pa.int64()), "payload": pa.array([packed(chunk)], pa.binary())})

        last, first = None, True
        for batch in batches:
            batch = batch.select(names)
            ids = batch.column("doc_id").to_pylist()
            sizes = [len(t) if t else 0 for t in batch.column("text").cast(pa.binary()).to_pylist()]
            begin = 0
            for i, (doc_id, n) in enumerate(zip(ids, sizes)):
                same = not first and doc_id is not None and doc_id == last
                if not same or held_bytes + mine_bytes >= chunk_bytes or held_rows + mine_rows >= CHUNK_ROWS:
                    if i > begin:
                        mine.append(batch.slice(begin, i - begin))
                    begin = i
                if not same:
                    if part and mine:  # the last part of an id's group
                        yield made(mine)
                        mine = []
                    if part:
                        group, part, mine_bytes, mine_rows = group + 1, 0, 0, 0
                    held, held_bytes, held_rows = held + mine, held_bytes + mine_bytes, held_rows + mine_rows
                    mine, mine_bytes, mine_rows = [], 0, 0
                    if held and (held_bytes >= chunk_bytes or held_rows >= CHUNK_ROWS):
                        yield made(held)
                        group, held, held_bytes, held_rows = group + 1, [], 0, 0
                elif held_bytes + mine_bytes >= chunk_bytes or held_rows + mine_rows >= CHUNK_ROWS:
                    if held:
                        yield made(held)
                        group, held, held_bytes, held_rows = group + 1, [], 0, 0
                    if mine_bytes >= chunk_bytes or mine_rows >= CHUNK_ROWS:
                        yield made(mine)
                        part, mine, mine_bytes, mine_rows = part + 1, [], 0, 0
                mine_bytes, mine_rows, last, first = mine_bytes + n, mine_rows + 1, doc_id, False
            if len(ids) > begin:
                mine.append(batch.slice(begin))
        if part and mine:
            yield made(mine)
        elif held + mine:
            yield made(held + mine)

    # rows without id go anywhere
    spread = docs.withColumn("__at", F.coalesce("doc_id", F.xxhash64(F.monotonically_increasing_id())))
    ranged = spread.repartitionByRange("__at").sortWithinPartitions("__at")
    return ranged.mapInArrow(cut, "chunk long, n_windows long, payload binary")


ENTRY = "kind int, bucket int, chunk long, prints binary, owners binary, inner binary"
ENTRIES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("prints", pa.binary()), ("owners", pa.binary()), ("inner", pa.binary())])
RUN, CHUNK_RUN, TOLD, RANGE = 0, 1, 2, 3


def entries(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(ENTRIES), ENTRIES)], schema=ENTRIES)


def windows_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, owner, whether it is new, place in its range of buckets) of all entries of a group, those of the index first, then in the order of chunks."""
    p, o, new, inner = [], [], [], []
    rows = zip(*(group.column(n).to_pylist() for n in ("kind", "chunk", "prints", "owners", "inner")))
    for kind, chunk, prints, owners, places in sorted(rows, key=lambda r: (r[0], r[1] or 0)):
        p.append(textvec.unvarint(prints) if kind == RANGE else sorted_numbers(prints))
        o.append(np.full(len(p[-1]), chunk, np.int64) if owners is None else textvec.unvarint(owners).astype(np.int64))
        new.append(np.full(len(p[-1]), kind != RUN))
        inner.append(sorted_numbers(places) if kind == RANGE else np.zeros(len(p[-1]), np.uint64))
    return tuple(np.concatenate(x) for x in (p, o, new, inner))


def split(low: int, per: int):
    """Many chunks' entries of one range of buckets as entries of its buckets."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        p, o, _, inner = windows_of(group)
        order = np.lexsort((o, p, inner))
        p, o, inner = p[order], o[order], inner[order]
        first = low + key[0].as_py() * per
        return entries([(CHUNK_RUN, first + int(inner[a]), None, sorted_bytes(p[a:z]), textvec.varint(o[a:z].astype(np.uint64)), None) for a, z in stretches(inner)])

    return run


def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The sorted runs of one bucket: what new chunks are told, and the bucket of the new run."""
    bucket = key[0].as_py()
    p, o, asks, _ = windows_of(group)
    # the first chunk comes first; those of the index are earlier than all new ones. Runs of one
    # chunk each are in order already
    mixed = pc.any(pc.and_(pc.equal(group.column("kind"), CHUNK_RUN), pc.is_valid(group.column("owners")))).as_py()
    order = np.lexsort((o, p)) if mixed else np.argsort(p, kind="stable")
    p, o, asks = p[order], o[order], asks[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    owner = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = []
    # parts of one group aren't told of each other
    told = np.flatnonzero(asks & (owner >> PART_BITS != o >> PART_BITS))
    told = told[np.argsort(o[told], kind="stable")]
    for a, z in stretches(o[told]):
        these = told[a:z]
        out.append((TOLD, bucket, int(o[these[0]]), sorted_bytes(p[these]), textvec.varint(owner[these].astype(np.uint64)), None))
    added = new & asks
    if added.any():
        out.append((RUN, bucket, None, sorted_bytes(p[added]), textvec.varint(o[added].astype(np.uint64)), None))
    return entries(out)


def compacted(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Several runs of one bucket as one; their fingerprints differ, as each run has only what was new."""
    p, o, _, _ = windows_of(group)
    order = np.argsort(p, kind="stable")
    return entries([(RUN, key[0].as_py(), None, sorted_bytes(p[order]), textvec.varint(o[order].astype(np.uint64)), None)])


class SubstringIndex:
    """Immutable sorted runs of the windows of all documents so far, with their texts, in one folder."""

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, batches: int = BATCHES, chunk_bytes: int = CHUNK_BYTES, windows_per_bucket: int = WINDOWS_PER_BUCKET, fan_in: int = FAN_IN):
        self.spark, self.path = spark, path
        self.options = {"width": width, "batches": batches, "chunk_bytes": chunk_bytes, "windows_per_bucket": windows_per_bucket, "fan_in": fan_in}
        self.layout = Layout(width)
        self.runs: list[list[str]] = [[] for _ in range(SHARDS)]  # of each shard, the earliest first
        self.chunks: list[str] = []
        self.windows = self.partitions = self.states = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SubstringIndex:
        """The index in a folder, as its last complete call left it; a new one, with ``options``, where there is none."""
        states = [f for f in list_folder(spark, path) if f.rsplit("/", 1)[-1].startswith("state-")]
        if not states:
            return cls(spark, path, **options)
        state = json.loads(spark.read.text(max(states)).first()[0])
        out = cls(spark, path, **state["options"])
        out.layout, out.runs, out.chunks = Layout(**state["layout"]), state["runs"], state["chunks"]
        out.windows, out.partitions, out.states = state["windows"], state["partitions"], state["states"]
        return out

    def save(self) -> None:
        """Name what the index holds; the files that it no longer does can go then."""
        self.states += 1
        state = {"options": self.options, "layout": asdict(self.layout), "runs": self.runs, "chunks": self.chunks, "windows": self.windows, "partitions": self.partitions, "states": self.states}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/state-{self.states:09d}")
        named = {*self.chunks, *(r for rs in self.runs for r in rs), f"{self.path}/state-{self.states:09d}"}
        for f in list_folder(self.spark, self.path):
            if f.rsplit("/", 1)[-1] not in {n.rsplit("/", 1)[-1] for n in named}:
                delete(self.spark, f)

    def written(self, df: DataFrame, label: str, **options) -> str:
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        stage(df, label, path=path, **options)
        return path

    def entries_in(self, paths: list[str], kind: int) -> DataFrame:
        there = [f for p in paths for f in list_folder(self.spark, p) if f.endswith(f"/kind={kind}")]
        if not there:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY.removeprefix("kind int, ")).parquet(*there)
        return rows.select(F.lit(kind).alias("kind"), "*")

    def chunks_in(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("chunk long, n_windows long, payload binary").parquet(*paths)

    def prints(self, chunks: DataFrame, low: int, high: int, windows: int) -> DataFrame:
        """Entries, by bucket, of the chunks' windows in buckets from low to before high."""
        layout, per = self.layout, -(-(high - low) // FAN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, payload in zip(*(batch.column(n).to_pylist() for n in ("chunk", "payload"))):
                    yield from entries(list(Chunk(payload, layout, low, high).runs(chunk, low, per))).to_batches()

        out = chunks.select("chunk", "payload").mapInArrow(run, ENTRY)
        if per == 1:
            return out
        # as many chunks' windows of a range together as give its buckets entries of some length
        share = windows * per / layout.buckets
        part = F.pmod(F.xxhash64("chunk"), F.lit(max(1, round(share / SPLIT_WINDOWS)))).cast("int")
        return out.groupBy(F.col("bucket").alias("range"), part.alias("part")).applyInArrow(split(low, per), ENTRY)

    def enter(self, chunks: DataFrame, windows: int, batches: int) -> list[str]:
        """Merge later chunks into the shards' runs, batch by batch; returns where what they were told is."""
        ends = [i / batches for i in range(1, batches)]
        edges = sorted({int(e) for e in chunks.approxQuantile("chunk", ends, 0.001)}) if ends and windows else []
        told = []
        for k in range(SHARDS):
            low, high = self.layout.shard(k)
            if low == high or not windows:
                continue
            for a, b in zip([None, *edges], [*edges, None]):
                part = chunks if a is None else chunks.where(F.col("chunk") > a)
                part = part if b is None else part.where(F.col("chunk") <= b)
                rows = self.prints(part, low, high, windows // (len(edges) + 1))
                if self.runs[k]:
                    rows = rows.unionByName(self.entries_in(self.runs[k], RUN))
                found = self.written(rows.groupBy("bucket").applyInArrow(merge, ENTRY), "merged", partition_by=["kind"])
                told.append(found)
                self.runs[k].append(found)
                if len(self.runs[k]) > self.options["fan_in"]:
                    self.compact(k)
        return told

    def compact(self, shard: int | None = None) -> None:
        """Replace the runs of a shard, or of each, by one."""
        for k in range(SHARDS) if shard is None else [shard]:
            if len(self.runs[k]) > 1:
                rows = self.entries_in(self.runs[k], RUN).groupBy("bucket").applyInArrow(compacted, ENTRY)
                one = self.written(rows, "run", partition_by=["kind"])
                self.forget(self.runs[k])
                self.runs[k] = [one]

    def forget(self, runs: list[str]) -> None:
        """Delete runs; what was told with them stays until it is applied."""
        for r in runs:
            delete(self.spark, f"{r}/kind={RUN}")

    def clear(self) -> None:
        for r in self.runs:
            self.forget(r)
        self.runs = [[] for _ in range(SHARDS)]

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """``docs`` with n_words, n_removed and kept_text, the text without its removed words; they are in the index then.

        ``keep=False`` is for an index that nothing will be added to: its files go as soon as they have been read.
        """
        carried = [f for f in docs.schema.fields if f.name not in RESULTS and f.name != "text"]
        fields = [*carried, T.StructField("text", T.StringType())]
        rows = docs.select(*[f.name for f in carried], F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
        names = [f.name for f in fields]
        schema = ", ".join(f"`{f.name}` {'long' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in fields)
        width, batches = self.options["width"], self.options["batches"]
        path = self.written(cut_into_chunks(rows, width, self.options["chunk_bytes"], self.partitions), "chunks")
        chunks = self.chunks_in([path])
        windows, top = chunks.agg(F.coalesce(F.sum("n_windows"), F.lit(0)), F.coalesce(F.max(F.shiftright("chunk", GROUP_BITS)), F.lit(self.partitions))).first()
        before, self.windows, self.partitions = self.windows, self.windows + windows, top + 1
        held = self.chunks_in([*self.chunks, path])
        wanted = Layout.of(self.windows, width, self.options["windows_per_bucket"])
        again = not before or wanted.buckets > 4 * self.layout.buckets or wanted.all_bits() > self.layout.all_bits() + 2
        if again:
            self.layout = replace(wanted, salt=self.layout.salt)
        for _ in range(SALTS):
            if again:
                self.clear()
                if before:
                    self.forget_told(self.enter(self.chunks_in(self.chunks), before, batches))
            told = self.enter(chunks, windows, batches)
            if not keep:
                self.clear()
            result = stage(applied(chunks, self.entries_in(told, TOLD), names, schema, self.layout), "deduped")
            self.forget_told(told)
            if all_hold(result, held, self.layout):
                self.chunks.append(path)
                if keep:
                    self.save()
                else:
                    delete(self.spark, self.path)
                return result.drop("claims")
            drop_staged(result)
            self.layout, again = replace(self.layout, salt=self.layout.salt + 1), True
        raise AssertionError(f"{SALTS} salts gave false matches: more bits are needed")

    def forget_told(self, told: list[str]) -> None:
        for t in told:
            delete(self.spark, f"{t}/kind={TOLD}")


def applied(chunks: DataFrame, told: DataFrame, names: list[str], schema: str, layout: Layout) -> DataFrame:
    """Every row with n_words, n_removed, kept_text and its claims, the passages it lost."""
    width = layout.width

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("payload")[0].as_py(), layout)
        own = left.column("chunk")[0].as_py()
        # owner of each window: a chunk, or this one's place of the first such window
        owner = np.full(len(c.at), -1, np.int64)
        in_order, asked = c.bucket[c.order], right.column("bucket").to_numpy()
        lows, highs = (np.searchsorted(in_order, asked.astype(in_order.dtype), side) for side in ("left", "right"))
        for lo, hi, prints, owners in zip(lows, highs, right.column("prints").to_pylist(), right.column("owners").to_pylist()):
            mine = c.order[lo:hi]
            p, o = sorted_numbers(prints), textvec.unvarint(owners).astype(np.int64)
            k = np.minimum(np.searchsorted(p, c.print[mine]), len(p) - 1)
            hit = p[k] == c.print[mine]
            owner[mine[hit]] = o[k[hit]]
        first = np.empty(len(c.at), np.int64)
        if len(c.at):
            first[c.order] = c.order[np.flatnonzero(c.new)[np.cumsum(c.new) - 1]]
        far = owner >= 0
        ids = c.ids[c.doc[c.at]]
        near = ~far & (ids[first] < ids) if len(c.at) else far
        gone = np.flatnonzero(far | near)
        # removed words
        change = np.zeros(len(c.starts) + 1, np.int64)
        np.add.at(change, c.at[gone], 1)
        np.add.at(change, c.at[gone] + width, -1)
        removed = np.cumsum(change[:-1]) > 0
        # passages: windows in a row with one owner, places in a row if it is this chunk
        claims: dict[int, list] = {}
        if len(gone):
            place = c.at[gone]
            mark = np.where(far[gone], owner[gone], -1)
            shift = np.where(far[gone], 0, c.at[first[gone]] - place)
            edge = np.ones(len(gone), bool)
            edge[1:] = (np.diff(place) != 1) | (np.diff(mark) != 0) | (np.diff(shift) != 0) | (np.diff(c.doc[place]) != 0)
            lows = np.flatnonzero(edge)
            for lo, hi in zip(lows.tolist(), [*lows[1:].tolist(), len(gone)]):
                n = hi - lo + width - 1
                passage = c.passage(int(place[lo]), n)
                if mark[lo] >= 0:
                    claims.setdefault(int(c.doc[place[lo]]), []).append({"owner": int(mark[lo]), "passage": passage.decode()})
                elif c.passage(int(c.at[first[gone[lo]]]), n) != passage:  # not the same words: fails at once
                    claims.setdefault(int(c.doc[place[lo]]), []).append({"owner": own, "passage": None})
        n_docs = len(c.texts)
        n_words = np.bincount(c.doc, minlength=n_docs)
        n_removed = np.bincount(c.doc[removed], minlength=n_docs)
        kept = c.rows.column("text").to_pylist()
        low, high = np.searchsorted(c.doc, np.arange(n_docs)), np.searchsorted(c.doc, np.arange(n_docs), "right")
        for d in np.flatnonzero(n_removed).tolist():
            # from the start of a removed word to that of the next kept one
            out = removed[low[d] : high[d]]
            starts = c.starts[low[d] : high[d]] - c.begins[d]
            turns = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
            text, parts, at = c.texts[d], [], 0
            for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
                parts.append(text[at : starts[a]])
                at = int(starts[b]) if b < len(starts) else len(text)
            parts.append(text[at:])
            kept[d] = b"".join(parts).decode()
        extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array([claims.get(d) for d in range(n_docs)], pa.list_(pa.struct([("owner", pa.int64()), ("passage", pa.string())])))]
        columns = [c.rows.column(n).combine_chunks() for n in names]
        return pa.Table.from_arrays([*columns, *extra], names=[*names, *RESULTS])

    out = f"{schema}, n_words long, n_removed long, kept_text string, claims array<struct<owner: long, passage: string>>"
    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, out)


def all_hold(result: DataFrame, chunks: DataFrame, layout: Layout) -> bool:
    """Whether the owner's words bear out every claim."""
    claims = stage(result.select(F.explode("claims").alias("c")).select("c.owner", "c.passage").distinct(), "claims")
    # many claims on one chunk are shared out among copies of it
    counts = stage(claims.groupBy("owner").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CLAIMS_PER_PART).cast("int").alias("parts")), "claim-counts")
    dealt = keyed_lookup(claims, counts, "owner").withColumn("part", F.pmod(F.xxhash64("passage"), F.col("parts")).cast("int"))
    copies = chunks.select("chunk", "payload").join(counts.select(F.col("owner").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "chunk")
    width, salt, bits = layout.width, layout.salt, layout.bits

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        failed: list = []
        if left.num_rows and right.num_rows:
            c = Chunk(left.column("payload")[0].as_py(), replace(layout, buckets=1))
            order = np.argsort(c.print, kind="stable")
            prints = c.print[order]
            joined, offsets = {}, {}

            def places(passage: bytes, i: int, n: int) -> bool:
                """Whether n words of the passage from word i on stand in the chunk as they are."""
                w = words[i : i + n]
                p = mine[i]
                k = int(np.searchsorted(prints, p))
                want = b" ".join(w)
                while k < len(prints) and prints[k] == p:
                    at = int(c.at[order[k]])
                    d = int(c.doc[at])
                    if d not in joined:
                        lo, hi = np.searchsorted(c.doc, [d, d + 1])
                        joined[d] = b" ".join(c.texts[d].split()) + b" "
                        offsets[d] = (int(lo), np.concatenate(([0], np.cumsum(c.ends[lo:hi] - c.starts[lo:hi] + 1))))
                    lo, off = offsets[d]
                    begin = int(off[at - lo])
                    if joined[d][begin : begin + len(want) + 1] == want + b" ":
                        return True
                    k += 1
                return False

            for passage in right.column("passage").to_pylist():
                if passage is None:
                    failed.append(passage)
                    continue
                raw = passage.encode()
                words = raw.split()
                buffer = np.frombuffer(raw, np.uint8)
                hashes = textvec.span_hashes(buffer, *textvec.spans(buffer))
                mine = textvec.window_hashes(hashes, width, 2 * salt) >> np.uint64(64 - bits)
                if not places(raw, 0, len(words)) and not all(places(raw, i, width) for i in range(len(words) - width + 1)):
                    failed.append(passage)
        return pa.table({"passage": pa.array(failed, pa.string())})

    asked = dealt.select(F.col("owner").alias("chunk"), "part", "passage")
    failed = copies.groupBy("chunk", "part").cogroup(asked.groupBy("chunk", "part")).applyInArrow(check, "passage string")
    held = failed.isEmpty()
    for used in (claims, counts):
        drop_staged(used)
    return held


def dedup(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """``SubstringIndex.add`` with an index that goes afterwards."""
    spark = docs.sparkSession
    return SubstringIndex(spark, scratch(spark, "substrings"), width, **options).add(docs, keep=False)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.array_remove(F.split(F.coalesce("kept_text", F.lit("")), BLANKS), ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
