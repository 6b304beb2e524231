"""Best-fit packing of documents into training sequences.

Best-fit decreasing over all pieces: the longest first, each into the open
sequence with the least room that still holds it, found by descending a segment
tree over the rooms. Pieces of one length are interchangeable, and so are
sequences of one room: the packing works on the histogram of lengths (at most
``capacity`` numbers, whatever the corpus holds) and moves whole runs of pieces
into whole runs of sequences. Its result is a short list of rules: pieces a to b
of a length go to sequences from s on, at offset o. A piece finds its rule by
its rank among the pieces of its length.

Ranks come from counts by (length, bucket), running sums of these, and a count
within each bucket, so that no task sees all pieces of a common length.

Tokenising: very long texts are encoded in parts, cut before a space or line
feed that a character other than white space follows. The tokenizer's pattern
never matches over such a place and doesn't look behind it, so that the parts'
ids are the text's.

Null texts are empty: the end id alone. Each row is a document, repeated or not;
rows that share a doc_id, null ids too, are dealt by their text and place. Texts
are taken whole, whatever their length. An empty table gives an empty result.
Only doc_id and text are read, so that other columns can't clash; ``pack``
replaces columns named sequence_id and offset.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage, table

CAPACITY = 2048
END_ID = 0
ROWS_PER_BUCKET = 20_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it is visible, else the next free one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed value: how a byte-level pre-tokenizer with ``use_regex`` splits a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def id_finder(path: str):
    """(a function from a text to its ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, where long texts may be cut: at these added tokens and ``parts``; None for nowhere).

    A plain byte-level BPE vocabulary whose merges are ordered by the ids they
    make, as usual, has ranks, by which the other public BPE library finds the
    same ids several times faster. Any other one is encoded by its own library.
    Added tokens in a text have their own ids either way; where one holds white
    space or takes some beside it, texts are encoded whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, added, split = held["model"], held.get("added_tokens") or [], held.get("pre_tokenizer") or {}
    simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    byte_level = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
    plain = model.get("type") == "BPE" and held.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not (simple and byte_level and plain) or any(a >= b for a, b in zip(made, made[1:])):
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, names if simple and byte_level else None
    import tiktoken

    byte, known = byte_symbols(), set(made)
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i in known or len(token) == 1}
    special = {n: t["id"] for n in names for t in added if t["content"] == n}
    encoding = tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all"), names


#: Bytes that surely begin a character other than white space: visible ASCII, and lead bytes but those of other white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


def cuts(data: bytes) -> np.ndarray:
    """Where a text may be cut."""
    b = np.frombuffer(data, np.uint8)
    return np.flatnonzero(((b[:-1] == 32) | (b[:-1] == 10)) & _SOLID[b[1:]])


def parts(data: bytes, added: list[str] = [], most: int = 1 << 20) -> Iterator[bytes]:  # noqa: B006  read only
    """A long text in parts that begin at cuts, or at added tokens and behind them."""
    if len(data) <= most:
        yield data
        return
    if added and len(pieces := re.split(b"(" + b"|".join(re.escape(a.encode()) for a in added) + b")", data)) > 1:
        for piece in pieces:
            yield from parts(piece, [], most)
        return
    at, begin = cuts(data), 0
    while begin < len(data):
        i = np.searchsorted(at, begin + most)
        end = int(at[i]) if i < len(at) else len(data)
        yield data[begin:end]
        begin = end


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from UTF-8 text to its ids as little-endian unsigned 32-bit integers, in bytes."""
    ids, added = id_finder(path)
    return lambda data: b"".join(np.array(ids(part.decode()), "<u4").tobytes() for part in ([data] if added is None else parts(data, added)))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32).

    A document longer than ``capacity`` is cut into pieces of it; the first has what is left over.
    """
    path = path or vocabulary_path()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode((text.as_py() or "").encode()) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                start, length, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
                    start, length, piece = start + length, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PIECES)], schema=PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut_up, "doc_id long, piece int, start long, length int, ids_crc32 long")


class Rooms:
    """Runs of sequences by their room, with a segment tree that finds the least room of a size or more."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, on: bool) -> None:
        i = room + self.leaves
        self.tree[i] = on
        while i > 1:
            i //= 2
            on = self.tree[2 * i] or self.tree[2 * i + 1]
            if self.tree[i] == on:
                break
            self.tree[i] = on

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            if len(self.runs[room]) == 1:
                self._mark(room, True)

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` sequences of the least room that holds ``size``: (room, first, n)."""
        i = size + self.leaves
        if not self.tree[i]:
            while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        first, n = self.runs[room].pop()
        if n > most:
            self.runs[room].append((first + most, n - most))
            n = most
        if not self.runs[room]:
            self._mark(room, False)
        return room, first, n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts of lengths: rules (length, rank, sequence, offset, per).

    From ``rank`` on, pieces of ``length`` go to sequences from ``sequence`` on,
    ``per`` one after another into each from ``offset`` on.
    """
    rooms, rules, next_sequence = Rooms(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            # what a sequence holds of this length is its best fit until it is full
            found = rooms.take(length, left)
            if found is None:
                room, first, n = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += n
            else:
                room, first, n = found
            per = room // length
            if n * per > left:  # the last sequence gets fewer
                full, some = divmod(left, per)
                if full:
                    rules.append((length, rank, first, capacity - room, per))
                    rooms.add(room - per * length, first, full)
                    rank += full * per
                if some:
                    rules.append((length, rank, first + full, capacity - room, some))
                    rooms.add(room - some * length, first + full, 1)
                    rank += some
                rest = n - full - bool(some)
                if rest:
                    rooms.add(room, first + full + bool(some), rest)
                left = 0
            else:
                rules.append((length, rank, first, capacity - room, per))
                rooms.add(room - per * length, first, n)
                rank, left = rank + n * per, left - n * per
    return rules


def ranked(pieces_: DataFrame) -> DataFrame:
    """Adds ``rank``, a number from 0 among the pieces of each length."""
    names = pieces_.columns
    n = pieces_.count()
    # by more than the id, so that rows that share one spread as others do
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-n // ROWS_PER_BUCKET)))).cast("int")
    rows = pieces_.withColumn("__bucket", bucket)
    counts = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rows = rows.join(counts, ["length", "__bucket"])
    inside = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return rows.select(*names, (F.col("__base") + F.row_number().over(inside) - 1).alias("rank"))


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged pieces."""
    rules = plan({r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    rules.sort()
    table_ = np.array(rules, np.int64).reshape(-1, 5)
    keys, sequence, offset, per, from_rank = (table_[:, 0] << 44) + table_[:, 1], table_[:, 2], table_[:, 3], table_[:, 4], table_[:, 1]
    fields = [f for f in pieces_.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            k = rank - from_rank[i]
            placed = [pa.array(sequence[i] + k // per[i]), pa.array(offset[i] + k % per[i] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *placed], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked(pieces_.select(*names)).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stage(token_pieces(docs, path, capacity), "pieces"), capacity)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
