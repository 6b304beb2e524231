"""Contents by hash: deduplicated writes, chunk manifests, range reads, erasure.

Blobs are rows (content_hash, content); a chunked object has its chunks as blobs
and a manifest instead of one. Chunks keep any one cell small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing

CHUNK = 8 << 20


def hashed(contents: DataFrame, content: str = "content") -> DataFrame:
    return contents.withColumn("content_hash", hashing.content_hash(content)).withColumn("size_bytes", F.octet_length(content).cast("long"))


def new_blobs(contents: DataFrame, blocks: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(content_hash, content, size_bytes): each hash once, without those that ``blocks`` has."""
    rows = hashed(contents, content).select("content_hash", F.col(content).alias("content"), "size_bytes")
    once = rows.dropDuplicates(["content_hash"])
    return once if blocks is None else once.join(blocks.select("content_hash"), "content_hash", "left_anti")


def manifest(contents: DataFrame, chunk_size: int = CHUNK, content: str = "content") -> DataFrame:
    """(content_hash, total_size, chunk_size, pos, begin, end, chunk_hash) of the objects longer than a chunk."""
    rows = hashed(contents, content).withColumn("c", F.explode(hashing.chunks(content, chunk_size)))
    return rows.select("content_hash", F.col("size_bytes").alias("total_size"), F.lit(chunk_size).cast("long").alias("chunk_size"), "c.pos", "c.begin", "c.end", "c.chunk_hash")


def chunk_blobs(contents: DataFrame, chunk_size: int = CHUNK, content: str = "content") -> DataFrame:
    """(content_hash, content) of the chunks of objects longer than one, each hash once."""
    rows = contents.select(F.col(content).alias("content"))
    rows = rows.withColumn("c", F.explode(hashing.chunks("content", chunk_size)))
    piece = F.substring("content", F.col("c.begin").cast("int") + 1, (F.col("c.end") - F.col("c.begin")).cast("int"))
    return rows.select(F.col("c.chunk_hash").alias("content_hash"), piece.alias("content")).dropDuplicates(["content_hash"])


def read_range(contents: DataFrame, offset: int, length: int = -1, content: str = "content") -> DataFrame:
    """Adds ``slice``, the bytes from ``offset`` on."""
    return contents.withColumn("slice", hashing.byte_range(content, offset, length))


def read_chunked(manifest_: DataFrame, blocks: DataFrame, offset: int, length: int = -1) -> DataFrame:
    """(content_hash, slice) from the chunks that overlap the range, in order; an empty range has no rows' bytes."""
    begin = F.lit(max(0, offset)).cast("long")
    end = F.col("total_size") if length < 0 else F.least(F.col("total_size"), begin + length)
    need = manifest_.withColumn("from", begin).withColumn("to", end).where("begin < to and end > from")
    parts = need.join(blocks.select(F.col("content_hash").alias("chunk_hash"), "content"), "chunk_hash")
    at = F.greatest(F.col("from") - F.col("begin"), F.lit(0))
    piece = F.substring("content", at.cast("int") + 1, (F.least("to", "end") - F.col("begin") - at).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.hex(piece).alias("x"))))
    return parts.groupBy("content_hash").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["x"]), "")).alias("slice"))


def exists(blocks: DataFrame, hashes: DataFrame) -> DataFrame:
    """(content_hash, present) of each hash asked."""
    there = blocks.select("content_hash", F.lit(True).alias("present")).distinct()
    return hashes.select("content_hash").distinct().join(there, "content_hash", "left").select("content_hash", F.coalesce("present", F.lit(False)).alias("present"))


def erase(entries: DataFrame, blocks: DataFrame, manifests: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, blocks and manifests without these objects; blocks that others use, whole or as a chunk, stay."""
    gone = hashes.select("content_hash")
    left = manifests.join(gone, "content_hash", "left_anti")
    kept = entries.join(gone, "content_hash", "left_anti")
    theirs = gone.unionByName(manifests.join(gone, "content_hash", "left_semi").select(F.col("chunk_hash").alias("content_hash"))).distinct()
    # an erased object's bytes may be a chunk of another, and its chunk another's whole content
    used = left.select(F.col("chunk_hash").alias("content_hash")).unionByName(kept.select("content_hash"))
    unused = theirs.join(used, "content_hash", "left_anti")
    return kept.select(*entries.columns), blocks.join(unused, "content_hash", "left_anti"), left
