"""SimHash near-duplicates by pigeonring filtering.

Fingerprints are cut into ``segments`` equal segments on a ring. If two differ in
at most ``limit`` bits, there is a segment from which on every chain of
consecutive segments 1, 2, .. long has at most its proportional share of the
differences, length * limit / segments. Chains with a share below 1 are equal:
their bits are the key under which a fingerprint is filed, once for every
starting segment. Fingerprints under one key are compared, chain by chain as
the ring says, and in full only if every chain stays within its budget.

The number of segments follows the number of fingerprints, so that a key's bits (24
for 8 segments, 28 for 16, 31 for 64) leave few fingerprints under one by chance. Keys
that have many all the same (a dense cluster, or a common text's neighbours) are not
compared in pairs, which would grow with the square of a cluster. Each fingerprint in one names itself and each fingerprint
one bit away; two that name the same one differ in at most two bits, and any two
that differ in at most two name one together. Each is linked to the least of
those that share a name: at most 65 links a fingerprint, and the same groups.

Documents meet first by fingerprint, so that copies are one. Links join up by
alternating large-star and small-star steps on staged edge tables; the groups'
representatives never meet on the driver.

Null, empty and blank texts have fingerprint 0 and are linked like any other. A
null doc_id is in its group but never names it; a group without ids has a null
component_id. Rows that repeat are all returned. Texts are hashed whole, however long.
Columns named fp, root and component_id are replaced, others carried. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, keyed_lookup, stage, table

WIDTH, SEED, LIMIT, SEGMENTS = 3, 42, 2, 8
#: Fingerprints under one key that are still compared in pairs.
DENSE = 24
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PIECE = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        part = hashes[i : i + _PIECE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long; the text goes."""
    carried = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            found = np.fromiter((fingerprint(x.as_py(), width, seed) for x in column), np.uint64, len(column))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found.view(np.int64))], names=[*names, "fp"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    return docs.select(*names, F.col(text).cast("string")).mapInArrow(run, f"{schema}fp long")


class Ring:
    """Which bits the chains cover, and how many differences each may have."""

    def __init__(self, limit: int = LIMIT, segments: int = SEGMENTS):
        edges = [64 * i // segments for i in range(segments + 1)]
        masks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
        self.limit, self.segments = limit, segments
        self.exact = max(k for k in range(1, segments + 1) if k * limit < segments)
        #: (bits, budget) of the chains from each start, shortest first
        self.chains = [[(sum(masks[(i + k) % segments] for k in range(n)), n * limit // segments) for n in range(1, segments + 1)] for i in range(segments)]

    def key_bits(self, start: int) -> int:
        return self.chains[start][self.exact - 1][0]

    def within(self, start: int, difference: Column) -> Column:
        """Whether every chain from ``start`` on is within its budget, and so the whole."""
        tests = [F.bit_count(difference.bitwiseAND(F.lit(signed(bits)))) <= budget for bits, budget in self.chains[start][self.exact :]]
        # a longer chain with the same budget says what the shorter ones do
        last = {budget: test for (_, budget), test in zip(self.chains[start][self.exact :], tests)}
        out = None
        for test in last.values():
            out = test if out is None else out & test
        return out


def ring_for(n: int, limit: int = LIMIT, most: int = 4) -> Ring:
    """The ring of fewest segments under whose keys ``n`` fingerprints come ``most`` at a time, by chance."""
    for segments in (8, 16, 32):
        ring = Ring(limit, segments)
        if n >> bin(ring.key_bits(0)).count("1") < most:
            return ring
    return Ring(limit, 64)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(distinct: DataFrame, ring: Ring | None = None, dense: int = DENSE) -> DataFrame:
    """Edges (a, b), a < b, over distinct ``fp`` that join all that differ in at most two bits, and no others."""
    ring = ring or ring_for(distinct.count(), LIMIT)
    if ring.limit != 2:
        raise ValueError("dense keys are joined for a limit of two bits")
    starts = range(ring.segments)
    filed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(ring.key_bits(i)))).alias("key")) for i in starts])).alias("f"))
    filed = stage(filed.select("fp", "f.start", "f.key"), "filed")
    sizes = filed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    place = F.xxhash64("start", "key")
    sized = keyed_lookup(filed.withColumn("place", place), sizes.select(place.alias("place"), "n", F.col("n").alias("crowd")), "place").where("crowd > 1")
    sized = stage(sized.drop("place"), "sized")
    few = sized.where(F.col("crowd") <= dense)
    a, b = few.select(F.col("fp").alias("a"), "start", "key"), few.select(F.col("fp").alias("b"), "start", "key")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.when(F.col("start") == 0, ring.within(0, difference))
    for i in starts[1:]:
        viable = viable.when(F.col("start") == i, ring.within(i, difference))
    pairs = a.join(b, ["start", "key"]).where("a < b").where(viable)
    pairs = pairs.where(F.bit_count(difference) <= ring.limit).select("a", "b")
    # every fingerprint of a crowd names itself and its neighbours by one bit, once
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << n)) for n in range(64)])
    crowd = sized.where(F.col("crowd") > dense).select("fp").distinct()
    named = stage(crowd.select("fp", F.explode(F.transform(flips, lambda n: F.col("fp").bitwiseXOR(n))).alias("name")), "named")
    # names of one fingerprint alone are most; the others link to the least
    least = named.groupBy("name").agg(F.min("fp").alias("a"), F.count("*").alias("n"), F.max("fp").alias("z")).where("a < z")
    crowded = keyed_lookup(named, least.select("name", "a", "n"), "name").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(crowded).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every b has one edge and is no other edge's a."""
    n, distinct = edges.agg(F.count("*"), F.count_distinct("b")).first()
    return n == distinct and edges.join(edges.select(F.col("b").alias("x")), F.col("a") == F.col("x"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node reachable."""
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while not are_stars(edges):
        before = edges
        # large star: every larger neighbour moves to the least of the neighbours
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        moved = stage(keyed_lookup(both, least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        # small star: a node and its smaller neighbours move to the least of them
        least = moved.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        joined = keyed_lookup(moved, least, "b")
        edges = joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))
        edges = stage(edges.distinct(), "small-star")
        for used in (before, moved):
            drop_staged(used)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def grouped(docs: DataFrame, text: str = "text", dense: int = DENSE) -> DataFrame:
    """``fp``, ``root`` (the group's least linked fingerprint) and ``component_id`` (the smallest doc_id in it) for every row; the text goes."""
    prints = stage(fingerprints(docs.drop("component_id", "root"), text), "fingerprints")
    names = prints.columns
    owners = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "owners")
    roots = components(links(owners.select("fp"), dense=dense))
    rooted = owners.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.col("n").alias("copies"), "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    by_fp = keyed_lookup(rooted, named, "root").select("fp", F.col("copies").alias("n"), "root", "component_id")
    return keyed_lookup(prints, stage(by_fp, "named"), "fp").select(*names, "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id, rows without id last; of rows that share it the first by a hash of the text."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = grouped(docs.select("doc_id", hashed.alias("__t"), "text"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__t")).alias("w"))
    first = first.select(F.col("w.doc_id").alias("__i"), F.col("w.__t").alias("__u"))
    place = F.xxhash64("doc_id", "__t")
    kept = docs.withColumn("__t", hashed).withColumn("__p", place)
    first = first.withColumn("__q", F.xxhash64("__i", "__u"))
    out = kept.join(first, (F.col("__p") == F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")))
    # rows alike in id and text: the first stays
    alike = Window.partitionBy("__p", "doc_id", "__t").orderBy(F.lit(0))
    return out.withColumn("__r", F.row_number().over(alike)).where("__r = 1").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
