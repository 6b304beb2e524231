"""Exact top-k inner products over norm-sorted vectors.

Vectors are rotated by the right singular vectors of the table (from its Gram
matrix, width squared numbers, a sum over the partitions), so that their first
coordinates carry most of any inner product. Candidates are sorted by descending
length over the whole table and cut into slices, each of which has a longest vector:

* a first pass over the ``head`` longest vectors gives every query a floor, what its
  k-th best is at least;
* a query is sent to the slices whose longest vector times its own length reaches
  its floor, which are the first ones; no others get a copy of it. Queries that
  reach as many slices go in groups, and a slice is copied to the groups that
  reach it;
* in a slice, a block of queries goes on block by block of vectors, until |q| |x| of
  the longest is below the k-th best so far, for every query of the block;
* within a block, the inner product of the first rotated coordinates plus the
  Cauchy-Schwarz bound |q rest| |x rest| prunes what can't reach the k-th best;
* what is left is computed exactly, in whole numbers.

Bounds are compared with a margin above rounding errors, and only strictly smaller
scores are pruned, so that ties are all seen. A task holds one slice and one group
of queries; every slice gives a query at most k, which meet for the last sort. Where
squared lengths stay below 2 ** 52, doubles hold inner products exactly; else they
are computed in longs, and one beyond a long is an error.

Components are quantised first, floor(64 x); one of 2 ** 62 or more then is an error.
Vectors that are null, or hold a null or a number that isn't finite, take no part,
nor do rows without id; rows alike in id and vector count once. Shorter vectors are
taken as padded by zeros. A query's own row is any with its id. Extra columns are not
read. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage, table

K = 20
SCALE = 64
HEAD = 4096
SLICE_ROWS = 1 << 14
GROUP_ROWS = 4096
QUERY_BLOCK = 256
BLOCK = 1024
LEAD = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm2): whole components, for the vectors that take part."""

    def whole(c):
        x = c.cast("double") * scale
        return F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v")).distinct()
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """Lists as the rows of a matrix, padded by zeros."""
    offsets = column.offsets.to_numpy()
    lengths, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out = np.zeros((len(lengths), width), dtype)
    if len(flat):
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of the table, greatest singular value first."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = vectors.select("v").mapInArrow(gram, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    total = np.zeros((width, width))
    for r in sums:
        total[r["i"], r["j"]] = r["g"]
    values, vectors_ = np.linalg.eigh(total)
    return vectors_[:, np.argsort(-values)]


class Slice:
    """Candidates by descending length, as they are and rotated; ``whole`` says whether doubles are exact."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, width: int, turn: np.ndarray, lead: int, whole: bool):
        rows = matrix(vectors, width)
        order = np.lexsort((ids, -(rows * rows).sum(1)))
        self.ids, self.rows = ids[order], rows[order]
        self.exact = self.rows if whole else matrix(vectors, width, np.int64)[order]
        turned = self.rows @ turn
        self.lead = np.ascontiguousarray(turned[:, :lead])
        self.rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.norm = np.sqrt((self.rows * self.rows).sum(1))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def products(slice_: Slice, at: np.ndarray, query: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Inner products with some vectors of a slice, exact: longs wrap around, which is right wherever the result is a long."""
    if slice_.exact is slice_.rows:
        return slice_.rows[at] @ query
    if (np.abs(slice_.rows[at] @ query) >= 2.0**63 * (1 - 1e-9)).any():
        raise OverflowError("an inner product is beyond a long")
    return slice_.exact[at] @ exact


def search(slice_: Slice, query_ids: np.ndarray, vectors: pa.Array, floors: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best of the slice for each query, of those at its floor or above."""
    width, lead = turn.shape[0], slice_.lead.shape[1]
    queries = matrix(vectors, width)
    exacts = queries if slice_.exact is slice_.rows else matrix(vectors, width, np.int64)
    turned = queries @ turn
    q_lead, q_norm = turned[:, :lead], np.sqrt((queries * queries).sum(1))
    q_rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
    floor = floors.astype(np.float64).copy()
    found = [(np.empty(0, np.int64), np.empty(0, exacts.dtype))] * len(queries)
    live = np.arange(len(queries))
    for a in range(0, len(slice_.ids), BLOCK):
        z = min(a + BLOCK, len(slice_.ids))
        live = live[reaches(q_norm[live], slice_.norm[a], floor[live])]
        if not len(live):
            break
        bound = q_lead[live] @ slice_.lead[a:z].T
        bound += np.outer(q_rest[live], slice_.rest[a:z])
        margin = q_norm[live] * slice_.norm[a] * 1e-9 + 1e-6
        keep = bound + margin[:, None] >= floor[live][:, None]
        dense = exacts is queries and keep.mean() > 0.1
        every = queries[live] @ slice_.rows[a:z].T if dense else None
        for i, q in enumerate(live.tolist()):
            at = np.flatnonzero(keep[i])
            if not len(at):
                continue
            scores = every[i, at] if dense else products(slice_, a + at, queries[q], exacts[q])
            ids = slice_.ids[a + at]
            # a floor is a score rounded to a double, as scores are here: none that reaches it is lost
            good = (scores >= floor[q]) & (ids != query_ids[q])
            if good.any():
                ids, scores = best(np.concatenate((found[q][0], ids[good])), np.concatenate((found[q][1], scores[good])), k)
                found[q] = ids, scores
                if len(ids) == k:
                    floor[q] = max(floor[q], float(scores[-1]))
    return found


def reaches(q_norm, norm, floor):
    """Whether an inner product of vectors of these lengths may be as much."""
    return q_norm * norm * (1 + 1e-9) + 1e-6 >= floor


def dealt(staged: DataFrame, column: str, n: int) -> DataFrame:
    """Numbers of partitions in order as ``n`` numbers in order: several to one where Spark has made more partitions than asked for."""
    made = (staged.agg(F.max(column)).first()[0] or 0) + 1
    return staged.withColumn(column, F.floor(F.col(column) * n / made).cast("int")) if made > n else staged


class Search:
    """The table's slices and queries, and which of them meet."""

    def __init__(self, vectors: DataFrame, is_query, k: int, scale: int, head: int, slice_rows: int, group_rows: int, lead: int):
        rows = stage(quantised(vectors, scale), "vectors")
        self.spark, self.k = rows.sparkSession, k
        n, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm2")).first()
        self.width = width = max(1, width or 0)
        self.lead, self.whole = min(lead, width), (most or 0) < 2.0**52
        turn = rotation(rows, width)
        n_slices = max(1, -(-n // slice_rows))
        ranged = rows.repartitionByRange(n_slices, F.desc("norm2"), "vec_id", F.xxhash64("v"))
        self.slices = dealt(stage(ranged.withColumn("slice", F.spark_partition_id()), "slices"), "slice", n_slices)
        # the longest of each slice, a number for every ``slice_rows`` vectors
        tops = self.slices.groupBy("slice").agg(F.max("norm2").alias("top")).orderBy("slice").toArrow()
        at, top = tops.column("slice").to_numpy(), np.sqrt(tops.column("top").to_numpy())
        # the head: as many of the longest as fixed, and what they give each query
        longest = rows.orderBy(F.desc("norm2"), "vec_id", "v").limit(head).select("vec_id", "v").toArrow().combine_chunks()
        vectors_ = longest.column("v").combine_chunks() if longest.num_rows else pa.array([], pa.list_(pa.int64()))
        first = Slice(longest.column("vec_id").to_numpy(), vectors_, width, turn, self.lead, self.whole)
        self.shared = shared = self.spark.sparkContext.broadcast((first, turn, at, top))

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head_, turn_, at_, top_ = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, QUERY_BLOCK):
                    part = batch.slice(lo, QUERY_BLOCK)
                    found = search(head_, part.column(0).to_numpy(), part.column(1), np.full(part.num_rows, -np.inf), turn_, k)
                    floors = np.array([float(s[-1]) if len(s) == k else -np.inf for _, s in found])
                    norms = np.sqrt((matrix(part.column(1), width) ** 2).sum(1))
                    # lengths fall from slice to slice: the first ones are reached
                    n_reached = [int(reaches(q, top_, f).sum()) for q, f in zip(norms, floors)]
                    reach = [int(at_[n - 1]) + 1 if n else 0 for n in n_reached]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floors), pa.array(reach, pa.int32())], names=["query_id", "q", "floor", "reach"])

        queries = rows.where(is_query).select("vec_id", "v").mapInArrow(start, "query_id long, q array<long>, floor double, reach int")
        queries = stage(queries.where("reach > 0"), "queries")
        groups = max(1, -(-queries.count() // group_rows))
        grouped = queries.repartitionByRange(groups, F.desc("reach"), F.xxhash64("query_id", "q"))
        self.queries = dealt(stage(grouped.withColumn("group", F.spark_partition_id()), "grouped"), "group", groups)

    def cells(self) -> tuple[DataFrame, DataFrame]:
        """Copies of vectors and of queries by (slice, group), where they meet."""
        met = self.queries.groupBy("group").agg(F.max("reach").alias("reach"))
        # a column of its own, as both sides come from the queries
        met = met.select((F.col("group") + 0).alias("group"), F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("slice"))
        left = self.slices.select("slice", "vec_id", "v").join(met, "slice")
        return left, self.queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("reach") - 1))).drop("reach")

    def result(self) -> DataFrame:
        k, width, lead, whole, shared = self.k, self.width, self.lead, self.whole, self.shared

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if left.num_rows and right.num_rows:
                turn = shared.value[1]
                here = Slice(left.column("vec_id").to_numpy(), left.column("v").combine_chunks(), width, turn, lead, whole)
                ids, floors, q = right.column("query_id").to_numpy(), right.column("floor").to_numpy(), right.column("q").combine_chunks()
                for lo in range(0, len(ids), QUERY_BLOCK):
                    found = search(here, ids[lo : lo + QUERY_BLOCK], q.slice(lo, QUERY_BLOCK), floors[lo : lo + QUERY_BLOCK], turn, k)
                    for query, (f, s) in zip(ids[lo : lo + QUERY_BLOCK].tolist(), found):
                        out[0] += [query] * len(f)
                        out[1] += f.tolist()
                        out[2] += s.astype(np.int64).tolist()
            return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

        left, right = self.cells()
        hits = left.groupBy("slice", "group").cogroup(right.groupBy("slice", "group")).applyInArrow(cell, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, head: int = HEAD, slice_rows: int = SLICE_ROWS, group_rows: int = GROUP_ROWS, lead: int = LEAD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each vector for which ``is_query`` holds."""
    return Search(vectors, is_query, k, scale, head, slice_rows, group_rows, lead).result()


def op8(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.expr("vec_id % 20 = 0"))
