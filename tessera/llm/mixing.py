"""Mixing sources to target weights by a time-varying curriculum.

Every source has a schedule: knots (t, weight) over training time 0..1, with
straight lines between them. The area under a schedule is the source's weight;
areas share out all words, and no source gets more than ``most_passes`` times
its own words (the excess is shared again by weight, until none is above).

A source's documents, in an order drawn from their ids by MD5, are one stream
of words, read again from the start where the target asks for more than one
pass. The stream's cumulative demand over training time is the target times the
integral of the schedule; its inverse at the middle of a document copy is the
copy's position. Sorting by position (a range partitioning) mixes the sources
as the schedules ask at every moment.

Copies are whole. The last pass over a source takes, in the drawn order, the
documents that fit the room left for it, up to the one that would overrun it. The
gap goes to the documents left over, by size: as many of the longest as fit, then
of the next, down to the shortest, so that none is left that fits; and one more of
the shortest left, if that comes nearer. A source (of few documents) that is still
over 1 % off is filled by size from the start, from each of its ``TRIES`` longest
sizes down, if one of these comes nearer.

Scale: a source is cut into buckets of the MD5 order, so that running sums never
meet in one task: sums by (source, bucket), running sums of these few numbers by
source, then running sums within a bucket. Joins are on (source, bucket), so a hot
source is spread like any other. What meets by source alone are counts by size, as
many as its documents have sizes (no more than the longest has words); and the sources
meet in one task, a few numbers each. All of it is SQL expressions in the JVM.

Null texts have size 0; null sources are a source of their own, the last; rows
that repeat a doc_id are documents of their own; rows alike in id, source and
size are interchangeable; so are null ids of one size. Texts are counted whole.
Sources without words have target 0. Extra columns are carried, those named like
results replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage, table, words

ROWS_PER_BUCKET = 20_000
#: From how many of its longest sizes a source is filled that is still off.
TRIES = 64
#: The production schedules, dealt to the sources in turn; areas 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))


def area(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(knots, share: Column) -> Column:
    """The time by which ``share`` (0..1) of a schedule's area has passed."""
    total, done, out = area(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        left = F.greatest(share * total - done, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        at = t0 + 2 * left / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0))))
        part = (t1 - t0) * (w0 + w1) / 2
        if part:
            done += part
            at = F.least(at, F.lit(t1))
            out = at if out is None else F.when(share * total > done - part, at).otherwise(out)
    return F.lit(0.0) if out is None else out


def targets(sources: DataFrame, schedules=SCHEDULES, most_passes: int = 3) -> DataFrame:
    """Adds ``turn`` (which schedule) and ``target`` to (source, source_size), one row per source.

    Sources reach the limit in the order of size to weight. The first k are
    held at it if the level left for the others, (words - limits) / weights,
    is above the k-th's own ratio; the level of the rest is the last such.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(area(s))) for s in schedules]), F.col("turn") + 1)
    out = sources.withColumn("turn", (F.row_number().over(by_name) - 1) % len(schedules)).withColumn("weight", weight)
    limit = F.col("source_size") * most_passes
    out = out.withColumn("ratio", limit / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    out = out.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(rest))
    out = out.withColumn("rank", F.row_number().over(order))
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("level") * F.col("weight")))
    return out.select("source", "source_size", "turn", target.alias("target"))


def draw(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds the drawn order's key: 32 hex digits."""
    return docs.withColumn("drawn", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def joined(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], columns: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with columns of ``other``, by keys of which null is one like others."""
    test = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        test = same if test is None else test & same
    return rows.alias("a").join(other.alias("b"), test, how).select("a.*", *[F.col(f"b.{c}").alias(c) for c in columns])


CELL = ("source", "bucket")


def run_up(cells: DataFrame, words: str, name: str) -> DataFrame:
    """Adds to cells the sum of ``words`` over the source's cells before."""
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.coalesce(F.sum(words).over(before), F.lit(0)))


def before_in_cell(size: Column) -> Column:
    """The sum of ``size`` over the rows of the cell before this one in the drawn order."""
    order = Window.partitionBy(*CELL).orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(order), F.lit(0))


def by_size(counts: DataFrame, tries: int) -> DataFrame:
    """(source, sizes, off): how many of each size fill ``room`` best, from (source, room, size, n), and by how much they miss it.

    A fold from the longest size down, or from the next ones down to the ``tries``-th; one more of
    the shortest left over if that comes nearer. A source without counts (null size) misses all its room.
    """
    n = "least(x.n, s.left div x.size)"
    none = "cast(array() as array<struct<size: bigint, take: bigint>>)"
    taken = f"if({n} > 0, concat(s.sizes, array(named_struct('size', x.size, 'take', {n}))), s.sizes)"
    spare = f"if({n} < x.n, x.size, s.spare)"
    start = f"named_struct('left', room, 'sizes', {none}, 'spare', cast(null as bigint))"
    fold = f"aggregate(slice(all, k, size(all)), {start}, (s, x) -> named_struct('left', s.left - x.size * {n}, 'sizes', {taken}, 'spare', {spare}))"
    over = "coalesce(f.spare - f.left < f.left, false)"
    ended = f"transform(array({fold}), f -> named_struct('off', if({over}, f.spare - f.left, f.left), 'k', k, 'sizes', if({over}, concat(f.sizes, array(named_struct('size', f.spare, 'take', 1L))), f.sizes)))[0]"
    out = counts.groupBy("source", "room").agg(F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "n"))), asc=False).alias("all"))
    best = f"if(size(all) = 0, named_struct('off', room, 'k', 0, 'sizes', {none}), array_min(transform(sequence(1, least({tries}, size(all))), k -> {ended})))"
    return out.selectExpr("source", f"{best} as f").select("source", "f.sizes", "f.off")


def last_pass(docs: DataFrame, most_passes: int = 3) -> DataFrame:
    """Adds ``last``, whether the last pass takes a document; ``docs`` has ``within``, whether it does in the drawn order."""
    may = (F.col("size") > 0) & (F.col("passes") < most_passes)
    got = F.sum(F.when(F.col("within"), F.col("size")).otherwise(0))
    gaps = docs.groupBy("source").agg(F.max("room").alias("whole"), (F.max("room") - got).alias("room"), F.max("target").alias("target"))
    counts = docs.where(may & ~F.col("within")).groupBy("source", "size").agg(F.count("*").alias("n"))
    first = by_size(joined(gaps, counts, ("source",), ["size", "n"], "left"), 1)
    first = stage(joined(first, gaps, ("source",), ["whole", "target"]), "mix-sizes")
    off = first.where("off > 0.01D * target").select("source", F.col("whole").alias("room"))
    cells = docs.select(*CELL).distinct()
    some = joined(docs.where(may), joined(cells, off, ("source",), ["room"]).withColumnRenamed("room", "__room"), CELL, ["__room"])
    anew = by_size(some.groupBy("source", F.col("__room").alias("room"), "size").agg(F.count("*").alias("n")), TRIES)
    anew = anew.select("source", F.struct("off", "sizes").alias("anew"))
    again = F.coalesce(F.col("anew.off") < F.col("off"), F.lit(False))
    plan = joined(first, anew, ("source",), ["anew"], "left").select("source", again.alias("again"), F.when(again, F.col("anew.sizes")).otherwise(F.col("sizes")).alias("sizes"))
    plan = stage(plan, "mix-plan")
    out = joined(docs, joined(cells, plan, ("source",), ["again"]), CELL, ["again"])
    out = out.withColumn("__open", may & (F.col("again") | ~F.col("within")))
    # of each size as many as the plan says, in the drawn order
    take = plan.selectExpr("source", "explode(sizes) as t").groupBy("source", F.col("t.size").alias("size")).agg(F.sum("t.take").alias("take"))
    counts = out.where("__open").groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = joined(counts, take, ("source", "size"), ["take"]).withColumn("__left", F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = joined(out, counts.where("__left > 0"), ("source", "bucket", "size"), ["__left"], "left")
    rank = F.row_number().over(Window.partitionBy("source", "bucket", "size", "__open").orderBy("drawn", "doc_id"))
    more = F.col("__open") & F.coalesce(rank <= F.col("__left"), F.lit(False))
    return out.withColumn("last", (F.col("within") & ~F.col("again")) | more).drop("__open", "__left", "again", "within")


def mix(sized: DataFrame, schedules=SCHEDULES, most_passes: int = 3, seed: str = "mix") -> DataFrame:
    """How often, and when, training reads each of (doc_id, source, size) and further columns.

    Adds source_size, target, copies, taken (= copies * size) and positions, an
    array of the copies' training times; these replace columns of such names.
    """
    own = ["doc_id", "source", "size"]
    more = [c for c in sized.columns if c not in (*own, "source_size", "target", "copies", "taken", "positions")]
    sized = sized.select(*own, *([F.struct(*more).alias("__more")] if more else []))
    names = [*own, *([f"__more.{c}" for c in more]), "source_size", "target"]
    drawn = stage(draw(sized, seed), "mix")
    n_buckets = max(1, -(-drawn.count() // ROWS_PER_BUCKET))
    # the first 8 digits give a bucket, in the order of the keys
    bucket = F.floor(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("double") * n_buckets / 2**32).cast("int")
    drawn = drawn.withColumn("bucket", bucket)
    cells = drawn.groupBy(*CELL).agg(F.sum("size").alias("words"))
    plan = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, most_passes)
    # whole passes, then the room of the last one
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("room", F.floor(F.col("target")) - F.col("passes") * F.col("source_size"))
    planned = ["source_size", "target", "turn", "passes", "room"]
    cells = joined(run_up(cells, "words", "base"), plan, ("source",), planned)
    out = joined(drawn, cells, CELL, ["base", *planned])
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    out = out.withColumn("start", F.col("base") + before_in_cell(F.col("size"))).withColumn("__at", before_in_cell(F.when(fits, F.col("size")).otherwise(0)))
    out = stage(out.drop("base"), "mix-first")
    cells = out.groupBy(*CELL).agg(F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("words"))
    out = joined(out, run_up(cells, "words", "base"), CELL, ["base"])
    out = out.withColumn("within", fits & (F.col("base") + F.col("__at") + F.col("size") <= F.col("room"))).drop("base", "__at")
    out = stage(last_pass(out, most_passes), "mix-last")
    # where a document is in the last pass, and the words that the source's passes take together
    one = F.when(F.col("last"), F.col("size")).otherwise(0)
    cells = run_up(out.groupBy(*CELL).agg(F.sum(one).alias("words")), "words", "base")
    cells = cells.withColumn("filled", F.sum("words").over(Window.partitionBy("source")))
    out = joined(out, cells, CELL, ["base", "filled"]).withColumn("__at", F.col("base") + before_in_cell(one))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.col("last").cast("long")).otherwise(0))

    def position(k: Column) -> Column:
        middle = k * F.col("source_size") + F.when(k < F.col("passes"), F.col("start")).otherwise(F.col("__at")) + F.col("size") / 2
        share = middle / (F.col("passes") * F.col("source_size") + F.col("filled"))
        when = F.when(F.col("turn") == 0, invert(schedules[0], share))
        for i, s in enumerate(schedules[1:], 1):
            when = when.when(F.col("turn") == i, invert(s, share))
        return when

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("positions", positions).select(*names, "copies", "taken", "positions")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    """The mix in training order: documents range-sorted by the position of their first copy, those not taken last."""
    docs = sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    first, last = F.get("positions", F.lit(0)), F.get("positions", (F.col("copies") - 1).cast("int"))
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"), last.alias("last_position"))
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
