import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing


def brute_targets(sizes, weights, most=3):
    """(source, size) in order to targets, by sharing the excess again until none is above."""
    target, held = {}, set()
    total = sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        left = total - sum(most * sizes[s] for s in held)
        for s in free:
            target[s] = left * weights[s] / sum(weights[f] for f in free)
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
            held.add(s)


def filled(room, counts, start=0):
    """(by how much it misses, sizes) of as many of the longest as fit, then of the next, and one more of the shortest left if nearer."""
    left, out, spare = room, [], None
    for z in sorted(counts, reverse=True)[start:]:
        k = min(counts[z], left // z)
        out += [z] * k
        left -= k * z
        spare = z if k < counts[z] else spare
    return (spare - left, [*out, spare]) if spare is not None and spare - left < left else (left, out)


def brute_last_pass(sizes_in_order, target, source_size):
    """The sizes that the last pass takes."""
    passes = int(target // source_size) if source_size else 0
    room, at, within, rest = int(target) - passes * source_size, 0, [], []
    for z in sizes_in_order:
        fits = 0 < z <= room
        (within if fits and at + z <= room else rest).append(z)
        at += z if fits else 0
    if passes >= 3:
        return within
    off, more = filled(room - sum(within), Counter(z for z in rest if z))
    if off > 0.01 * target:
        every = Counter(z for z in sizes_in_order if z)
        best = min(((filled(room, every, k)[0], k) for k in range(min(mixing.TRIES, len(every)))), default=(off, 0))
        if best[0] < off:
            return filled(room, every, best[1])[1]
    return within + more


def table(seed, n, spark, names="abcdefgz"):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "hot", "hot", *names]), rnd.choice([0, 1, 5, 40, 200, 1500])) for i in range(n)]
    rows += rows[:3]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


@pytest.mark.parametrize("seed,n,per", [(2, 900, 50), (3, 7, 2)])
def test_mix(spark, seed, n, per, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per)
    rows, df = table(seed, n, spark)
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.source or "~", r.size) for r in got) == sorted((d, s or "~", z) for d, s, z in rows)
    size = defaultdict(int)
    for _, s, z in rows:
        size[s] += z
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute_targets({s: size[s] for s in names}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    # the same by plain running sums in the drawn order
    for s in names:
        mine = sorted((hashlib.md5(f"mix{d}".encode()).hexdigest(), d, z) for d, x, z in rows if x == s)
        passes = int(want[s] // size[s]) if size[s] else 0
        last = Counter(r.size for r in got if r.source == s and r.size for _ in range(r.copies - passes))
        assert last == Counter(brute_last_pass([z for *_, z in mine], want[s], size[s])), s
        # copies follow each other through the schedule, each pass in the drawn order
        times = sorted(p for r in got if r.source == s for p in r.positions)
        assert len(set(times)) == len(times)


def test_schedule_is_integrated_and_inverted(spark):
    knots = ((0.0, 1.0), (0.25, 5.0), (0.5, 0.0), (1.0, 4.0))
    total = mixing.area(knots)

    def weight(t):
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if t <= b:
                return u + (v - u) * (t - a) / (b - a)

    df = spark.range(101).selectExpr("id / 100D as share")
    for r in df.withColumn("t", mixing.invert(knots, df.share)).collect():
        n = 4000
        got = sum(weight((k + 0.5) * r.t / n) for k in range(n)) * r.t / n
        assert got == pytest.approx(r.share * total, abs=2e-3)


def test_curriculum_moves_with_its_schedules(spark):
    rows = [(i, "abc"[i % 3], 10) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    early = {s: sum(p < 0.5 for r in got if r.source == s for p in r.positions) / max(1, sum(r.copies for r in got if r.source == s)) for s in "abc"}
    assert early["a"] == pytest.approx(0.55, abs=0.02)
    assert early["b"] == pytest.approx(0.5, abs=0.02)
    assert early["c"] == pytest.approx(0.375, abs=0.02)


def test_empty_blank_and_extra_columns(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    rows = [(1, None, None, 5), (2, "", "a", 6), (None, "x y", "a", 7), (2, "", "a", 8)]
    docs = mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int"))
    got = mixing.mix(docs.select("doc_id", "source", "size")).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == [(-1, 2, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0)]


def test_clashing_columns_are_carried_or_replaced(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", 7), (2, "b", 5, "y", 8)], "doc_id long, source string, size long, bucket string, target int")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert (got[1].bucket, got[2].bucket) == ("x", "y") and got[1].target == pytest.approx(50 / 7)


def long_ones(seed=0):
    """Sources with very long documents, as (doc_id, source, size)."""
    rnd = random.Random(seed)
    rows = [("a", 200)] * 900 + [("b", 100)] * 2000 + [("b", 150_000)]
    rows += [(s, z) for s in "cdef" for z in [rnd.choice([5, 30, 90, 200]) for _ in range(12)] + [1500, 3000]]
    rows += [(None, z) for z in (7, 7, 7, 7, 900)] + [("g", 0), ("a", 0)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed,per", [(0, 20_000), (2, 50)])
def test_sources_come_near_their_targets(spark, seed, per, monkeypatch):
    """No nearer than half the shortest document left, whichever the ids draw across the cut."""
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per)
    rows = long_ones(seed)
    df = spark.createDataFrame([(1000 * seed + i, *r) for i, *r in rows], "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert sorted((r.source or "~", r.size) for r in got) == sorted((s or "~", z) for _, s, z in rows)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        gap = mine[0].target - sum(r.taken for r in mine)
        passes = min([r.copies for r in mine if r.size], default=0)
        assert max([r.copies for r in mine if r.size], default=0) <= min(3, passes + 1)
        left = [r.size for r in mine if r.size and r.copies == passes < 3]
        assert abs(gap) <= min(left, default=1) + 1, s
        times = sorted((p, r.size) for r in mine for p in r.positions)
        assert all(0 <= p <= 1 for p, _ in times) and len({p for p, _ in times}) == len(times)
        if s == "b":
            assert abs(gap) <= 50 and max(p for p, _ in times) == pytest.approx(1, abs=2e-2) and times[0][0] < 0.7


def test_query_inverts_and_range_sorts(spark, tmp_path):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = mixing.op4(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(first_position" in plan.replace("#", " ").replace("(first_position ", "(first_position") or "rangepartitioning(first_position" in plan
    assert "SQRT" in df._jdf.queryExecution().optimizedPlan().toString()
    got = [r.first_position for r in df.collect()]
    taken = [p for p in got if p is not None]
    assert taken == sorted(taken) and got[len(taken) :] == [None] * (len(got) - len(taken)) and len(taken) > 100
