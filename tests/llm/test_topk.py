import math
import random

import pyarrow as pa
import pytest

from tessera.llm import topk


def brute(rows, k, every):
    good = []
    for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def rows(seed, n, width):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    out = [(i, [round(b * rnd.choice([0.1, 1, 3]) + rnd.gauss(0, 0.1), 2) for b in rnd.choice(base)]) for i in range(n)]
    common = out[3][1]
    out += [(n + i, common) for i in range(n // 3)]
    out += [(5000, None), (5020, [float("nan")] * width), (5040, [float("inf")] * width), (5060, [None] * width), (None, common), (5080, []), (5100, common[:1])]
    out += out[:3]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("n,width,k,head,slice_rows", [(300, 8, 5, 16, 60), (200, 70, 20, 4096, 1 << 14), (4, 4, 20, 2, 2)])
def test_top_k(spark, n, width, k, head, slice_rows):
    data = rows(n, n, width)
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, rank int")
    data = [(i, v) for i, v, _ in df.collect()]
    got = topk.top_k(df, topk.F.expr("vec_id % 20 = 0"), k, head=head, slice_rows=slice_rows).collect()
    assert sorted(map(tuple, got)) == brute(data, k, 20)


def test_blocks_prune(spark, monkeypatch):
    """Long vectors first, so that most of a slice is never looked at."""
    import numpy as np

    rnd = np.random.default_rng(0)
    m = np.floor(64 * rnd.normal(0, 0.1, (20_000, 16)) * rnd.exponential(1, (20_000, 1)))
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    vectors = pa.array(list(m.astype(np.int64)), pa.list_(pa.int64()))
    for whole in (True, False):
        s = topk.Slice(np.arange(20_000), vectors, 16, turn, 8, whole)
        found = topk.search(s, np.arange(40), vectors.slice(0, 40), np.full(40, -np.inf), turn, 20)
        scores = m[:40] @ m.T
        for q, (ids, got) in enumerate(found):
            order = [i for i in np.lexsort((np.arange(20_000), -scores[q])) if i != q][:20]
            assert ids.tolist() == order and got.tolist() == scores[q][order].tolist()


def test_large_components_are_exact(spark):
    rnd = random.Random(3)
    data = [(i, [rnd.choice([-1, 1]) * rnd.randint(1, 10**6) * 1.0 for _ in range(12)]) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(df, topk.F.expr("vec_id % 20 = 0"), 10, head=20, slice_rows=40).collect()
    assert sorted(map(tuple, got)) == brute(data, 10, 20)


def test_too_large_is_an_error(spark):
    for x, why in ((1e15, "beyond a long"), (1e19, "too large")):
        df = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=why):
            topk.top_k(df, topk.F.expr("vec_id = 0")).collect()


def test_lengths_prune_before_the_shuffle(spark):
    """Few long vectors, many short ones: queries and vectors meet in a small part of the grid, and nothing is lost."""
    rnd = random.Random(8)
    data = [(i, [rnd.gauss(0, 1) * (20 if i % 50 == 0 else 0.05) for _ in range(6)]) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = topk.Search(df, topk.F.expr("vec_id % 20 = 0"), 5, 64, 100, 100, 25, 4)
    left, right = found.cells()
    assert found.slices.select("slice").distinct().count() > 15
    assert right.count() < 150 * 30 / 3 and left.count() < 3000 * 6 / 2
    got = sorted(map(tuple, found.result().collect()))
    assert got == brute(data, 5, 20)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.expr("true")).count() == 0
