import random
import re

import pytest
import xxhash

from tessera.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in listed}


def test_fingerprints():
    rnd = random.Random(1)
    for text in [None, "", " \n", "One", "one TWO", "É a b C d", *[" ".join(rnd.choices(["A", "b", "É", "cc"], k=n)) for n in (3, 4, 50, 2000)]]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def cluster(rnd, n, spread):
    base = rnd.getrandbits(64)
    out = {base}
    while len(out) < n:
        p = rnd.choice(sorted(out)) if spread else base
        for _ in range(rnd.randint(1, 3)):
            p ^= 1 << rnd.randrange(64)
        out.add(p)
    return out


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.ring_for(n).segments for n in (0, 10**6, 10**8, 2 * 10**9, 10**11)] == [8, 8, 16, 32, 64]


@pytest.mark.parametrize("dense,segments", [(1, 8), (4, 8), (1000, 8), (4, 16), (1000, 64)])
def test_links_join_the_same_groups_as_all_pairs(spark, dense, segments):
    rnd = random.Random(7)
    prints = {rnd.getrandbits(64) for _ in range(150)} | cluster(rnd, 60, True) | cluster(rnd, 60, False) | {0, 1, 3, (1 << 64) - 1}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = simhash.links(df, simhash.Ring(segments=segments), dense=dense)
    unsigned = lambda p: p % (1 << 64)
    assert all((r.a ^ r.b).__and__((1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    want = brute_components(prints)
    got = {unsigned(r.node): r.root for r in simhash.components(edges).collect()}
    groups: dict = {}
    for p in prints:
        groups.setdefault(got.get(p, simhash.signed(p)), set()).add(p)
    expected: dict = {}
    for p, r in want.items():
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    df = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in simhash.components(df).collect()} == {(i, 0) for i in range(201)}
    assert simhash.components(df.limit(0)).count() == 0


def test_documents(spark):
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 5, 300]))
        rows.append((i, " ".join(words)))
        for k in range(rnd.choice([0, 0, 1, 3])):
            near = list(words)
            if near and k:
                near[rnd.randrange(len(near))] = "other"
            rows.append((1000 + 10 * i + k, " ".join(near)))
    rows += [(None, ""), (None, "alone and without an id"), (7, rows[7][1]), (5000, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, component_id int, n int")
    roots = brute_components({brute_fingerprint(t) for _, t in rows})
    least: dict = {}
    for d, t in rows:
        if d is not None:
            r = roots[brute_fingerprint(t)]
            least[r] = min(least.get(r, d), d)
    got = simhash.grouped(df).select("doc_id", "fp", "component_id").collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(d, simhash.signed(brute_fingerprint(t)), least.get(roots[brute_fingerprint(t)])) for d, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one(df).collect()
    nameless = len(set(roots.values()) - set(least))
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, [*least.values(), *[None] * nameless]))
    assert len(kept[0]) == 4 and nameless == 1
    assert simhash.grouped(df.limit(0)).count() == 0
