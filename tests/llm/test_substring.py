import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import substring, textvec


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width):
    least: dict = {}
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i : i + width])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), tuple(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice(["a", "be", "é", "日本", "x,"]) + str(i) for i in range(60)]
    passages = [rnd.choices(vocabulary, k=rnd.choice([4, 5, 6, 30])) for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 8)):
            w += rnd.choice(passages) if rnd.random() < 0.4 else rnd.choices(vocabulary, k=rnd.randint(1, 20))
        rows.append((i * 3, "".join(x + rnd.choice([" ", "\n", " \t "]) for x in w), "s", 1))
    rows += [(3, rows[1][1], "s", 1), (None, rows[2][1], "s", 1), (None, None, None, 1), (10**6, None, "s", 1), (10**6 + 1, "", "s", 1), (10**6 + 2, " ".join(vocabulary * 100), "s", 1)]
    rows += rows[:2]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(autouse=True)
def few_shards(monkeypatch):
    monkeypatch.setattr(substring, "SHARDS", 2)


def results(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, tuple(words_of(r.kept_text))) for r in df.collect())


@pytest.mark.parametrize("batches,chunk_bytes,per_bucket,fan_in,fan", [(1, 1 << 20, 1 << 20, 4, 4096), (2, 300, 100, 4, 4), (5, 900, 700, 2, 4096)])
def test_dedup(spark, monkeypatch, batches, chunk_bytes, per_bucket, fan_in, fan):
    """Whatever batches, runs and steps; five batches compact."""
    monkeypatch.setattr(substring, "FAN", fan)
    monkeypatch.setattr(substring, "SPLIT_WINDOWS", 300)
    compact, seen = substring.SubstringIndex.compact, []
    monkeypatch.setattr(substring.SubstringIndex, "compact", lambda self, k=None: (seen.append(k), compact(self, k)))
    rows = corpus(batches, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = substring.dedup(df, 5, batches=batches, chunk_bytes=chunk_bytes, windows_per_bucket=per_bucket, fan_in=fan_in)
    assert results(got) == brute(rows, 5)
    assert all((r.kept_text == r.text) if not r.n_removed else r.kept_text is not None for r in got.collect())
    assert bool(seen) == (batches == 5)


def test_index_is_kept_reopened_grown_and_compacted(spark, tmp_path):
    """Three calls in sequence equal brute force over all, a later call's documents after all earlier ones."""
    path, earlier = str(tmp_path / "index"), []
    options = {"width": 5, "batches": 2, "chunk_bytes": 500, "windows_per_bucket": 300}
    for k, seed in enumerate((21, 22, 21)):
        rows = corpus(seed, 30 + 40 * k)
        if k == 2:  # smaller ids come later all the same
            rows = [(d - 10**7 if d is not None else None, *r) for d, *r in rows]
        index = substring.SubstringIndex.open(spark, path, **options)
        assert len(index.chunks) == k and index.options["width"] == 5
        got = index.add(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int"))
        # brute force numbers ids by (call, id)
        numbered = earlier + [(d if d is None else (k + 1) * 10**9 + d, *r) for d, *r in rows]
        want = brute(numbered, 5) - brute(earlier, 5)
        assert Counter((d if d is None else (k + 1) * 10**9 + d, *r) for (d, *r), n in results(got).items() for _ in range(n)) == want
        earlier = numbered
        if k == 1:
            index.compact()
            index.save()
            assert all(len(r) <= 1 for r in index.runs)
    windows = sum(n for r, n in Counter(tuple(words_of(t)[i : i + 5]) for d, t, *_ in earlier if d is not None for i in range(len(words_of(t)) - 4)).items())
    index = substring.SubstringIndex.open(spark, path)
    held = sum(len(substring.sorted_numbers(r.prints)) for rs in index.runs if rs for r in index.entries_in(rs, substring.RUN).collect())
    distinct = len({tuple(words_of(t)[i : i + 5]) for d, t, *_ in earlier if d is not None for i in range(len(words_of(t)) - 4)})
    assert held == distinct < windows


def test_null_and_repeated_ids_meet_no_single_chunk(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choices([f"w{i}" for i in range(30)], k=40))
    same = text()
    rows = [(None, text()) for _ in range(200)] + [(7, same if i % 3 else text()) for i in range(200)] + [(5, same), (9, same), (9, text()), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = substring.cut_into_chunks(df, 5, 2000).collect()
    assert max(c.n_windows for c in chunks) <= 36 * 20 and len(chunks) > 20
    assert sum(substring.unpacked(c.payload).num_rows for c in chunks) == len(rows) and len({c.chunk for c in chunks}) == len(chunks)
    assert results(substring.dedup(df, 5, chunk_bytes=2000, batches=3)) == brute(rows, 5)


def test_very_long_text_and_ties(spark):
    rnd = random.Random(6)
    long_ = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(200_000))
    rows = [(2, long_), (1, long_[: len(long_) // 2]), (3, long_), (3, long_)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=1 << 16).collect()}
    want = {(d, w, g) for d, w, g, _ in brute(rows, 13)}
    assert got == want


def test_false_matches_are_found_and_avoided(spark, monkeypatch):
    """With few bits most fingerprints clash; verification must see it, and never let it through."""
    monkeypatch.setattr(substring, "SALTS", 2)
    monkeypatch.setattr(substring.Layout, "of", classmethod(lambda cls, n, width, per: cls(width, 1, 4)))
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    with pytest.raises(AssertionError, match="more bits"):
        substring.dedup(df, 5, batches=1, chunk_bytes=300)


def test_another_salt_gives_exact_results(spark, monkeypatch):
    """Few bits with the first salt, enough with the next."""
    made = substring.Layout.of.__func__
    init = substring.Chunk.__init__
    monkeypatch.setattr(substring.Layout, "of", classmethod(lambda cls, n, width, per: substring.replace(made(cls, n, width, per), buckets=1, bits=8)))
    add = substring.replace
    monkeypatch.setattr(substring, "replace", lambda x, **k: add(x, **k, **({"bits": 40} if k.get("salt", 1) > 1 else {})))
    rows = corpus(3, 60)
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string, x int"), 5, batches=2, chunk_bytes=300)
    assert results(got) == brute(rows, 5) and init is substring.Chunk.__init__


def test_bits_and_buckets_follow_the_windows():
    per = substring.WINDOWS_PER_BUCKET
    for n in (0, 1, 10**6, 2 * 10**8, 2 * 10**13):
        x = substring.Layout.of(n, 13, per)
        assert x.buckets == max(1, -(-n // per))
        assert x.bits == 64 or n * n / 2 / 2 ** x.all_bits() <= 1 / 32
        assert sum(hi - lo for lo, hi in map(x.shard, range(substring.SHARDS))) == x.buckets


def test_empty(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert substring.dedup(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 2


def test_word_hashes_are_of_the_words():
    rnd = random.Random(0)
    data = "".join(rnd.choices(["a", "bc", "é", " ", "\n", "x" * 50], k=5000)).encode() + b" " + b"y" * (textvec.PIECE + 5) + b" a " + b"y" * (textvec.PIECE + 5)
    buf = np.frombuffer(data, np.uint8)
    starts, ends = textvec.spans(buf)
    found = [data[a:b] for a, b in zip(starts, ends)]
    assert found == data.split()
    hashes = textvec.span_hashes(buf, starts, ends)
    by = {}
    for w, h in zip(found, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_byte_planes():
    for numbers in ([], [0], [1, 2, 300], [2**63, 2**64 - 1]):
        x = np.array(numbers, np.uint64)
        assert textvec.unvarint(textvec.varint(x)).tolist() == numbers
