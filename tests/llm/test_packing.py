import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing


def test_rules_are_best_fit_decreasing():
    """Against the textbook loop, item by item, over many small cases."""
    rnd = random.Random(4)
    for _ in range(300):
        capacity = rnd.choice([7, 16, 50])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        bins = []
        for x in sorted(items, reverse=True):
            fits = [i for i, room in enumerate(bins) if room >= x]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= x
            else:
                bins.append(capacity - x)
        placed, seen = defaultdict(list), Counter(items)
        rules = packing.plan(dict(seen), capacity)
        for n, (length, rank, sequence, offset, per) in enumerate(rules):
            end = rules[n + 1][1] if n + 1 < len(rules) and rules[n + 1][0] == length else seen[length]
            for k in range(end - rank):
                placed[sequence + k // per].append((offset + k % per * length, length))
        assert sorted(placed) == list(range(len(bins)))
        assert sorted(capacity - sum(x for _, x in p) for p in placed.values()) == sorted(bins)
        for p in placed.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length


def texts():
    rnd = random.Random(8)
    soup = ["a", "é", " ", "  ", "\n", " ", " ", "　", "don't", "'s", "1", "漢字", "<|endoftext|>", "<|endoftext", "<|endoftext|> x", "\t", "\x0b", "\x85", "!", "😀", "​", "﻿"]
    out = [None, "", " ", "word " * 5000, "x" * 3000]
    return out + ["".join(rnd.choices(soup, k=rnd.randint(1, 400))) for _ in range(60)]


def test_ids_are_the_tokenizers(monkeypatch):
    t = Tokenizer.from_file(packing.vocabulary_path())
    ids, added = packing.id_finder(packing.vocabulary_path())
    assert added == ["<|endoftext|>"]
    parts = packing.parts
    for x in texts():
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids(x or "") == want
        for most in (1, 7, 100):
            cut = list(parts((x or "").encode(), added, most))
            assert b"".join(cut) == (x or "").encode()
            assert [i for p in cut for i in ids(p.decode())] == want


@pytest.mark.parametrize("capacity,per", [(2048, 20_000), (50, 10)])
def test_packing_a_table(spark, capacity, per, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", per)
    rows = [(i, t, 1, 2) for i, t in enumerate(texts() * 3)]
    rows += rows[:4] + [(None, "no id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, offset int")
    got = packing.pack_documents(docs, capacity=capacity).collect()
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 11 / 9 * -(-sum(r.length for r in got) // capacity) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_have_their_ids():
    ids, _ = packing.id_finder(packing.vocabulary_path())
    assert ids("<|endoftext|>") == [50256] and ids("a <|endoftext|> b").count(50256) == 1


def test_other_vocabularies_are_encoded_by_their_own_library(tmp_path):
    import json

    held = json.load(open(packing.vocabulary_path()))
    held["added_tokens"][0]["lstrip"] = True
    path = str(tmp_path / "v.json")
    json.dump(held, open(path, "w"))
    ids, added = packing.id_finder(path)
    plain = Tokenizer.from_file(path)
    assert added is None and all(ids(x or "") == plain.encode(x or "", add_special_tokens=False).ids for x in texts())


def test_repeated_and_null_ids_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 50)
    docs = spark.createDataFrame([(None if i % 2 else 7, "w " * (i % 40), "x") for i in range(2000)], "doc_id long, text string, rank string")
    pieces = packing.token_pieces(docs)
    got = packing.ranked(pieces).collect()
    for n in {r.length for r in got}:
        ranks = sorted(r["rank"] for r in got if r.length == n)
        assert ranks == list(range(len(ranks)))
