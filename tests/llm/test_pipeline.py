import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import test_mixing
import test_simhash
import test_substring
from tokenizers import Tokenizer

from tessera.llm import langid, packing
from tessera.llm.common import stage

WORDS = {"en": [a + b for a in ("the", "of", "in", "wh", "sh") for b in ("ing", "er", "on", "ly", "ed", "th")], "de": [a + b for a in ("sch", "pf", "ver", "ge") for b in ("ung", "keit", "ich", "en", "ß")]}


def documents(spark, seed=0, n=160):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices(WORDS["en"], k=25)) for _ in range(5)]
    rows = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "de"])
        text = ". ".join(" ".join(rnd.choices(WORDS[lang], k=rnd.randint(4, 15))) for _ in range(rnd.randint(1, 40)))
        if lang == "en" and rnd.random() < 0.3:
            text += "\n" + rnd.choice(passages)
        rows.append((i, text, lang, rnd.choice(["a", "a", "a", "b", "c", None])))
    rows += [(n + i, rows[i][1] + rnd.choice(["", " end"]), rows[i][2], "d") for i in range(20)]
    rows += [(900, None, None, "a"), (901, "", "en", "a"), (902, " 12 ?", "en", "b"), (None, rows[3][1] + " once more here", "en", "a"), rows[5]]
    rows += [(950, " ".join(rnd.choices(WORDS["en"], k=12_000)), "en", "b"), (951, "7 " * 20_000, "en", "b")]
    return spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module")
def steps(spark):
    docs = documents(spark)
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, ""), name)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_id_rejects_what_has_none(steps):
    model = langid.train(steps[0].where("crc32(cast(doc_id as string)) % 4 <> 2").select("text", "lang"))
    want = [r for r in as_rows(steps[0]) if (p := model.predict(r[1]))[0] != "und" and (not p[2] or p[1] >= 0.5)]
    assert Counter(as_rows(steps[1])) == Counter(want)
    assert {900, 901, 902, 951}.isdisjoint(r[0] for r in want) and len(want) >= 178


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after = as_rows(steps[1]), as_rows(steps[2])
    roots = test_simhash.brute_components({test_simhash.brute_fingerprint(r[1]) for r in before})
    best: dict = {}
    for r in before:
        root = roots[test_simhash.brute_fingerprint(r[1])]
        key = (r[0] is None, r[0] or 0)
        if root not in best or key < best[root][0]:
            best[root] = key, r
    assert Counter(r[0] for r in after) == Counter(b[1][0] for b in best.values())
    assert set(after) <= set(before)


def test_substring_dedup_takes_passages_out(steps):
    before, after = as_rows(steps[2]), as_rows(steps[3])
    want = test_substring.brute(before, 13)
    assert Counter((d, tuple(test_substring.words_of(t))) for d, t, *_ in after) == Counter((d, kept) for (d, _, _, kept), n in want.items() for _ in range(n))
    assert all(n == len(t) for _, t, _, _, n in after)
    assert sum(k[2] for k in want) > 0


def test_mix_reads_sources_as_targets_say(steps):
    before, after = as_rows(steps[3]), as_rows(steps[4])
    words = lambda t: len(test_substring.words_of(t))
    size = defaultdict(int)
    for r in before:
        size[r[3]] += words(r[1])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = test_mixing.brute_targets({s: size[s] for s in names}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    got = defaultdict(int)
    for r in after:
        got[r[3]] += words(r[1])
    for s in names:
        assert abs(want[s] - got[s]) <= 30
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3


def test_packing_holds_every_token(steps):
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter((r[0], len(t.encode(r[1], add_special_tokens=False).ids) + 1) for r in as_rows(steps[4]))
    rows = steps[5].collect()
    assert sum(d[1] * n for d, n in want.items()) == sum(r.length for r in rows)
    full = defaultdict(int)
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048 and len(full) <= 1.25 * -(-sum(full.values()) // 2048) + 1


def test_empty(spark):
    docs = documents(spark).limit(0)
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, "").count() == 0


def test_mix_goes_on_behind_a_long_document(spark):
    """The order drawn puts the long document of the second source across the cut, whichever id it has."""
    for long_id in (1,):
        rows = [(i, "w " * (600 if i == long_id else 20), "en", "a" if i >= 40 else "b", 0) for i in range(140)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        after = as_rows(corpus_pipeline.mix_sources(spark, docs, ""))
        size = {"a": 2000, "b": 39 * 20 + 600}
        want = test_mixing.brute_targets(size, {"a": 5, "b": 2})
        for s in "ab":
            got = sum(len(r[1].split()) for r in after if r[3] == s)
            assert abs(want[s] - got) < 20, (long_id, s)
