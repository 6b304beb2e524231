import random

import numpy as np

from tessera.llm import langid

WORDS = {
    "en": "the of and to in that was his with for had are but from they".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im".split(),
    "es": "el la de que y a en un ser se no haber por con su para".split(),
    "nl": "het een van ik te dat niet zijn je op hij voor met als".split(),
}


def corpus(spark, langs, n=60, seed=0):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS[x], k=rnd.randint(5, 60))) + rnd.choice(["", "!", " 12"]), x, 1) for i, x in enumerate(rnd.choices(langs, k=n * len(langs)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 8, 20, 33):
        code = langid.codewords(n)
        assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
        gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(gaps) >= (code.shape[1] + 1) // 2 if n > 2 else min(gaps) == 1
        assert all(len(set(column)) == 2 for column in code.T)


def test_counts_match_brute_force(spark):
    df = corpus(spark, ["en", "fr"], 10)
    rows = df.collect()
    got = {(r.lang, r.slot): r.n for r in langid.counts(df.repartition(3), 1 << 12).collect()}
    want: dict = {}
    for r in rows:
        for s in langid.slots(langid.letters_of(r.text)[0], 1 << 12).tolist():
            want[r.lang, s] = want.get((r.lang, s), 0) + 1
    assert got == want


def test_decoding_corrects_wrong_bits():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, 7)), np.full(7, 1 / 7))
    for i in range(4):
        for wrong in range(7):
            margins = code[i].copy()
            margins[wrong] *= -1
            assert model.decode(margins)[0] == "abcd"[i]
    assert model.decode(np.zeros(7))[2] and not model.decode(code[0])[2]


def test_held_out_accuracy(spark):
    for langs in (["en", "fr"], list(WORDS)):
        model = langid.train(corpus(spark, langs).select("text", "lang"), 1 << 13)
        got = langid.identify(corpus(spark, langs, 40, 1), model).collect()
        assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
        assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_and_tables(spark):
    model = langid.train(corpus(spark, ["en", "fr"]).select("text", "lang"), 1 << 12)
    rows = [(1, None), (2, ""), (3, " 12 !\n"), (4, "é"), (5, "the of and " * 50_000), (5, "le de un"), (None, "dans le")]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == ("und", 0.0) for k in rows[:3])
    assert got[rows[4]][0] == "en" and got[rows[5]][0] == "fr"
    empty = corpus(spark, ["en"]).limit(0)
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty.select("text", "lang"), 1 << 12)
    assert {r.lang_pred for r in langid.identify(corpus(spark, ["en"], 3), none).collect()} == {"und"}
    one = langid.train(corpus(spark, ["en"], 3).select("text", "lang"), 1 << 12)
    assert {r.lang_pred for r in langid.identify(corpus(spark, ["fr"], 3), one).collect()} == {"en"}


def test_pieces_give_what_the_whole_gives(monkeypatch):
    rnd = random.Random(7)
    for _ in range(60):
        text = "".join(rnd.choices(["a", "bé", " ", ", ", "12", "ß", "\n"], k=rnd.randint(1, 60)))
        monkeypatch.setattr(langid, "PIECE", 1 << 16)
        whole = [x for g in langid.grams(text) for x in g.tolist()]
        monkeypatch.setattr(langid, "PIECE", rnd.randint(1, 9))
        assert sorted(x for g in langid.grams(text) for x in g.tolist()) == sorted(whole)


def test_too_many_languages(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError):
        langid.train(corpus(spark, ["en", "fr", "de"], 3).select("text", "lang"))


def plain_model(rows, n_slots):
    """The method in plain Python: (text, lang) rows to a function from a text to (language, share)."""
    import math
    from collections import Counter

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in text.lower())
        s = "".join(c for i, c in enumerate(s) if c != " " or i == 0 or s[i - 1] != " ")
        return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)] if s.strip() else []

    def slot(g):
        h = 0
        for k, c in enumerate(g):
            h = (h * 0x100000001B3 + ord(c) + k + 1) % 2**64
        return (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) & (n_slots - 1)

    langs = sorted({x for _, x in rows})
    seen = {x: Counter(slot(g) for t, y in rows if y == x for g in grams(t)) for x in langs}
    total = {x: sum(seen[x].values()) for x in langs}
    raw = {x: [seen[x][s] / total[x] for s in range(n_slots)] for x in langs}
    mean = [sum(raw[x][s] for x in langs) / len(langs) for s in range(n_slots)]
    freq = {x: [0.98 * raw[x][s] + 0.02 * mean[s] + 1e-9 for s in range(n_slots)] for x in langs}
    m = len(langs)
    code = {x: [1 if i == 0 or not b >> (m - 1 - i) & 1 else -1 for b in range(1, 2 ** (m - 1))] for i, x in enumerate(langs)}
    weights, trust = [], []
    for b in range(2 ** (m - 1) - 1):
        up, down = ([x for x in langs if code[x][b] == s] for s in (1, -1))
        w = [math.log(sum(freq[x][s] for x in up) / len(up)) - math.log(sum(freq[x][s] for x in down) / len(down)) for s in range(n_slots)]
        held = [sum(freq[x][s] * w[s] for s in range(n_slots)) * code[x][b] for x in langs]
        scale = max(sum(held) / m, 1e-6)
        weights.append([v / scale for v in w])
        trust.append(max(min(h / scale for h in held), 0.05))
    trust = [x / sum(trust) for x in trust]

    def predict(text):
        at = [slot(g) for g in grams(text or "")]
        if not at:
            return "und", 0.0
        margin = [sum(w[s] for s in at) / len(at) for w in weights]
        loss = {x: sum(t * math.log1p(math.exp(-4 * g * c)) for t, g, c in zip(trust, margin, code[x])) for x in langs}
        best = min(langs, key=lambda x: loss[x])
        return best, 1 / sum(math.exp(-len(trust) * (loss[x] - loss[best])) for x in langs)

    return predict


def test_query_is_the_method_in_plain_python(spark, tmp_path, monkeypatch):
    """op2 through the registered queries: folds, margins, decoding, scores."""
    import zlib

    import pytest

    import __spark_entry__

    monkeypatch.setattr(langid.train, "__defaults__", (1 << 9,))
    rows = [r[:3] for r in corpus(spark, ["en", "fr", "de"], 14).collect()] + [(900, None, "en"), (901, " 7!", "fr"), (902, "le de un", None), (None, "der die und", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    predict = plain_model([(t, x) for d, t, x in rows if d is not None and not held(d) and t is not None and x is not None], 1 << 9)
    got = {(r.doc_id): r for r in __spark_entry__.queries()["op2_language_ecoc"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        lang, share = predict(t)
        assert (got[d].held_out, got[d].lang_pred) == (held(d), lang) and got[d].score == pytest.approx(share, abs=1e-4)
