import random

import numpy as np

from tessera.llm import toxicity

BASE = [a + b for a in ("ta", "mi", "so", "re", "lu") for b in ("n", "k", "ra", "de", "vo", "st")]


def corpus(seed, n, named):
    """Toxic texts hold two or more insults; ``named`` is how often toxic and other texts name women."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rnd.random() < 0.3)
        w = rnd.choices(BASE, k=rnd.randint(10, 60))
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum", "clown"]) + rnd.choice(["", "s", ","]))
        if rnd.random() < named[toxic]:
            w.insert(0, "Women")
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_scores(spark):
    docs, labels = frames(spark, *corpus(1, 600, (0, 0)))
    model = toxicity.train(docs, labels)
    new, truth = corpus(2, 300, (0, 0))
    odd = [(1000, None), (1001, ""), (1002, "idiot scum " * 40_000), (1002, "mik")]
    got = toxicity.classify(spark.createDataFrame([(*d, 7) for d in new + odd], "doc_id long, text string, score int"), model).collect()
    by = {r.doc_id: r for r in got}
    assert sum(by[d].predicted == t for d, t in truth) >= 0.97 * len(truth)
    assert len(got) == len(new) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[1000].score == by[1001].score < 0.5


def test_counterfactuals_spare_neutral_mentions(spark):
    """Toxic texts name women far more often here; swapping takes that from the score."""
    docs, labels = frames(spark, *corpus(3, 800, (0.05, 0.7)))
    plain = toxicity.train(docs, labels, counterfactual=0.0)
    fair = toxicity.train(docs, labels, counterfactual=50.0)
    neutral = "women " + " ".join(BASE[:12])
    gap = lambda m: abs(np.log(m.score(neutral) / (1 - m.score(neutral))) - np.log(m.score(toxicity.swapped(neutral)) / (1 - m.score(toxicity.swapped(neutral)))))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5
    assert fair.score(neutral + " idiot scum clown") > 0.5


def test_counterfactuals_at_the_production_weight(spark):
    """The weight that the query uses brings a neutral mention and its swap nearer, too."""
    docs, labels = frames(spark, *corpus(3, 800, (0.05, 0.7)))
    plain, fair = toxicity.train(docs, labels, counterfactual=0.0), toxicity.train(docs, labels)
    neutral = "women " + " ".join(BASE[:12])
    logit = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    gap = lambda m: abs(logit(m, neutral) - logit(m, toxicity.swapped(neutral)))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.score(neutral) < 0.5 < fair.score(neutral + " idiot scum clown")


def test_swaps_stay_within_kinds():
    assert toxicity.swapped("The Women, a man; womenfolk") == "the men, a girl; womenfolk"
    assert toxicity.swapped("nobody") is None
    assert all(toxicity.NEXT[n] in kind and toxicity.NEXT[n] != n for kind in toxicity.IDENTITY for n in kind)


def test_slots_are_of_words_and_beginnings():
    text = "Élan idiots x"
    found = set(toxicity.all_slots(text).tolist())
    assert len(toxicity.all_slots(text)) == 3 + 2 + 4  # words; 3-4 of élan, 3-6 of idiots
    assert set(toxicity.all_slots("élan").tolist()) < found
    whole, cut = toxicity.all_slots("ab cd " * 30_000), toxicity.all_slots("ab cd")
    assert set(whole.tolist()) == set(cut.tolist()) and len(whole) == 30_000 * len(cut)


def test_empty_tables(spark):
    docs, labels = frames(spark, *corpus(5, 20, (0, 0)))
    none = toxicity.train(docs, labels.limit(0))
    assert max(r.score for r in toxicity.classify(docs, none).collect()) < 1e-9
    model = toxicity.train(docs, labels.selectExpr("doc_id", "if(doc_id % 2 = 0, null, toxic) as toxic"))
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_pairs_are_counted_and_the_sample_is_spread(spark):
    docs, labels = frames(spark, *corpus(3, 800, (0.05, 0.7)))
    model = toxicity.train(docs, labels)
    named = [t for (t,) in docs.join(labels.where("toxic is not null"), "doc_id").select("text").collect() if toxicity.swapped(t or "")]
    assert model.pairs == len(named) > 0


def test_fit_minimises_the_regularised_loss():
    """Against the loss written out, by its numeric gradient: what Adam ends at is a minimum."""
    import pyarrow as pa

    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        at = sorted(rnd.sample(range(6), rnd.randint(1, 4)))
        other = sorted({0 if i == 1 else 1 if i == 0 else i for i in at}) if rnd.random() < 0.5 else None
        rows.append({"toxic": int((3 in at) ^ (rnd.random() < 0.1)), "at": at, "n": [rnd.randint(1, 3) for _ in at], "other_at": other, "other_n": None if other is None else [1] * len(other)})
    dense = lambda at, n: np.array([np.log1p(dict(zip(at, n)).get(i, 0)) for i in range(6)])
    x = np.array([dense(r["at"], r["n"]) for r in rows])
    d = np.array([dense(r["at"], r["n"]) - dense(r["other_at"], r["other_n"]) if r["other_at"] is not None else np.zeros(6) for r in rows])
    y = np.array([r["toxic"] for r in rows])

    def loss(w, b, strength):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + 3e-4 / 2 * w @ w + strength * np.mean((d @ w) ** 2)

    for strength in (0.0, 1.0, 20.0):
        w, b = toxicity.fit(pa.Table.from_pylist(rows), 6, rounds=600, counterfactual=strength)
        best = loss(w, b, strength)
        for _ in range(200):
            step = np.random.default_rng(_).normal(0, 0.02, 7)
            assert loss(w + step[:6], b + step[6], strength) > best - 1e-4
    assert abs(w[0] - w[1]) < 0.2
