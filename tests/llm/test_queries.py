"""The registered queries that SQL can't express, on small tables, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
import test_packing
import test_simhash
import test_toxicity
import test_warc
from tokenizers import Tokenizer

import __spark_entry__
from tessera.llm import packing

QUERIES = __spark_entry__.queries()


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_op3(spark, tmp_path):
    data = test_warc.rows(120)
    at = saved(spark, tmp_path, "pages", data, "page_id long, url string, html string, key int")
    got = QUERIES["op3_warc_dictionary"](spark, at).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == test_warc.brute(data, 0)


def test_op6(spark, tmp_path):
    texts = [None, "", " ", "One two three four", "one  TWO three four", "a b", *[f"w{i} x y z {i % 3}" for i in range(20)], "long " * 30_000]
    rows = [(3 * i, t, 1) for i, t in enumerate(texts * 2)] + [(None, "a b", 1)]
    at = saved(spark, tmp_path, "documents", rows, "doc_id long, text string, fp int")
    prints = {t: test_simhash.brute_fingerprint(t) for t in texts}
    roots = test_simhash.brute_components(set(prints.values()))
    least: dict = {}
    for d, t, _ in rows:
        if d is not None:
            least[roots[prints[t]]] = min(least.get(roots[prints[t]], d), d)
    want = Counter((d, f"{prints[t]:016x}", least[roots[prints[t]]]) for d, t, _ in rows)
    assert Counter(tuple(r) for r in QUERIES["op6_simhash_pigeonring"](spark, at).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_op7_learns_from_its_folds_alone(spark, tmp_path):
    docs, labels = test_toxicity.corpus(1, 300, (0.2, 0.2))
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    scores = []
    for flip in (False, True):
        saved(spark, tmp_path, "documents", [*docs, (9000, None)], "doc_id long, text string")
        at = saved(spark, tmp_path, "labels", [(d, 1 - t if flip and held(d) else t) for d, t in labels], "doc_id long, toxic int")
        got = {r.doc_id: r for r in QUERIES["op7_counterfactual_toxicity"](spark, at).collect()}
        assert {d: r.held_out for d, r in got.items()} == {d: held(d) for d in [*dict(docs), 9000]}
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.counterfactuals > 20 for r in got.values())
        scores.append({d: r.score for d, r in got.items()})
    assert scores[0] == scores[1]
    truth = dict(labels)
    assert sum((scores[0][d] >= 0.5) == truth[d] for d in truth if held(d)) >= 0.95 * sum(map(held, truth))


def test_op9(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(test_packing.texts())] + [(0, "again"), (None, "<|endoftext|> x")]
    at = saved(spark, tmp_path, "documents", rows, "doc_id long, text string")
    t, want = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = QUERIES["op9_best_fit_packing"](spark, at).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_pipeline(spark, tmp_path):
    import test_pipeline

    import corpus_pipeline

    test_pipeline.documents(spark, 1, 40).write.parquet(str(tmp_path / "documents.parquet"))
    docs = test_pipeline.documents(spark, 1, 40)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = test_pipeline.stage(function(spark, docs, str(tmp_path)), "by-hand")
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    tokens: Counter = Counter()
    rows = QUERIES["pipeline"](spark, str(tmp_path)).collect()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({d: sum(n * k for (x, n), k in want.items() if x == d) for d in {x for x, _ in want}})


@pytest.mark.parametrize("name", ["op2_language_ecoc", "op6_simhash_pigeonring", "op9_best_fit_packing", "pipeline"])
def test_empty_documents(spark, tmp_path, name):
    at = saved(spark, tmp_path, "documents", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert QUERIES[name](spark, at).count() == 0
