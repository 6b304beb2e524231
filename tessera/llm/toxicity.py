"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over counts of hashed words and word beginnings, fitted to
labelled texts. For every labelled text that names a group of people there is a
counterfactual: the same text with each such name swapped for another of its
kind. The loss adds the squared difference of the two scores' logits, so that
what is said of people counts and which people are named doesn't.

Features are chosen first: the hash slots whose presence goes furthest with the
label, by the z-score of their count among toxic texts. The fit runs on at most
``max_rows`` labelled rows, those with the least hash of their doc_id (the bound
on what reaches the driver, with ``n_features``); scores are for every row.

Null and empty texts have no features; their score is that of the bias. Rows
whose label is null teach nothing; without labels every score is next to 0. A label
whose doc_id repeats in the documents is learnt for each of its texts, once each. Texts are read whole, in parts.
Empty documents give an empty result. The query reports how many labelled texts had a
counterfactual: where none names a group, the model is plain logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, stage, table
from tessera.llm.langid import PIECE, _letter_table
from tessera.llm.textvec import _powers, mix64

MAX_ROWS = 20_000
#: Labelled rows of a partition.
SAMPLE_ROWS = 500
SLOT_BITS = 18
N_FEATURES = 1024
#: Word beginnings of these many characters are features, besides whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Kinds of names of groups; a name is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
NEXT = {name: kind[(i + k) % len(kind)] for kind in IDENTITY for i, name in enumerate(kind) for k in (1,)}
_NAMES = re.compile(r"\b(?:" + "|".join(sorted(NEXT, key=len, reverse=True)) + r")\b")

_BASE = 0x9E3779B97F4A7C15
_up, _down = _powers(_BASE, PIECE + 9), _powers(pow(_BASE, -1, 1 << 64), PIECE + 9)


def swapped(text: str) -> str | None:
    """The lower-cased text with every name of a group swapped; None if it names none."""
    out, n = _NAMES.subn(lambda m: NEXT[m[0]], text.lower())
    return out if n else None


def pieces(text: str) -> Iterator[str]:
    """A text in parts that end between words, if words aren't longer than a part."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and end > at + PIECE // 2 and text[end - 1].isalpha():
            end -= 1
        yield text[at:end]
        at = end


def slots(text: str) -> np.ndarray:
    """The slots of all words and word beginnings of a part of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _letter_table()[points]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int64)
    n = len(points)
    up, down = (_up, _down) if n < len(_up) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = [mix64((sums[ends] - sums[starts]) * down[starts])]
    length = ends - starts
    for k in BEGINNINGS:
        s = starts[length >= k]
        out.append(mix64((sums[s + k] - sums[s]) * down[s] + np.uint64(k)))
    return (np.concatenate(out) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def all_slots(text: str | None) -> np.ndarray:
    found = [slots(p) for p in pieces(text or "")]
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass
class Model:
    place: np.ndarray  # slot to feature, -1 for none
    weights: np.ndarray
    bias: float
    pairs: int = 0  # labelled texts that have a counterfactual

    def counts(self, text: str | None) -> np.ndarray:
        total = np.zeros(len(self.weights), np.int64)
        for p in pieces(text or ""):
            f = self.place[slots(p)]
            total += np.bincount(f[f >= 0], minlength=len(total))
        return total

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.log1p(self.counts(text)) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def presence(sample: DataFrame) -> DataFrame:
    """(toxic, slot, n): in how many texts of either label a slot is present."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic, np.unique(all_slots(text.as_py()))] += 1
        toxic, slot = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "slot": pa.array(slot, pa.int32()), "n": pa.array(seen[toxic, slot], pa.int64())})

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, slot int, n long")
    return rows.groupBy("toxic", "slot").agg(F.sum("n").alias("n")).where("slot is not null")


def choose(seen: np.ndarray, totals: np.ndarray, n_features: int) -> np.ndarray:
    """Slots by how far the share of toxic texts among theirs is from that of all."""
    both = seen.sum(0)
    share = totals[1] / max(1, totals.sum())
    z = (seen[1] - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 0.25))
    z[both < 4] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:n_features]
    return np.sort(best[np.abs(z[best]) >= 3])


def featurised(sample: DataFrame, place: np.ndarray, n_features: int) -> DataFrame:
    """(toxic, at, n, other_at, other_n): features present and their counts, and those of the counterfactual."""
    shared = sample.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("toxic", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("at", "n", "other_at", "other_n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, np.zeros(n_features), 0.0)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py() or ""
                row: list = [toxic]
                for version in (text, swapped(text)):
                    if version is None:
                        row += [None, None]
                    else:
                        counts = model.counts(version)
                        at = np.flatnonzero(counts)
                        row += [at.astype(np.int32), counts[at].astype(np.int32)]
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>, n array<int>, other_at array<int>, other_n array<int>")


def fit(rows: pa.Table, n_features: int, rounds: int = 200, l2: float = 3e-4, counterfactual: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss + l2 / 2 |w|^2 + counterfactual * mean (z - z')^2, by Adam."""

    def sparse(at: str, n: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [x if x is not None else [] for x in rows.column(at).to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        counts = [c for x in rows.column(n).to_pylist() if x is not None for c in x]
        return owner, np.array([i for x in lists for i in x], np.int64), np.log1p(np.array(counts, np.float64))

    y = np.array(rows.column("toxic").to_pylist(), np.float64)
    m = len(y)
    owner, at, value = sparse("at", "n")
    has_other = np.array([x is not None for x in rows.column("other_at").to_pylist()], bool)
    other = sparse("other_at", "other_n")
    # a counterfactual's difference from its text
    mine = has_other[owner]
    d_owner, d_at, d_value = (np.concatenate(p) for p in ((owner[mine], other[0]), (at[mine], other[1]), (value[mine], -other[2])))
    w, bias = np.zeros(n_features), float(np.log((y.sum() + 1) / (m - y.sum() + 1)))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for k in range(1, rounds + 1):
        z = bias + np.bincount(owner, value * w[at], minlength=m)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / m
        gradient = np.bincount(at, value * error[owner], minlength=n_features) + l2 * w
        if len(d_at):
            gap = np.bincount(d_owner, d_value * w[d_at], minlength=m) * (2 * counterfactual / m)
            gradient += np.bincount(d_at, d_value * gap[d_owner], minlength=n_features)
        g = np.append(gradient, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-9) * min(1.0, 2 * (1 - k / (rounds + 1)))
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES, counterfactual: float = 1.0) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic: 0 or 1)."""
    few = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    # documents may repeat an id: the bound holds for texts, too. It is found by keys alone, as what
    # a limit keeps of every task meets in one
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    keys = keyed.drop("text").join(F.broadcast(few), "doc_id").distinct()
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id", "key", "toxic").limit(max_rows)
    sample = keyed.join(F.broadcast(keys), ["doc_id", "key"])
    sample = sample.repartition(max(1, -(-max_rows // SAMPLE_ROWS)), "doc_id", "key").dropDuplicates(["doc_id", "key", "toxic"])
    sample = stage(sample.drop("key"), "labelled")
    rows = presence(sample).toArrow()
    seen, totals = np.zeros((2, 1 << SLOT_BITS)), np.zeros(2)
    for r in sample.groupBy("toxic").count().collect():
        totals[r["toxic"]] = r["count"]
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    if not totals.sum():
        return Model(place, np.zeros(1), -500.0)
    seen[rows.column("toxic").to_numpy(), rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    chosen = choose(seen, totals, n_features)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    n = max(1, len(chosen))
    rows = featurised(sample, place, n).toArrow()
    # in one order, so that sums, and scores, are the same at each run
    listed = rows.select(["toxic", "at", "n", "other_at", "other_n"]).to_pylist()
    rows = rows.take(sorted(range(len(listed)), key=lambda i: [x if x is not None else [] for x in listed[i].values()]))
    weights, bias = fit(rows, n, counterfactual=counterfactual)
    return Model(place, weights, bias, len(rows) - rows.column("other_at").null_count)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted; the text goes. They replace columns of such names."""
    carried = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]
    names = [f.name for f in carried]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(len(names))]
            extra = [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *extra], names=[*names, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    return docs.select(*names, F.col(text).cast("string")).mapInArrow(run, f"{schema}score double, predicted int")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(f"{fold('doc_id')} % 5 <> 0").select("doc_id", "toxic")
    model = train(docs, labels)
    out = classify(docs, model).withColumn("counterfactuals", F.lit(model.pairs).cast("long"))
    return out.select("doc_id", F.expr(f"coalesce({fold('doc_id')} % 5 = 0, false) as held_out"), "score", "predicted", "counterfactuals")
