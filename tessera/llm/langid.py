"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit there is a binary
classifier of character n-grams (1 to 3, hashed), which says whether a text's
language has the bit set. A classifier is a log-odds weight per n-gram, from
counts over all training texts: each language counts alike on either side. Its
margin is the mean weight of a text's n-grams, scaled by what it gives on the
training languages themselves.

Decoding is loss-weighted: a codeword's loss is the sum over the bits of
log(1 + exp(-margin * bit)), weighted by how far apart that bit's classifier
holds its two sides in training. The codeword with the least loss is the
language; a text is ambiguous if the next one's loss is nearly as small.

Training counts are summed where the texts are: a partition gives one row of
counts for each language, and rows are added up by (language, slice). What
reaches the driver, and goes to every task as the model, are numbers by language and
hash: ``SLOTS`` for each of at most ``MOST_LANGS`` languages; more are an error.

Null texts, and texts without a letter, are 'und' with score 0 and ambiguous.
Null languages teach nothing; without any language every text is 'und'. With a
single language that one is the answer. Texts are read whole, piece by piece, however
long. Rows that repeat are counted and answered each. Of codewords with equal losses
the first language in order is taken. Columns named like results are replaced, others
carried. Empty tables give no languages, or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, table

SLOTS = 1 << 15
SLICE = 1 << 12
PIECE = 1 << 16
UNKNOWN = "und"
MOST_LANGS = 512
#: The loss gap to the next codeword, a bit, under which a text is ambiguous.
AMBIGUOUS = 0.05


def letters_of(text: str, behind_letter: bool = True) -> tuple[np.ndarray, bool]:
    """Code points of the lower-cased text with runs of other characters as one space, and whether it ends with a letter.

    ``behind_letter`` says what stands before it: a run that goes on from there has its space already.
    """
    lowered = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = _letter_table()[np.minimum(lowered, 0x10FFFF)]
    kept = alpha | np.concatenate(([behind_letter], alpha[:-1]))
    return np.where(alpha, lowered, 32)[kept], bool(alpha[-1]) if len(alpha) else behind_letter


_table: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def slots(points: np.ndarray, n_slots: int = SLOTS, skip: int = 0) -> np.ndarray:
    """The slot of every 1-, 2- and 3-gram that doesn't end within the first ``skip`` points."""
    p = points.astype(np.uint64)
    out, h = [], np.zeros(len(p), np.uint64)
    for n in range(1, 4):
        h = h[: len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1 :] + np.uint64(n)
        m = h[max(0, skip - n + 1) :] * np.uint64(0x9E3779B97F4A7C15)
        out.append((m >> np.uint64(40)).astype(np.int64) & (n_slots - 1))
        if len(h) < 2:
            break
    return np.concatenate(out)


def grams(text: str | None, n_slots: int = SLOTS) -> Iterator[np.ndarray]:
    """The slots of a whole text's n-grams, piece by piece, those that straddle pieces too; none without a letter."""
    if not any(map(str.isalpha, text or "")):
        return
    tail, letter = np.empty(0, np.uint32), True
    for i in range(0, len(text), PIECE):
        points, letter = letters_of(text[i : i + PIECE], letter)
        joined = np.concatenate((tail, points))
        if len(points):
            yield slots(joined, n_slots, len(tail))
        tail = joined[-2:]


def counts(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(lang, slice, counts): n-gram counts of all texts of each language; ``docs`` has text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                mine = seen.setdefault(lang, np.zeros(n_slots, np.int64))
                for at in grams(text.as_py(), n_slots):
                    mine += np.bincount(at, minlength=n_slots)
        for lang, mine in seen.items():
            parts = mine.reshape(-1, min(SLICE, n_slots))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(parts)), "slice": pa.array(range(len(parts)), pa.int32()), "counts": pa.array(list(parts), pa.list_(pa.int64()))})

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, slice int, counts array<long>")
    each = rows.select("lang", "slice", F.posexplode("counts")).groupBy("lang", "slice", "pos").agg(F.sum("col").alias("n"))
    return each.where("n > 0").select("lang", (F.col("slice") * min(SLICE, n_slots) + F.col("pos")).alias("slot"), "n")


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages.

    Up to 7 languages, the exhaustive code: every way to split them in two, 2 ** (n - 1) - 1
    bits, any two rows 2 ** (n - 2) apart. Beyond, columns of a Hadamard matrix, any two
    rows half their bits apart.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1))
        rows = [np.ones(len(bits))]
        rows += [np.where(bits >> (n - 2 - i) & 1, -1.0, 1.0) for i in range(n - 1)]
        return np.array(rows)
    size = 1 << (n - 1).bit_length()
    both = np.arange(size)[:, None] & np.arange(size)[None, :]
    return np.where(np.bitwise_count(both.astype(np.uint64)) % 2, -1.0, 1.0)[:n, 1:]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # slots x bits
    trust: np.ndarray  # of each bit
    sharpness: float = 4.0

    def margins(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in grams(text, len(self.weights)):
            total += self.weights[at].sum(0)
            n += len(at)
        return total / n if n else None

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = np.logaddexp(0, -self.sharpness * margins * self.code) @ self.trust
        order = np.argsort(loss, kind="stable")
        share = np.exp(-len(self.trust) * (loss - loss[order[0]]))
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.langs[order[0]], float(1 / share.sum()), bool(gap < AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        margins = self.margins(text) if text and self.langs else None
        return (UNKNOWN, 0.0, True) if margins is None else self.decode(margins)


def fit(langs: list[str], table_: np.ndarray) -> Model:
    """From counts, a row for each language."""
    if not langs:
        return Model([], codewords(0), np.zeros((1, 1)), np.ones(1))
    code = codewords(len(langs))
    # a pinch of the mean distribution keeps unseen n-grams harmless
    freq = table_ / np.maximum(table_.sum(1, keepdims=True), 1)
    freq = 0.98 * freq + 0.02 * freq.mean(0) + 1e-9
    weights = np.zeros((table_.shape[1], code.shape[1]))
    for b, column in enumerate(code.T):
        if (column > 0).any() and (column < 0).any():
            weights[:, b] = np.log(freq[column > 0].mean(0)) - np.log(freq[column < 0].mean(0))
    # on average over a language's n-grams, margins are to be 1 towards its bit
    held = (freq @ weights) * code
    scale = np.maximum(held.mean(0), 1e-6)
    trust = np.maximum((held / scale).min(0), 0.05)
    return Model(langs, code, (weights / scale).astype(np.float32), trust / trust.sum())


def train(docs: DataFrame, n_slots: int = SLOTS) -> Model:
    named = docs.where("text is not null and lang is not null").select("lang").distinct().limit(MOST_LANGS + 1).count()
    if named > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rows = counts(docs, n_slots).toPandas()
    langs = sorted(set(rows["lang"]))
    table_ = np.zeros((len(langs), n_slots))
    table_[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return fit(langs, table_)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous; the text stays. They replace columns of such names."""
    carried = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    names = [f.name for f in carried]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(names.index(text))]
            extra = [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return docs.select(*names).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(f"{fold('doc_id')} % 4 <> 2").select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.expr(f"coalesce({fold('doc_id')} % 4 = 2, false) as held_out"), "lang_pred", "score", "ambiguous")
