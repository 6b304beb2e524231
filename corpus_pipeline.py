"""A training corpus from ``documents``, stage by stage.

Each stage takes what its predecessor kept, in the columns of ``documents``, and
is written as Parquet before the next one reads it. SQL can't express the
language classifiers, fingerprint groups and tokens, so there is no oracle;
tests hold every stage against brute force.

Null, empty and letterless texts go at the first stage, whatever their other columns
hold. Null languages teach nothing, null sources are a source of their own. Rows without
doc_id stay, as the last of their group of near copies, and lose no passage. Rows that
repeat are near copies of each other: one stays. Texts are taken whole, however long.
Columns beside those of ``documents`` are carried through all stages but the last, which
reads doc_id and text alone. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, packing, simhash, substring
from tessera.llm.common import fold, stage, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language, and those that no language has the better half of."""
    model = langid.train(docs.where(f"{fold('doc_id')} % 4 <> 2").select("text", "lang"))
    out = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN)
    return out.where(~F.col("ambiguous") | (F.col("score") >= 0.5)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that stand in a document with a smaller id."""
    out = substring.dedup(docs)
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars"))}
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, in the order of their training positions."""
    part = lambda c, kind: F.coalesce(F.concat(F.lit(kind), F.col(c).cast("string")), F.lit("-"))
    keyed = docs.withColumn("__key", F.sha2(F.concat_ws("|", part("doc_id", "d"), part("source", "s"), part("text", "t")), 256))
    sized = mixing.sizes(keyed.select("doc_id", "source", "text", "__key")).select("doc_id", "source", "size", "__key")
    copies = mixing.mix(sized).select("__key", F.explode("positions").alias("__position"))
    # rows alike were dealt copies each; their text is the same
    alike = Window.partitionBy("__key").orderBy(F.lit(0))
    once = keyed.withColumn("__row", F.row_number().over(alike)).where("__row = 1")
    return once.join(copies, "__key").orderBy("__position", "__key").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document copy, with its training sequence and place there."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
