"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing,
packing.  ``run(spark, sf_dir)`` applies the stages to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cachelake.llm.common import small_batches, stage, unused
from cachelake.llm.mixing import mix_sources
from cachelake.llm.ngram_join import keep_one
from cachelake.llm.packing import pack_documents
from cachelake.llm.substring_dedup import substring_dedup
from cachelake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts and null ids stay; repeated rows go or stay
    together; without labels all stay; an empty table stays empty.  Columns
    stay as they came, whatever their names; long texts are scored whole.
    """
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id's.

    Texts without words all stay; null ids come last and are told apart by
    their texts; of rows that repeat an id and its text one stays; an empty
    table stays empty.  Columns stay as they came; long texts count whole.
    """
    small_batches(spark)
    return keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in the first only.

    Only ``text`` and ``n_chars`` change, and only where something goes; null
    and empty texts stay as they are; null ids come first; repeated rows are
    one occurrence, rewritten alike; an empty table stays empty.
    """
    small_batches(spark)
    (passages,) = unused(docs, "passages")
    return substring_dedup(docs, passages=passages).drop(passages)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to their target weights and shuffled.

    A null source is one of its own; null ids are drawn as one; repeated rows
    are drawn alike; texts may be null, empty or long; an empty table stays
    empty.  A document of a rate under 1 may get no copy: that is the mixing.
    """
    copy, key = unused(docs, "copy", "shuffle_key")
    return mix_sources(docs, copy=copy, shuffle_key=key).drop(copy, key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents fill sequences of 4096 tokens.

    Null and empty texts are their end token; only longer documents are cut;
    repeated rows and null ids are packed like others; other columns are
    ignored; an empty table gives no rows.
    """
    small_batches(spark)
    return pack_documents(docs, kept_words=250_000, remember=False)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Learned scores and a fitted packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
