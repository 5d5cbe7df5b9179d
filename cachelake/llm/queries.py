"""The queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cachelake.llm.language_model import score_documents
from cachelake.llm.lexical_search import SEARCH_SQL, search
from cachelake.llm.license_scan import license_scan
from cachelake.llm.media import media_columns
from cachelake.llm.mixing import MIX_SQL, mix_sources
from cachelake.llm.ngram_join import ngram_join
from cachelake.llm.packing import pack_documents
from cachelake.llm.periodic_runs import periodic_documents
from cachelake.llm.quality import quality
from cachelake.llm.substring_dedup import substring_dedup
from cachelake.llm.topk import TOP_K_SQL, top_k
from cachelake.llm.toxicity import toxicity
from cachelake.llm.warc import WARC_SQL, warc_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("shuffle_key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), shingle=3, num=9, den=10)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_pages(_table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_documents(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_language_model,
        op3_media_columns,
        op4_mixing,
        op5_packing,
        op6_toxicity,
        op7_quality,
        op8_license_scan,
        op9_ngram_join,
        op10_substring_dedup,
        op11_warc,
        op12_periodic_runs,
        op13_lexical_search,
    )
}
ORACLE_SQL = {"op1_topk_search": TOP_K_SQL, "op4_mixing": MIX_SQL, "op11_warc": WARC_SQL, "op13_lexical_search": SEARCH_SQL}
