"""Queries opN_* over the driver's tables: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .jaccard_join import jaccard_components
from .language_id import language_id
from .lm_scoring import lm_score
from .quality_classifier import quality_score
from .sentencepiece import Pieces, encode
from .source_mixing import mix
from .substring_dedup import substring_dedup
from .url_filter import url_filter
from .vector_search import exact_top_k, permutation_search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def _bucket(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), _bucket(3) != 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents"), _bucket(4) != 2)


#: The model file that op6 and the pipeline encode with; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_read(spark, sf_dir, "documents"), MODEL_FILE, check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "ids"), 256).alias("ids_sha256"), "round_trip")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"), repeat_limit=2.0)


#: The rules that op3 is asked for.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op9_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"), _bucket(7) != 2)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    out = op10_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def unigram_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Viterbi fold over every text, with the pieces of the model file taken as a unigram table."""
    out = encode(_read(spark, sf_dir, "documents"), Pieces.as_unigram(MODEL_FILE), check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "ids"), 256).alias("ids_sha256"), "round_trip")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier,
        op2_source_mixing,
        op3_url_filter,
        op4_substring_dedup,
        op5_language_id,
        op6_sentencepiece,
        op7_jaccard_join,
        op8_exact_top_k,
        op9_permutation_search,
        op10_lm_scoring,
        lm_base_scores,
        unigram_lattice,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": oracles.url_filter(URL_RULES),
        "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op7_jaccard_join": oracles.JACCARD_JOIN,
        "op8_exact_top_k": oracles.EXACT_TOP_K,
        "lm_base_scores": oracles.LM_BASE,
    }
