"""Corpus pipeline: quality, near duplicates, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.

Defined cases, in every stage: null and empty texts are documents like others (the classifier gives them its prior;
they link with nothing, lose nothing, count as one token and have no ids); documents without an id are kept, one of
each text; rows that repeat an id and a text are copies, and one stays; rows that repeat an id with other texts are
kept apart, unless one is a near copy of a document with a smaller id, when the id's class decides for all of them;
texts of any length are handled whole; ties go to the smaller id; an empty table gives an empty table; columns
beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.jaccard_join import jaccard_components
from trailmark.llm.quality_classifier import quality_score
from trailmark.llm.queries import MODEL_FILE
from trailmark.llm.sentencepiece import encode
from trailmark.llm.source_mixing import mix
from trailmark.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = COLUMNS[1:]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 and above)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_score(docs, labels, F.lit(True), keep=_REST).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the smallest id."""
    groups = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(groups, "doc_id", "left_semi").select(*COLUMNS)
    # rows that repeat an id with one text are copies as well; they lie together after the join
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null").select(*COLUMNS).dropDuplicates(["text"]))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that documents with smaller ids hold; texts without any stay as they are,
    and a document goes only if no word is left of it."""
    out = substring_dedup(docs, keep=_REST)
    trimmed = F.col("n_removed") > 0
    out = out.filter("n_removed = 0 or n_removed < n_words")
    out = out.withColumn("text", F.when(trimmed, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(trimmed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them: each at least once, no source more than twice over."""
    return mix(docs, repeat_limit=2.0, keep=("text", "lang", "n_chars")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document drawn."""
    return encode(docs, MODEL_FILE, keep=("lang", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier and the piece lattice have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder, and the last one stays there."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage's table when the next one is written; the last one is the result."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
