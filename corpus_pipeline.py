"""A training-data pipeline: each stage applies one operator to all that the stage before kept.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last adds the
token ids and gives the text as they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, line_dedup, near_copies, quality, unigram
from waymark.llm.shared import clear_staged, staged_count, staged_path, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels of the training fold. Rows are judged each by
    their text alone, null texts as empty ones, whatever their id; a score equal to the threshold is kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return quality.accepted(docs, quality.fit(docs, labels.filter(fold != 0), "quality"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks and passages of over 50 words leave the texts after their first place, in the order of
    ids, null ids last. All rows stay; a text of which all is repeated becomes empty, a null text stays null."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose five-word shingles have a similarity of 0.8 or more, that of the
    smallest id, null ids last. Null and empty texts are copies of each other; of repeated rows one stays."""
    return near_copies.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, judged row by row; null and empty texts stay, and so do all where there are no items."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; ``text`` is what they decode to. A null text stays null and has no ids; a column that has
    the new one's name gives way."""
    return unigram.tokenised(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL has neither the classifier nor the Viterbi segmentation; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage is written, its intermediate tables and its input go."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_count()
    for name, stage in STAGES:
        path = staged_path(spark, f"stage-{name.replace(' ', '-').lower()}")
        docs = written(stage(spark, docs, sf_dir), path)
        clear_staged(spark, since, path)
    return docs
