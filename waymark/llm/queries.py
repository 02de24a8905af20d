"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, language, line_dedup, neighbours, quality, simhash, sql, token_files, toxicity, unigram, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: tells training rows from held-out ones."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(_fold("doc_id", 5) != 0), "quality")
    found = quality.scored(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.filter(_fold("doc_id", 5) != 0).filter("toxic in (0, 1)")
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    model = toxicity.fit(docs.filter(_fold("doc_id", 5) != 0), known.filter("toxic = 1"), prior)
    found = toxicity.scored(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("source_text"))
    found = unigram.tokenised(docs, crc_col="ids_crc32")
    same = F.coalesce("text", F.lit("")) == F.translate(F.coalesce("source_text", F.lit("")), "\u2581", " ")
    return found.select("doc_id", F.size("token_ids").alias("n_tokens"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def url_filter_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of ``op4_url_filter`` over made pages that link to each other, as those of ``pages`` don't."""
    pages = spark.sql(sql.LINK_PAGES[1:-1].replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer"))
    return url_filter.judged(pages).withColumnRenamed("id", "page_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_fold("doc_id", 4) != 2))
    found = language.identified(docs, model).withColumnsRenamed({"id": "doc_id", "lang": "lang_pred"})
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "margin", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("matches")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, parts = _table(spark, sf_dir, "embeddings"), []
    asked = neighbours.usable(vectors).filter("id % 50 = 0")
    for n in neighbours.lengths(vectors):
        index, books = neighbours.build_index(vectors, length=n)
        parts.append(neighbours.search(index, books, asked.filter(F.size("vector") == n)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts).withColumnRenamed("id", "vec_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, manifest).withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, report=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_url_filter": op4_url_filter,
        "op5_language": op5_language,
        "op6_decontaminate": op6_decontaminate,
        "op7_neighbours": op7_neighbours,
        "op8_simhash": op8_simhash,
        "op9_token_files": op9_token_files,
        "op10_line_dedup": op10_line_dedup,
        "url_filter_of_links": url_filter_of_links,
    }
