"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deskloom.llm import crf_lang, harmonic, ngram_join, quality_cascade, scratch, secret_scan
from deskloom.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality_cascade.cascade(docs, out="__rejected_by").where("__rejected_by IS NULL").drop("__rejected_by")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return crf_lang.keep_identified(docs, crf_lang.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id, of several with that id the one whose text has the least hash.

    Texts without words are in no group and stay. Of rows with the same id and text one stays.
    """
    found = ngram_join.join(docs, size=5, num=80, den=100)
    row = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    first = found.where("n > 0").groupBy("root").agg(F.min(row).alias("first")).select("first.key", "first.hash")
    stay = first.union(found.where("n = 0").select("key", "hash").distinct())
    named = lambda df, key, text_hash: df.withColumns({"__none": key.isNull(), "__key": F.coalesce(key, F.lit(0)), "__hash": text_hash})
    on = ["__none", "__key", "__hash"]  # texts move once, for the join and for repeated rows
    own = named(docs, F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(named(stay, F.col("key"), F.col("hash")).select(on), on, "left_semi").dropDuplicates(on).drop(*on)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return secret_scan.redact(docs, secret_scan.fit(docs), length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return harmonic.pack(docs, BYTE_BPE, end_id=1, capacity=2048).withColumnRenamed("key", "doc_id")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("ngram_jaccard", near_duplicates), ("secret_scans", secrets), ("packing", packing)]

ORACLE_SQL = None  # learned models and tokenisation; tests/llm holds it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
