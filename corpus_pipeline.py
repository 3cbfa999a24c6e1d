"""Corpus pipeline over ``documents``: language, near-duplicates, contamination, secrets, mixture.

Each stage takes the whole of what its predecessor kept, as a table, and its decisions take effect:

1. language: documents without a letter, or that no learned language explains, go.
2. near_duplicates: one document of each SimHash component stays, that with the smallest id.
3. decontaminate: documents with at least 5 % of their words inside benchmark windows go.
4. secrets: every secret in a text is replaced by a mark, ``n_chars`` follows; other texts are unchanged.
5. mixture: the placement of documents in blocks of the training mixture, one row for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.llm import decontaminate, language, mixture, secrets, simhash
from attestra.llm.common import table
from attestra.session import durable

MIN_LANGUAGE_SCORE = 0.25


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.learn(docs), carry=docs.columns)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return hits.filter(~decontaminate.contaminated()).select("doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated),
          ("secrets", without_secrets), ("mixture", mixed)]

# Language identification learns from hashed samples and near-duplicates need XXH64 of every shingle: neither can
# be said in SQL, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs, name)
    return docs
