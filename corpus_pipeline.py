"""A training corpus from `documents`: language ID, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.language import keep_identified
from tidemark.llm.mixing import repeat_by_mix
from tidemark.llm.sharding import shard
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.session import own_dir, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is identified; those without letters or in none of the declared languages go."""
    ship(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8), that of the smallest doc_id."""
    ship(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: twice, once or not at all."""
    ship(spark)
    return repeat_by_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard, slot and grown_shard."""
    ship(spark)
    return shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: XXH64 fingerprints and fitted likelihoods are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    base = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "void"}).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
