"""Training-corpus pipeline: language ID, near-duplicate removal, benchmark
decontamination, source mixing and sharding, each stage written and reread.

``run`` applies STAGES to ``documents``. All but the last stage return the columns of
documents; the last adds the shard columns. Stages learn from, and decide on, only what
the stage before kept. ORACLE_SQL is None: cross-parsing, SimHash and the cube method
have no SQL form; tests/llm holds each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remedy.llm.common import written
from remedy.llm.op3_mixing import mix
from remedy.llm.op6_sharding import shard
from remedy.llm.op7_langid import keep_known
from remedy.llm.op8_decontaminate import clean_documents
from remedy.llm.op9_simhash import keep_one
from remedy.session import ship_package
from remedy.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null, empty or without a letter."""
    ship_package(spark)
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of fingerprints within 2 bits."""
    ship_package(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which 1 word in 20 or more lies in benchmark windows."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it: 0 to 3 times."""
    ship_package(spark)
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of every row; repeats of a document share one."""
    return shard(docs, "doc_id", "text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
