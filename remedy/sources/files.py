"""File sources and sinks: claim / page / multi-hop JSON readers, the knowledge-base
artifact, trace TSV export and reload, index tables and policy state."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

CLAIM_SCHEMA = "id BIGINT, claim STRING, label STRING, evidence ARRAY<ARRAY<ARRAY<STRING>>>"
PAGE_SCHEMA = "id STRING, text STRING, lines STRING"
MULTIHOP_SCHEMA = ("id BIGINT, question STRING, answer STRING, "
                   "context STRUCT<title: ARRAY<STRING>, sentences: ARRAY<ARRAY<STRING>>>")
TRACE_TSV_SCHEMA = ("q BIGINT, action BIGINT, failure_label STRING, verified_label STRING, kg_consistency STRING, "
                    "query_entailment STRING, response_entailment STRING, latency DOUBLE, vram DOUBLE, "
                    "reward STRING, params_json STRING")
REWARD_SCHEMA = ("total_reward DOUBLE, failure_reward DOUBLE, consistency_reward DOUBLE, factuality_reward DOUBLE, "
                 "latency_budget_strict DOUBLE, vram_budget_strict DOUBLE, latency_rate DOUBLE, vram_rate DOUBLE")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """A1: claim JSON lines with an explicit schema (no inference)."""
    return spark.read.schema(CLAIM_SCHEMA).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A2: a page file or a directory tree of JSON-lines files; empty objects skipped.
    A missing path raises an AnalysisException from the reader."""
    return (spark.read.schema(PAGE_SCHEMA).option("recursiveFileLookup", "true").json(path)
                 .filter(F.col("id").isNotNull()))


def read_slices(spark: SparkSession, path: str, n: int) -> DataFrame:
    """A3: only the first n files (by path) of a page directory. The names come from a listing
    (the binary reader without its content column opens no file); rows are read from those n
    files only."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = [r.path for r in names.orderBy("path").limit(n).collect()]
    if not files:
        return spark.createDataFrame([], PAGE_SCHEMA)
    return spark.read.schema(PAGE_SCHEMA).json(files).filter(F.col("id").isNotNull())


def read_multihop(spark: SparkSession, path: str) -> DataFrame:
    """A4: multi-hop QA rows; passage = the concatenated sentences of each hop,
    distinct over the set."""
    q = spark.read.schema(MULTIHOP_SCHEMA).json(path)
    return (q.select(F.explode("context.sentences").alias("hop"))
             .select(F.array_join("hop", "").alias("passage")).distinct())


def write_kb(kb: DataFrame, path: str) -> None:
    """Knowledge-base artifact (doc_id, text, sentences) as Parquet."""
    kb.write.mode("overwrite").parquet(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_trace_tsv(traces: DataFrame, path: str) -> None:
    """Tab-separated export with a header; nested columns as JSON text."""
    nested = (ST.StructType, ST.ArrayType, ST.MapType)
    cols = [F.to_json(F.col(c)).alias(c) if isinstance(traces.schema[c].dataType, nested) else F.col(c)
            for c in traces.columns]
    traces.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_trace_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Reload the TSV with an explicit schema; JSON text parsed with from_json."""
    t = spark.read.schema(TRACE_TSV_SCHEMA).option("sep", "\t").option("header", True).csv(path)
    return t.withColumn("reward", F.from_json("reward", REWARD_SCHEMA))


def write_index(postings: DataFrame, dfreq: DataFrame, stats: DataFrame, path: str, kb_version: int) -> None:
    """Index tables under ``path/<table>/kb_version=v``."""
    for name, t in (("postings", postings), ("df", dfreq), ("stats", stats)):
        t.write.mode("overwrite").parquet(os.path.join(path, name, f"kb_version={kb_version}"))


def load_index(spark: SparkSession, path: str, kb_version: int):
    """Load the index tables of a version, or None when absent (caller rebuilds)."""
    out = []
    for name in ("postings", "df", "stats"):
        p = os.path.join(path, name, f"kb_version={kb_version}")
        try:
            out.append(spark.read.parquet(p))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # absent index: the caller builds it
                return None
            raise
    return tuple(out)


def write_policy(state: DataFrame, path: str, method: str, variant: str) -> None:
    """Policy state partitioned by (method, variant); one write per fit."""
    (state.withColumn("method", F.lit(method)).withColumn("variant", F.lit(variant))
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("method", "variant").parquet(path))


def read_policy(spark: SparkSession, path: str, method: str, variant: str) -> DataFrame:
    """Partition-pruned read of one (method, variant) state."""
    return spark.read.parquet(path).filter((F.col("method") == method) & (F.col("variant") == variant))
