"""Registered source / sink queries (rows-only checks): each writes data derived
from the given tables to a scratch folder under the shared checkpoint directory
and reads it back through the reader under test."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from remedy.functions import text as T
from remedy.functions.num import rnd
from remedy.operators import corpus as C
from remedy.operators import policy as PO
from remedy.operators import retrieve as R
from remedy.operators import reward as RW
from remedy.plans import fixtures as X
from remedy.plans.index import index_at
from remedy.session import scratch_path
from remedy.sources import files as FS


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def src_claims(spark, sf):
    path = _scratch(spark, "claims")
    X.claims(spark, sf).write.json(path)
    return FS.read_claims(spark, path)


def _pages_dir(spark, sf):
    """Pages as JSON lines in a small directory tree (one sub-folder per language)."""
    root = _scratch(spark, "wiki")
    p = X.wiki_pages(spark, sf).join(X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("page_id"), "lang"), "page_id")
    (p.select(F.col("page_id").alias("id"), "text", "lines", "lang")
      .write.partitionBy("lang").json(root))
    return root


def src_pages(spark, sf):
    return FS.read_pages(spark, _pages_dir(spark, sf))


def src_slices(spark, sf):
    """A3: the first 2 files of a directory of page files of 50 consecutive ids each."""
    root = _scratch(spark, "slices")
    p = X.wiki_pages(spark, sf).select(F.col("page_id").alias("id"), "text", "lines",
                                       F.format_string("%012d", F.floor(F.col("page_id").cast("long") / 50)).alias("part"))
    p.repartition("part").write.partitionBy("part").json(root)
    return FS.read_slices(spark, root, 2).select("id", "text", "lines")


def src_multihop(spark, sf):
    """Multi-hop rows: one row per benchmark item and document containing it, with that
    document's lines as the hop's sentences (an item without any has no hop)."""
    path = _scratch(spark, "multihop")
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    qs = X.questions(spark, sf)
    g = R.gold_containment(docs, qs).distinct()
    j = qs.join(g, "q_id", "left").join(docs, "doc_id", "left")
    hops = F.when(F.col("text").isNull(), F.array().cast("array<array<string>>")).otherwise(
        F.array(F.split(F.col("text"), "\n")))
    (j.select(F.col("q_id").alias("id"), "question", F.lit("").alias("answer"),
              F.struct(F.array().cast("array<string>").alias("title"), hops.alias("sentences")).alias("context"))
      .write.json(path))
    return FS.read_multihop(spark, path)


def kb_artifact(spark, sf):
    ev = C.explode_evidence(X.claims(spark, sf))
    pages = C.evidence_pages(X.wiki_pages(spark, sf), ev)
    kb = pages.select(F.col("page_id").alias("doc_id"), T.clean_passage("text").alias("text"),
                      T.split_sentences("lines").alias("sentences"))
    path = _scratch(spark, "kb")
    FS.write_kb(kb, path)
    return FS.read_kb(spark, path)


def _traces_path(spark, sf):
    from remedy.plans.diagnosis import repaired
    path = _scratch(spark, "traces")
    FS.write_trace_tsv(repaired(spark, sf).select(
        "q", "action", "failure_label", "verified_label", "kg_consistency", "query_entailment",
        "response_entailment", "latency", "vram", "reward", "params_json"), path)
    return path


def trace_tsv(spark, sf):
    """The exported rows, parsed again column by column (headers and part files, which
    depend on the number of tasks, do not show)."""
    t = spark.read.schema(FS.TRACE_TSV_SCHEMA).option("sep", "\t").option("header", True).csv(_traces_path(spark, sf))
    return t.select("q", "action", "failure_label", "verified_label", "kg_consistency", "query_entailment",
                    "response_entailment", rnd("latency", 6).alias("latency"), rnd("vram", 6).alias("vram"))


def trace_reload(spark, sf):
    return FS.read_trace_tsv(spark, _traces_path(spark, sf))


def trace_reload_rewards(spark, sf):
    """The reloaded rows with the total of the parsed reward."""
    t = trace_reload(spark, sf)
    return t.select("q", "action", "failure_label", "params_json", rnd(F.col("reward.total_reward"), 6).alias("total_reward"))


def index_tables(spark, sf):
    """The postings of the shared index, loaded if that of this input and these
    parameters is there, else built and written."""
    return index_at(spark, sf).postings().drop("delta")


def policy_io(spark, sf):
    from remedy.plans.policies import _binary_log
    state = PO.thompson_fit(_binary_log(spark, sf), RW.action_space(spark))
    path = _scratch(spark, "policy")
    FS.write_policy(state, path, "thompsonsampling", "fever")
    FS.write_policy(state.withColumn("alpha", F.col("alpha") + 1), path, "thompsonsampling", "fever_ts")
    return FS.read_policy(spark, path, "thompsonsampling", "fever")
