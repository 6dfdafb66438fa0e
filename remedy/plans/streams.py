"""Registered streaming queries: each streams a given table's parquet file(s) from
the sf folder through the job and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedy.functions.num import rnd
from remedy.operators import retrieve as R
from remedy.plans import fixtures as X
from remedy.streaming import jobs as S


def stream_diagnose(spark, sf):
    ev = S.read_table_stream(spark, sf, "events", S.EVENTS_SCHEMA)
    out = S.run_to_table(spark, S.diagnose_stream(ev), "diagnose")
    return out.select("q", "failure_label", "verified_label", rnd("total_reward", 6).alias("total_reward"))


def stream_policy(spark, sf):
    ev = S.read_table_stream(spark, sf, "events", S.EVENTS_SCHEMA)
    out = S.run_to_table(spark, S.policy_stream(ev), "policy", mode="complete")
    return out.select("arm", "pulls", rnd("sum_reward", 9).alias("sum_reward"), "alpha", "beta")


def _documents(spark, sf):
    """Passages in micro-batches of bytes: files are small, and each batch has its fixed cost."""
    return S.read_table_stream(spark, sf, "documents", S.DOCS_SCHEMA, bytes_per_trigger=256 << 20)


def stream_reindex(spark, sf):
    return S.run_reindex(spark, _documents(spark, sf)).postings.select("doc_id", "pos", "term", "tf", "dl")


def stream_bm25_topk(spark, sf):
    """H2: benchmark items ranked against the streamed index (all documents, k = 5)."""
    index = S.run_reindex(spark, _documents(spark, sf))
    return R.top_k(R.bm25_scores(index, R.query_terms(X.questions(spark, sf)), k=5), 5)


def stream_epsgreedy(spark, sf):
    """H1: epsilon-greedy weights advanced per micro-batch by the maps of its blocks."""
    out = S.run_epsgreedy(spark, S.read_table_stream(spark, sf, "events", S.EVENTS_SCHEMA))
    return out.select("arm", "pulls", F.transform("w", lambda v: rnd(v, 8)).alias("w"))
