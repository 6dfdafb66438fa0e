"""Registered knowledge-graph consistency queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedy.functions.num import rnd
from remedy.operators import triples as TR
from remedy.operators.reward import KG_THRESHOLDS
from remedy.plans import fixtures as X
from remedy.session import cut_lineage


def _setup(spark, sf):
    """(facts, claims, vec): triples that name their element vectors, and the vectors. The
    triples are kept (narrow rows): several steps read them."""
    ids, vec = TR.distinct_vectors(X.vectors(spark, sf))
    facts = TR.with_elements(X.facts(spark, sf), ids).select("fact_id", "s_c", "r_c", "o_c")
    claims = TR.with_elements(X.answer_triples(spark, sf), ids).select("answer_id", "s_c", "r_c", "o_c")
    return cut_lineage(facts), cut_lineage(claims), vec


def triple_topk(spark, sf):
    facts, claims, vec = _setup(spark, sf)
    return TR.triple_topk(claims, facts, vec, 3).select("answer_id", "fact_id", "rank", rnd("score", 6).alias("score"))


def _status(spark, sf, task="claim"):
    facts, claims, vec = _setup(spark, sf)
    cands = TR.triple_topk(claims, facts, vec, 3)
    return TR.triple_status(cands, claims, facts, vec, KG_THRESHOLDS[task]), claims


def triple_status(spark, sf):
    st, _ = _status(spark, sf)
    return st


def triple_rollup(spark, sf):
    st, claims = _status(spark, sf)
    return TR.triple_rollup(st, claims)


def answer_consistency_short(spark, sf):
    """E5 under the short-answer task's thresholds."""
    return answer_consistency(spark, sf, "short")


def answer_consistency(spark, sf, task="claim"):
    st, claims = _status(spark, sf, task)
    per = TR.triple_rollup(st, claims)
    return TR.answer_consistency(X.answers(spark, sf).select("answer_id", "answer_text"), per)


def consistency_counts(spark, sf):
    return answer_consistency(spark, sf).groupBy("consistency").agg(F.count(F.lit(1)).alias("n"))
