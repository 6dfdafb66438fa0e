"""Diagnosis: entailment vote, failure-label cascade, answer-label override,
patch-set choice, and (chunk, query/response) pairs for the NLI hook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_FAILURE = "NO_FAILURE"
WRONG_PREDICATE = "WRONG_PREDICATE_FAILURE"
INSUFFICIENT_EVIDENCE = "INSUFFICIENT_EVIDENCE_FAILURE"
WRONG_RESPONSE = "WRONG_RESPONSE_FAILURE"
LABEL_EVIDENCE_MISMATCH = "LABEL_EVIDENCE_MISMATCH_FAILURE"
UNVERIFIED = "UNVERIFIED"


def vote(label_col: str) -> Column:
    """Aggregate expression of one vote (use inside ``agg``): no chunk -> NEUTRAL
    (applied by the caller's coalesce), all neutral -> NEUTRAL, any entail ->
    ENTAILMENT, otherwise CONTRADICTION. Class ids: 0 entail, 1 neutral, 2 contradict."""
    c = F.col(label_col)
    return (F.when(F.bool_and(c == 1), F.lit("NEUTRAL"))
             .when(F.bool_or(c == 0), F.lit("ENTAILMENT"))
             .otherwise(F.lit("CONTRADICTION")))


def entailment_vote(keys: DataFrame, votes: DataFrame, key_cols=("q",)) -> DataFrame:
    """Query and response entailment per key; keys without chunks are NEUTRAL.

    The vote table is pre-aggregated per key (map-side partial aggregation) before
    it meets the key table."""
    k = list(key_cols)
    agg = votes.groupBy(*k).agg(vote("query_vote").alias("qe"), vote("response_vote").alias("re"))
    return (keys.join(agg, k, "left")
                .withColumn("query_entailment", F.coalesce("qe", F.lit("NEUTRAL")))
                .withColumn("response_entailment", F.coalesce("re", F.lit("NEUTRAL")))
                .drop("qe", "re"))


def failure_label(kg: Column, qe: Column, re: Column, label: Column) -> tuple[Column, Column]:
    """G1 + G2 + G3: returns (failure_label, verified_label).

    Defaults when absent: consistency MISSING, entailments ENTAILMENT, label SUPPORTS
    when the query is entailed else REFUTES."""
    kg = F.coalesce(kg, F.lit("MISSING"))
    qe = F.coalesce(qe, F.lit("ENTAILMENT"))
    re = F.coalesce(re, F.lit("ENTAILMENT"))
    label = F.coalesce(label, F.when(qe == "ENTAILMENT", F.lit("SUPPORTS")).otherwise(F.lit("REFUTES")))
    fl = (F.when(kg == "CONFLICT", F.lit(WRONG_PREDICATE))
           .when(qe == "NEUTRAL", F.lit(INSUFFICIENT_EVIDENCE))
           .when(re.isin("CONTRADICTION", "NEUTRAL"), F.lit(WRONG_RESPONSE))
           .when((label == "SUPPORTS") & (qe == "CONTRADICTION"), F.lit(LABEL_EVIDENCE_MISMATCH))
           .when((label == "REFUTES") & (qe == "ENTAILMENT"), F.lit(LABEL_EVIDENCE_MISMATCH))
           .otherwise(F.lit(NO_FAILURE)))
    verified = F.when(fl.isin(INSUFFICIENT_EVIDENCE, LABEL_EVIDENCE_MISMATCH), F.lit(UNVERIFIED)).otherwise(label)
    return fl, verified


def with_failure(df: DataFrame, kg="kg_consistency", qe="query_entailment",
                 re="response_entailment", label="label") -> DataFrame:
    fl, vl = failure_label(F.col(kg), F.col(qe), F.col(re), F.col(label))
    return df.withColumn("failure_label", fl).withColumn("verified_label", vl)


def patchset(verified_label: Column, task: str = "claim") -> Column:
    """Retriever arms only (0-7) when UNVERIFIED in the claim task, else all.
    (A generation-only set, arms 8-10, exists; no caller selects it.)"""
    if task == "short":
        return F.lit("all")
    return F.when(verified_label == UNVERIFIED, F.lit("retriever")).otherwise(F.lit("all"))


def allowed_arm(patchset_col: Column, arm: Column) -> Column:
    """Arm mask of a patch set: retriever = 0-7, generation = 8-10, all = every arm."""
    return (F.when(patchset_col == "retriever", arm < 8)
             .when(patchset_col == "generation", arm >= 8)
             .otherwise(F.lit(True)))


def nli_pairs(contexts: DataFrame, key_col: str = "q_id") -> DataFrame:
    """(chunk, query) and (chunk, response) premise/hypothesis pairs.

    ``contexts``: key, query, response, retrieved ARRAY<STRUCT<text,node_id,score>>."""
    x = contexts.select(key_col, "query", "response", F.posexplode("retrieved").alias("r", "ctx"))
    q = x.select(key_col, "r", F.lit("query").alias("side"), F.col("ctx.text").alias("premise"),
                 F.col("query").alias("hypothesis"))
    s = x.select(key_col, "r", F.lit("response").alias("side"), F.col("ctx.text").alias("premise"),
                 F.col("response").alias("hypothesis"))
    return q.unionByName(s)
