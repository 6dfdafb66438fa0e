"""Repair: allowed actions per failed query, hindsight-best action, parameter
overlay, repaired traces, fixed-policy baselines and before/after pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.session import cut_lineage

from remedy.operators.diagnose import NO_FAILURE, UNVERIFIED
from remedy.operators.reward import BASE_PARAMS

PARAMS_SCHEMA = "retriever STRING, topk INT, reranker BOOLEAN, prompt_edit STRING, reindex BOOLEAN"
TRACE_COLS = ["failure_label", "verified_label", "kg_consistency", "query_entailment",
              "response_entailment", "latency", "vram", "reward"]


def action_candidates(diag: DataFrame, actions: DataFrame) -> DataFrame:
    """D9 + G4: (q, arm) for every failed query and every allowed arm: the 8
    retriever arms when the answer was UNVERIFIED, else all 11. The action table
    has a fixed size of 11 rows (bounded broadcast)."""
    from remedy.operators.diagnose import allowed_arm, patchset

    failed = (diag.filter(F.col("failure_label") != NO_FAILURE)
                  .select("q", "verified_label", patchset(F.col("verified_label")).alias("_ps")))
    a = F.broadcast(actions.select("arm"))
    return failed.join(a, allowed_arm(F.col("_ps"), F.col("arm"))).drop("_ps")


def oracle_best_action(diag: DataFrame, cand: DataFrame, actions: DataFrame) -> DataFrame:
    """for each failed query try every allowed arm and keep the strictly highest
    total reward (the lowest arm wins ties); queries without failure keep the
    baseline (arm -1)."""
    pairs = action_candidates(diag, actions).select("q", "arm")
    c = pairs.join(cand, ["q", "arm"]).select("q", "arm", "failure_label",
                                              F.col("reward.total_reward").alias("total_reward"))
    w = W.partitionBy("q").orderBy(F.col("total_reward").desc(), F.col("arm").asc())
    best = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    ok = diag.filter(F.col("failure_label") == NO_FAILURE).select(
        "q", F.lit(-1).cast("long").alias("arm"), "failure_label",
        F.col("reward.total_reward").alias("total_reward"))
    return best.unionByName(ok)


def params_json(arm: Column, retriever: Column, topk: Column, reindex: Column,
                reranker: Column, prompt_edit: Column) -> Column:
    """JSON text of an action's set fields (null for no action)."""
    return (F.when(arm.isNull() | (arm < 0), F.lit(None).cast("string"))
             .when(retriever.isNotNull(), F.concat(
                 F.lit('{"retriever": "'), retriever, F.lit('", "topk": '), topk.cast("string"),
                 F.lit(', "reindex": '), F.when(reindex, F.lit("true")).otherwise(F.lit("false")), F.lit("}")))
             .when(reranker.isNotNull(), F.concat(
                 F.lit('{"reranker": '), F.when(reranker, F.lit("true")).otherwise(F.lit("false")), F.lit("}")))
             .otherwise(F.concat(F.lit('{"prompt_edit": "'), prompt_edit, F.lit('"}'))))


def action_name(params: Column) -> Column:
    """Pretty name of an action given as JSON text. Tests the values (T14):
    reranker set true > prompt edit > retriever > default; null -> Default Action."""
    p = F.from_json(params, PARAMS_SCHEMA)
    return (F.when(params.isNull() | p.isNull(), F.lit("Default Action"))
             .when(F.coalesce(p["reranker"], F.lit(False)), F.lit("Reranker activation"))
             .when(p["prompt_edit"] == "paraphrase_qa", F.lit("Paraphrase query"))
             .when(p["prompt_edit"] == "simplify_qa", F.lit("Simplify query"))
             .when(p["retriever"].isNotNull(), F.format_string(
                 "%s, top-%s, reindex=%s", p["retriever"], p["topk"].cast("string"),
                 F.when(p["reindex"], F.lit("True")).otherwise(F.lit("False"))))
             .otherwise(F.lit("Default Action")))


def apply_action(diag: DataFrame, actions: DataFrame, arm_col: str) -> DataFrame:
    """Base parameters overlaid with the chosen action's set fields; rows
    without failure keep the base parameters."""
    a = F.broadcast(actions.select(F.col("arm").alias("_a"), F.col("retriever").alias("_retriever"),
                                   F.col("topk").alias("_topk"), F.col("reranker").alias("_reranker"),
                                   F.col("prompt_edit").alias("_prompt_edit"), F.col("reindex").alias("_reindex")))
    failed = F.col("failure_label") != NO_FAILURE
    j = diag.join(a, failed & (F.col(arm_col) == F.col("_a")), "left")
    out = j
    for k, v in BASE_PARAMS.items():
        out = out.withColumn(k, F.coalesce(F.col("_" + k), F.lit(v)))
    return out.drop("_a", *["_" + k for k in BASE_PARAMS])


def repaired_traces(diag: DataFrame, cand: DataFrame, arm_col: str,
                    actions: DataFrame | None = None, include_first_call: bool = False) -> DataFrame:
    """Baseline row when there is no failure, else the outcome of the chosen
    arm (an equi-join on (q, arm) with the candidate outcomes).

    T24: by default a repaired row reports only the second call's latency and VRAM
    (as the reference does); ``include_first_call`` adds the failed first call's
    latency, takes the larger VRAM peak, and recomputes the reward with them."""
    spark = diag.sparkSession
    if actions is None:
        from remedy.operators.reward import action_space
        actions = action_space(spark)
    failed = diag.filter(F.col("failure_label") != NO_FAILURE).select(
        "q", F.col(arm_col).alias("arm"), F.col("latency").alias("_l0"), F.col("vram").alias("_v0"))
    fixed = failed.join(cand.select("q", "arm", *TRACE_COLS), ["q", "arm"]).withColumnRenamed("arm", "action")
    if include_first_call:
        from remedy.operators.reward import default_reward
        fixed = (fixed.withColumn("latency", F.col("latency") + F.col("_l0"))
                      .withColumn("vram", F.greatest("vram", "_v0")))
        fixed = default_reward(fixed.drop("reward"))
    fixed = fixed.select("q", "action", *TRACE_COLS)
    ok = diag.filter(F.col("failure_label") == NO_FAILURE).select(
        "q", F.lit(-1).cast("long").alias("action"), *TRACE_COLS)
    out = fixed.unionByName(ok)
    a = F.broadcast(actions)
    j = out.join(a, out.action == a.arm, "left")
    return j.select(out["*"], params_json(F.col("action"), a.retriever, a.topk, a.reindex,
                                          a.reranker, a.prompt_edit).alias("params_json"))


def pre_post_join(pre: DataFrame, post: DataFrame) -> DataFrame:
    """before/after pairing on the row index (here the trace id)."""
    p = pre.select("q", F.col("failure_label").alias("pre_failure"),
                   F.col("latency").alias("_pl"), F.col("vram").alias("_pv"))
    s = post.select("q", "action", "params_json", F.col("failure_label").alias("post_failure"),
                    F.col("latency").alias("_sl"), F.col("vram").alias("_sv"))
    return (p.join(s, "q").withColumn("delta_latency", F.col("_sl") - F.col("_pl"))
             .withColumn("delta_vram", F.col("_sv") - F.col("_pv")).drop("_pl", "_pv", "_sl", "_sv"))


def fixed_policies(diag: DataFrame, cand: DataFrame) -> DataFrame:
    """Always-paraphrase (arm 9), always dense top-20 (arm 2), and the best
    single arm (highest mean reward over failed queries, lowest arm on ties). ``cand``
    holds the outcomes of the failed queries only."""
    spark = diag.sparkSession
    stats = [F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"),
             F.sum((F.col("failure_label") == NO_FAILURE).cast("long")).alias("ok")]
    r = F.col("reward.total_reward").alias("r")
    # one row per arm: all three policies and the choice of the best read it
    per_arm = cut_lineage(cand.select("arm", "failure_label", r).groupBy("arm").agg(*stats))
    best = per_arm.agg(F.max_by("arm", F.struct(F.col("s") / F.col("n"), -F.col("arm"))).alias("arm")).select(
        F.lit("best_arm").alias("policy"), "arm")
    fixed = spark.createDataFrame([("paraphrase", 9), ("top20", 2)], "policy string, arm long")
    pol = fixed.unionByName(best)  # three rows
    passed = diag.filter(F.col("failure_label") == NO_FAILURE).select("failure_label", r).agg(
        F.count(F.lit(1)).alias("n0"), F.sum("r").alias("s0"))  # one row
    j = pol.join(F.broadcast(per_arm), "arm", "left").crossJoin(F.broadcast(passed))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("n") + F.col("n0")
    return j.select("policy", "arm", n.alias("n"),
                    F.try_divide(zero("s") + zero("s0"), n).alias("avg_reward"),
                    (zero("ok") + F.col("n0")).cast("long").alias("n_no_failure")).filter("n > 0")
