"""Reward, action space, experiment variants and exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# ---- fixed values ---------------------------------------------------------------
# Action space: 0-7 retriever actions {dense, bm25} x top {10, 20} x reindex
# {False, True}; 8 reranker; 9 paraphrase prompt; 10 simplify prompt.
# Exploration weights: 0.25/8 for each retriever action, 0.25 for each other one.
ACTIONS = [
    (0, "dense", 10, False, None, None),
    (1, "dense", 10, True, None, None),
    (2, "dense", 20, False, None, None),
    (3, "dense", 20, True, None, None),
    (4, "bm25", 10, False, None, None),
    (5, "bm25", 10, True, None, None),
    (6, "bm25", 20, False, None, None),
    (7, "bm25", 20, True, None, None),
    (8, None, None, None, True, None),
    (9, None, None, None, None, "paraphrase_qa"),
    (10, None, None, None, None, "simplify_qa"),
]
ACTION_WEIGHTS = [0.25 / 8] * 8 + [0.25] * 3
# Parameters of an unrepaired question.
BASE_PARAMS = {"retriever": "dense", "topk": 5, "reranker": False, "prompt_edit": "simple_qa", "reindex": False}
# Experiment variants: method, gating, cost, latency budget (s), VRAM budget, task.
VARIANTS = [
    ("fever", "linucb", True, True, 3.0, 6.0, "claim"),
    ("fever_ts", "thompsonsampling", True, True, 3.0, 6.0, "claim"),
    ("fever_nogate", "linucb", False, True, 3.0, 6.0, "claim"),
    ("fever_nocost", "linucb", True, False, 3.0, 6.0, "claim"),
    ("fever_tb", "linucb", True, True, 0.7 * 3, 0.7 * 6, "claim"),
    ("fever_lb", "linucb", True, True, 1.5 * 3, 1.5 * 6, "claim"),
    ("hotpotqa", "linucb", True, True, 3.0, 6.0, "short"),
    ("hotpotqa_ts", "thompsonsampling", True, True, 3.0, 6.0, "short"),
    ("hotpotqa_nogate", "linucb", False, True, 3.0, 6.0, "short"),
    ("hotpotqa_nocost", "linucb", True, False, 3.0, 6.0, "short"),
    ("hotpotqa_tb", "linucb", True, True, 0.7 * 3, 0.7 * 6, "short"),
    ("hotpotqa_lb", "linucb", True, True, 1.5 * 3, 1.5 * 6, "short"),
]
# Knowledge-graph thresholds per task (subject, relation, object).
KG_THRESHOLDS = {"claim": (0.9, 0.9, 0.1), "short": (0.9, 0.9, 0.5)}
REWARD_BINARY_THRESHOLD = 0.4
EXPLORATION_RATE = 0.2
# ---------------------------------------------------------------------------------

ACTION_SCHEMA = ST.StructType([
    ST.StructField("arm", ST.LongType(), False),
    ST.StructField("retriever", ST.StringType()),
    ST.StructField("topk", ST.IntegerType()),
    ST.StructField("reindex", ST.BooleanType()),
    ST.StructField("reranker", ST.BooleanType()),
    ST.StructField("prompt_edit", ST.StringType()),
    ST.StructField("weight", ST.DoubleType(), False),
])


def action_space(spark: SparkSession) -> DataFrame:
    """The 11 arms with their parameter overrides (null = not set) and
    exploration weights, with cumulative weight bounds for sampling."""
    rows = [a + (w,) for a, w in zip(ACTIONS, ACTION_WEIGHTS)]
    df = spark.createDataFrame(rows, ACTION_SCHEMA)
    lo = 0.0
    bounds = []
    for w in ACTION_WEIGHTS:
        bounds.append((lo, lo + w))
        lo += w
    b = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(bounds)], "arm long, w_lo double, w_hi double")
    return df.join(b, "arm")


def variants(spark: SparkSession) -> DataFrame:
    """Experiment variant registry."""
    return spark.createDataFrame(
        VARIANTS, "variant string, method string, with_gating boolean, with_cost boolean, "
                  "latency_budget double, vram_budget double, task string")


def reward(failure: Column, kg: Column, response_entailment: Column, latency: Column, vram: Column,
           latency_budget: Column, vram_budget: Column, with_gating: Column, with_cost: Column) -> Column:
    """Struct of the 8 reward parts. Null budgets are neutral (gate 1, rate 0)."""
    fr = F.when(failure == "NO_FAILURE", F.lit(1.0)).otherwise(F.lit(0.0))
    cr = F.when(kg == "CONSISTENT", F.lit(1.0)).otherwise(F.lit(0.0))
    er = F.when(response_entailment == "ENTAILMENT", F.lit(1.0)).otherwise(F.lit(0.0))
    ls = F.when(latency_budget.isNull(), F.lit(1.0)).when(latency > latency_budget, F.lit(0.0)).otherwise(F.lit(1.0))
    vs = F.when(vram_budget.isNull(), F.lit(1.0)).when(vram > vram_budget, F.lit(0.0)).otherwise(F.lit(1.0))
    lr = F.when(latency_budget.isNull(), F.lit(0.0)).otherwise(latency / latency_budget)
    vr = F.when(vram_budget.isNull(), F.lit(0.0)).otherwise(vram / vram_budget)
    base = (fr + cr + 2.0 * er) / 4.0
    gated = F.when(with_gating, base * ls * vs).otherwise(base)
    total = F.when(with_cost, gated * (1.0 - lr) * (1.0 - vr)).otherwise(gated)
    return F.struct(total.alias("total_reward"), fr.alias("failure_reward"), cr.alias("consistency_reward"),
                    er.alias("factuality_reward"), ls.alias("latency_budget_strict"),
                    vs.alias("vram_budget_strict"), lr.alias("latency_rate"), vr.alias("vram_rate"))


def default_reward(df: DataFrame, latency_budget: float = 3.0, vram_budget: float = 6.0,
                   with_gating: bool = True, with_cost: bool = True, out: str = "reward") -> DataFrame:
    return df.withColumn(out, reward(
        F.col("failure_label"), F.col("kg_consistency"), F.col("response_entailment"),
        F.col("latency"), F.col("vram"), F.lit(latency_budget), F.lit(vram_budget),
        F.lit(with_gating), F.lit(with_cost)))


def binarize(total: Column, threshold: float = REWARD_BINARY_THRESHOLD) -> Column:
    """Thompson reward in {0, 1}."""
    return F.when(total < threshold, F.lit(0.0)).otherwise(F.lit(1.0))


def explore_choice(df: DataFrame, actions: DataFrame, policy_arm: str, key: str = "q",
                   rate: float = EXPLORATION_RATE, seed: int = 42) -> DataFrame:
    """With probability ``rate`` draw an arm from the exploration weights
    (ignoring the allowed-arm mask), else keep the policy's arm. Deterministic
    md5-seeded uniforms; the 11-row weight table is broadcast (fixed size)."""
    from remedy.operators.metrics import md5_uniform

    u1 = md5_uniform(F.lit(f"{seed}:explore"), F.col(key))
    u2 = md5_uniform(F.lit(f"{seed}:arm"), F.col(key))
    x = df.withColumn("_u1", u1).withColumn("_u2", u2)
    b = F.broadcast(actions.select(F.col("arm").alias("_arm"), "w_lo", "w_hi"))
    j = x.join(b, (F.col("_u2") >= F.col("w_lo")) & (F.col("_u2") < F.col("w_hi")), "left")
    explored = F.col("_u1") <= rate
    return (j.withColumn("explored", explored)
             .withColumn("chosen_arm", F.when(explored, F.col("_arm")).otherwise(F.col(policy_arm)))
             .drop("_u1", "_u2", "_arm", "w_lo", "w_hi"))
