"""Registered diagnosis / reward / repair / evaluation queries over the traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from remedy.functions.num import rnd

from remedy.functions import text as T
from remedy.operators import diagnose as D
from remedy.operators import metrics as M
from remedy.operators import repair as P
from remedy.operators import reward as RW
from remedy.plans import fixtures as X

R6 = lambda c, name=None: rnd(F.col(c), 6).alias(name or c)
REWARD_PARTS = ["total_reward", "failure_reward", "consistency_reward", "factuality_reward",
                "latency_budget_strict", "vram_budget_strict", "latency_rate", "vram_rate"]


def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-repair trace table: votes -> entailment -> failure label -> reward -> EM. A
    trace holds its own votes as arrays, so all of it is row by row (the vote table of
    ``entailment_vote`` gives the same classes by grouping)."""
    b = X.base_traces(spark, sf)
    d = RW.default_reward(D.with_failure(X.vote_arrays(b.withColumn("_vq", F.col("q")))))
    return d.withColumn("em", T.exact_match(F.array("gt_label"), F.col("verified_label")))


EVENT_COLS = ("event_id", "user_id", "value")


def diagnose_rows(events: DataFrame, keep=()) -> DataFrame:
    """Failure label of each event's trace, row by row: no grouping and no join, so it
    serves batches and streams alike."""
    return D.with_failure(X.vote_arrays(X.traces_from_events(events, None, keep)))


def failed_with_choice(events: DataFrame, keep=()) -> DataFrame:
    """Failed traces with the arm that is played: the logged one, within the allowed set."""
    pre = diagnose_rows(events, keep=(*EVENT_COLS, *keep)).filter(F.col("failure_label") != D.NO_FAILURE)
    logged = F.col("event_id") % X.N_ARMS
    return pre.withColumn("retriever_only", F.col("verified_label") == D.UNVERIFIED).withColumn(
        "chosen_arm", F.when(F.col("retriever_only"), logged % 8).otherwise(logged))


def chosen_outcomes(failed: DataFrame, keep=()) -> DataFrame:
    """Outcome of re-asking each failed trace under its chosen arm only (not all arms)."""
    post = X.vote_arrays(X.traces_from_events(failed, F.col("chosen_arm"), ("chosen_arm", *keep)))
    return RW.default_reward(D.with_failure(post)).withColumnRenamed("chosen_arm", "arm")


def candidates_diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every (query, arm) re-ask, diagnosed and rewarded, row by row. The arm
    table has a fixed size of 11 rows."""
    arms = F.broadcast(spark.range(X.N_ARMS).select(F.col("id").alias("arm")))
    e = X.table(spark, sf, "events").crossJoin(arms)
    return RW.default_reward(D.with_failure(X.vote_arrays(X.traces_from_events(e, F.col("arm"), ("arm",)))))


def failed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the failed traces under every arm; the others are never re-asked."""
    arms = F.broadcast(spark.range(X.N_ARMS).select(F.col("id").alias("arm")))
    e = failed_with_choice(X.table(spark, sf, "events")).select(*EVENT_COLS).crossJoin(arms)
    return RW.default_reward(D.with_failure(X.vote_arrays(X.traces_from_events(e, F.col("arm"), ("arm",)))))


def entailment_vote(spark, sf):
    b = X.base_traces(spark, sf)
    return D.entailment_vote(b, X.votes(spark, sf, b), ["q"]).select("q", "query_entailment", "response_entailment")


def failure_label(spark, sf):
    return diagnosed(spark, sf).select("q", "failure_label")


def verified_label(spark, sf):
    return diagnosed(spark, sf).select("q", "label", "verified_label",
                                       D.patchset(F.col("verified_label")).alias("patchset"))


def reward(spark, sf):
    d = diagnosed(spark, sf)
    return d.select("q", *[rnd(F.col("reward")[p], 6).alias(p) for p in REWARD_PARTS])


def reward_binary(spark, sf):
    d = diagnosed(spark, sf)
    return d.select("q", RW.binarize(F.col("reward.total_reward")).alias("reward_binary"))


def action_space(spark, sf):
    a = RW.action_space(spark)
    n = X.base_traces(spark, sf).groupBy("arm").agg(F.count(F.lit(1)).alias("n_logged"))
    return (a.join(n, "arm", "left")
             .select("arm", "retriever", "topk", "reindex", "reranker", "prompt_edit", R6("weight"),
                     F.coalesce("n_logged", F.lit(0)).alias("n_logged")))


def variants(spark, sf):
    v = F.broadcast(RW.variants(spark))  # fixed 12-row registry
    t = X.base_traces(spark, sf).select("latency", "vram")
    j = t.crossJoin(v)
    return (j.groupBy("variant", "method", "with_gating", "with_cost", "latency_budget", "vram_budget", "task")
             .agg(F.sum((F.col("latency") <= F.col("latency_budget")).cast("long")).alias("n_latency_ok"),
                  F.sum((F.col("vram") <= F.col("vram_budget")).cast("long")).alias("n_vram_ok"),
                  F.count(F.lit(1)).alias("n"))
             .withColumn("latency_budget", rnd("latency_budget", 6))
             .withColumn("vram_budget", rnd("vram_budget", 6)))


def reward_ablation(spark, sf):
    """Reward under every variant (gate/cost switches, tight/loose budgets)."""
    v = F.broadcast(RW.variants(spark))  # fixed 12-row registry
    d = diagnosed(spark, sf).select("q", "failure_label", "kg_consistency", "response_entailment", "latency", "vram")
    j = d.crossJoin(v)
    r = RW.reward(F.col("failure_label"), F.col("kg_consistency"), F.col("response_entailment"),
                  F.col("latency"), F.col("vram"), F.col("latency_budget"), F.col("vram_budget"),
                  F.col("with_gating"), F.col("with_cost"))["total_reward"]
    r = F.when(F.col("method") == "thompsonsampling", RW.binarize(r)).otherwise(r)
    return (j.withColumn("r", r).groupBy("variant")
             .agg(rnd(F.avg("r"), 6).alias("avg_reward"),
                  F.sum((F.col("r") == 0).cast("long")).alias("n_zero"),
                  F.count(F.lit(1)).alias("n")))


def action_candidates(spark, sf):
    return P.action_candidates(diagnosed(spark, sf), RW.action_space(spark)).select("q", "arm")


def oracle_best_action(spark, sf):
    d = diagnosed(spark, sf)
    best = P.oracle_best_action(d, failed_candidates(spark, sf), RW.action_space(spark))
    return best.select("q", "arm", "failure_label", R6("total_reward"))


def _policy_choice(d: DataFrame) -> DataFrame:
    """The logged arm, restricted to the allowed set (retriever arms when UNVERIFIED)."""
    return d.withColumn("chosen_arm", F.when(F.col("verified_label") == D.UNVERIFIED, F.col("arm") % 8)
                        .otherwise(F.col("arm")))


def apply_action(spark, sf):
    d = _policy_choice(diagnosed(spark, sf))
    a = P.apply_action(d, RW.action_space(spark), "chosen_arm")
    return a.select("q", "retriever", "topk", "reranker", "prompt_edit", "reindex")


def repaired(spark, sf):
    d = _policy_choice(diagnosed(spark, sf))
    return P.repaired_traces(d, chosen_outcomes(failed_with_choice(X.table(spark, sf, "events"))), "chosen_arm")


def repaired_traces(spark, sf):
    r = repaired(spark, sf)
    return r.select("q", "action", "failure_label", "verified_label", "kg_consistency",
                    "query_entailment", "response_entailment", R6("latency"), R6("vram"),
                    rnd(F.col("reward.total_reward"), 6).alias("total_reward"))


def fixed_policy(spark, sf):
    out = P.fixed_policies(diagnosed(spark, sf), failed_candidates(spark, sf))
    return out.select("policy", "arm", "n", R6("avg_reward"), "n_no_failure")


def explore_choice(spark, sf):
    d = _policy_choice(diagnosed(spark, sf))
    e = RW.explore_choice(d, RW.action_space(spark), "chosen_arm", "q")
    return e.select("q", "explored", "chosen_arm")


def failed_rows(spark, sf):
    return diagnosed(spark, sf).filter(F.col("failure_label") != D.NO_FAILURE).select("q", "failure_label")


def exact_match(spark, sf):
    return diagnosed(spark, sf).select("q", "gt_label_raw", "verified_label", "em")


def canon_label(spark, sf):
    return X.base_traces(spark, sf).select("q", T.canon_label("gt_label_raw").alias("gt_label"))


def diagnostic_counts(spark, sf):
    d = diagnosed(spark, sf)
    return M.value_counts_by(d, "em", ["kg_consistency", "query_entailment", "response_entailment",
                                       "failure_label", "gt_label", "verified_label"])


def consistency_rate(spark, sf):
    d = diagnosed(spark, sf).withColumn("is_consistent", F.col("kg_consistency") == "CONSISTENT")
    r = M.rate_with_overall(d, "failure_label", "is_consistent", "consistency_rate")
    return r.select("failure_label", R6("consistency_rate"), "n")


def bootstrap_ci(spark, sf):
    """Bootstrap mean and 95% interval of latency, VRAM and the consistency
    rate, per failure label and overall."""
    return _intervals(diagnosed(spark, sf))


def _intervals(d: DataFrame) -> DataFrame:
    x = d.select("q", "failure_label", "latency", "vram",
                 (F.col("kg_consistency") == "CONSISTENT").cast("double").alias("consistency"))
    return M.bootstrap_metrics(x, "failure_label", ["latency", "vram", "consistency"], "q")


def repaired_with_em(spark, sf) -> DataFrame:
    """Repaired traces with the gold label and the exact match after repair."""
    gold = X.base_traces(spark, sf).select("q", "gt_label")
    return repaired(spark, sf).join(gold, "q").withColumn("em", T.exact_match(F.array("gt_label"), F.col("verified_label")))


def post_bootstrap_ci(spark, sf):
    """E11 after repair: the same intervals over the repaired traces."""
    return _intervals(repaired(spark, sf))


def post_consistency_rate(spark, sf):
    """E12 after repair, per failure label and overall, with the exact-match rate."""
    d = repaired_with_em(spark, sf)
    r = d.rollup("failure_label").agg(
        R6_mean(F.col("kg_consistency") == "CONSISTENT").alias("consistency_rate"),
        R6_mean(F.col("em")).alias("em_rate"), F.count(F.lit(1)).alias("n"))
    return r.select("failure_label", "consistency_rate", "em_rate", "n")


def R6_mean(flag):
    return rnd(F.avg(flag.cast("double")), 6)


def post_diagnostic_counts(spark, sf):
    """E9 after repair: value counts split by the exact match after repair."""
    return M.value_counts_by(repaired_with_em(spark, sf), "em", [
        "kg_consistency", "query_entailment", "response_entailment", "failure_label", "gt_label", "verified_label"])


def pre_post(spark, sf):
    pre = diagnosed(spark, sf)
    post = repaired(spark, sf)
    return P.pre_post_join(pre, post)


def pre_post_join(spark, sf):
    return pre_post(spark, sf).select("q", "pre_failure", "post_failure", "action",
                                      R6("delta_latency"), R6("delta_vram"))


def action_name(spark, sf):
    r = repaired(spark, sf)
    return r.select("q", P.action_name(F.col("params_json")).alias("action_name"))


def delta_by_action(spark, sf):
    pp = pre_post(spark, sf)
    return (pp.groupBy("params_json").agg(rnd(F.avg("delta_latency"), 6).alias("delta_latency"),
                                          rnd(F.avg("delta_vram"), 6).alias("delta_vram"),
                                          F.count(F.lit(1)).alias("n"))
              .select(F.coalesce("params_json", F.lit("None")).alias("params"), "delta_latency", "delta_vram", "n"))


def action_frequency(spark, sf):
    pp = pre_post(spark, sf).filter(F.col("pre_failure") != D.NO_FAILURE)
    return (pp.groupBy("pre_failure", P.action_name(F.col("params_json")).alias("action_name"))
              .agg(F.count(F.lit(1)).alias("n")))


def budget_features(spark, sf):
    from remedy.operators import policy as PO
    d = diagnosed(spark, sf)
    return d.select("q", *[rnd(c, 10).alias(n) for n, c in
                           zip(["vram_headroom", "latency_headroom"], PO.budget_features(F.col("vram"), F.col("latency")))])


def one_hot(spark, sf):
    from remedy.operators import policy as PO
    d = diagnosed(spark, sf)
    return d.select("q", PO.one_hot_failure(F.col("failure_label")).alias("failure_onehot"),
                    PO.one_hot_consistency(F.col("kg_consistency")).alias("consistency_onehot"),
                    PO.one_hot_entailment(F.col("query_entailment")).alias("query_onehot"),
                    PO.one_hot_entailment(F.col("response_entailment")).alias("response_onehot"))


def faithfulness(spark, sf):
    """Per failure label, mean over answers of the share of chunks whose judge
    verdict supports the answer (verdict = response vote is 'entail')."""
    b = X.base_traces(spark, sf)
    v = X.votes(spark, sf, b)
    per = v.groupBy("q").agg(F.avg((F.col("response_vote") == 0).cast("double")).alias("faith"))
    d = diagnosed(spark, sf).select("q", "failure_label").join(per, "q")
    return d.groupBy("failure_label").agg(rnd(F.avg("faith"), 6).alias("faithfulness"),
                                          F.count(F.lit(1)).alias("n"))


def answer_relevancy(spark, sf):
    """Per failure label, mean cosine between the question vector and the
    vectors of three questions generated back from the answer (embedding rows). A cosine is
    computed once per distinct pair of rows; the answers meet it by the ids of the pair."""
    from remedy.operators import policy as PO
    v = X.vectors(spark, sf)
    nvec = X.n_vectors(spark, sf)
    d = diagnosed(spark, sf).select("q", "failure_label")
    g = d.select("q", "failure_label", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    g = g.withColumn("qrow", F.col("q") % nvec).withColumn("grow", (F.col("q") * 3 + F.col("j") + 1) % nvec)
    qv = v.select(F.col("vec_id").alias("qrow"), F.col("v").alias("qv"))
    gv = v.select(F.col("vec_id").alias("grow"), F.col("v").alias("gv"))
    cos = PO.dot(F.col("qv"), F.col("gv")) / (PO.norm(F.col("qv")) * PO.norm(F.col("gv")))
    # sorted joins: neither the answers nor the vectors are ever held whole
    pairs = g.select("qrow", "grow").distinct().join(qv.hint("merge"), "qrow").join(gv.hint("merge"), "grow")
    j = g.join(pairs.select("qrow", "grow", cos.alias("cos")).hint("merge"), ["qrow", "grow"])
    per = j.groupBy("q", "failure_label").agg(F.avg("cos").alias("rel"))
    return per.groupBy("failure_label").agg(rnd(F.avg("rel"), 6).alias("answer_relevancy"),
                                            F.count(F.lit(1)).alias("n"))


def context_means(spark, sf):
    """Mean context precision / recall over the traces, split by the trace's exact
    match; a trace asks benchmark item q mod n. Traces are counted per item first, so
    the join reads one row per (item, outcome); nulls are left out of the means."""
    from remedy.plans.retrieval import retrieval_eval
    from remedy.sources.tables import table
    n = table(spark, sf, "benchmark").count()
    asked = diagnosed(spark, sf).groupBy((F.col("q") % n).alias("q_id"), "em").agg(F.count(F.lit(1)).alias("n"))
    j = asked.join(retrieval_eval(spark, sf), "q_id")

    def mean(c: str) -> F.Column:
        return rnd(F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))), 6).alias(c)

    return j.groupBy("em").agg(mean("context_precision"), mean("context_recall"), F.sum("n").alias("n"))
