"""Registered policy queries: features, bandit fits, scores and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedy.functions.num import rnd
from remedy.operators import policy as PO
from remedy.operators import reward as RW
from remedy.operators.metrics import md5_uniform
from remedy.plans import fixtures as X
from remedy.session import cut_lineage
from remedy.plans.diagnosis import chosen_outcomes, failed_with_choice

EMB_DIM = 64
DIAG_DIM = 18
FULL_DIM = EMB_DIM + DIAG_DIM


def diag_features(df: DataFrame) -> DataFrame:
    """The 18 diagnosis features (one-hots and budget headroom) as ``x``."""
    vh, lh = PO.budget_features(F.col("vram"), F.col("latency"))
    return df.withColumn("x", F.concat(
        PO.one_hot_failure(F.col("failure_label")).cast("array<double>"),
        PO.one_hot_consistency(F.col("kg_consistency")).cast("array<double>"),
        PO.one_hot_entailment(F.col("query_entailment")).cast("array<double>"),
        PO.one_hot_entailment(F.col("response_entailment")).cast("array<double>"),
        F.array(vh, lh)))


def contexts(spark, sf, full: bool = True) -> DataFrame:
    """Context rows of failed queries: (q, x, retriever_only, chosen_arm)."""
    return _contexts(spark, sf, full).select("q", "x", "retriever_only", "chosen_arm")


def _contexts(spark, sf, full: bool) -> DataFrame:
    d = failed_with_choice(X.table(spark, sf, "events"))
    if full:
        d = PO.context_vector(PO.with_query_embedding(d, X.vectors(spark, sf), X.n_vectors(spark, sf), "q"), "qv")
    else:
        d = diag_features(d)
    return d


def log(spark, sf, full: bool = True) -> DataFrame:
    """Logged (context, arm, reward) of failed queries: the chosen arm's outcome.
    Only failed rows update the policy (the update sits inside the failure branch)."""
    post = chosen_outcomes(_contexts(spark, sf, full), ("x",))
    return post.select(F.col("q").alias("step"), "arm", "x", F.col("reward.total_reward").alias("r"))


def context_vector(spark, sf):
    c = contexts(spark, sf, True)
    return c.select("q", F.size("x").alias("dims"),
                    rnd(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("vec_sum"),
                    rnd(PO.dot(F.col("x"), F.col("x")), 6).alias("vec_sumsq"),
                    rnd(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("vec_wsum"))


def linucb_fit(spark, sf):
    fit = PO.linucb_fit(log(spark, sf, True), FULL_DIM)
    # 9 places: budget features are multiples of 2e-7, so 6-place ties are common.
    cell = fit.select("arm", F.posexplode("a").alias("p", "v")).select(
        "arm", F.floor(F.col("p") / FULL_DIM).cast("int").alias("i"), (F.col("p") % FULL_DIM).alias("j"), "v")
    a = cell.select("arm", "i", "j", rnd(F.col("v") + (F.col("i") == F.col("j")).cast("double"), 9).alias("value"))
    b = fit.select("arm", F.posexplode("b").alias("i", "v")).select("arm", "i", F.lit(-1).alias("j"), rnd("v", 9).alias("value"))
    return a.unionByName(b)


def linucb_score(spark, sf):
    state = PO.linucb_state(PO.linucb_fit(log(spark, sf, True), FULL_DIM), FULL_DIM)
    sc = PO.linucb_score(contexts(spark, sf, True), state, X.N_ARMS, FULL_DIM, PO.LINUCB_ALPHA)
    return PO.masked_argmax(sc, "q")


def _binary_log(spark, sf):
    return log(spark, sf, False).withColumn("r", RW.binarize(F.col("r")))


def thompson_fit(spark, sf):
    return PO.thompson_fit(_binary_log(spark, sf), RW.action_space(spark))


def thompson_mean(spark, sf):
    fit = PO.thompson_fit(_binary_log(spark, sf), RW.action_space(spark))
    mean = fit.select("arm", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("score"))
    c = contexts(spark, sf, False).select("q", "retriever_only")
    s = c.crossJoin(F.broadcast(mean))  # 11 arms
    return PO.masked_argmax(s, "q", ~F.col("retriever_only") | (F.col("arm") < 8))


def thompson_score(spark, sf):
    """one Beta(alpha, beta) draw per (q, arm), vectorised per Arrow batch."""
    fit = PO.thompson_fit(_binary_log(spark, sf), RW.action_space(spark))
    c = contexts(spark, sf, False).select("q", "retriever_only")
    s = c.crossJoin(F.broadcast(fit)).filter(~F.col("retriever_only") | (F.col("arm") < 8))  # 11 arms
    draw = F.pandas_udf(PO.beta_draws, "double")
    return PO.masked_argmax(s.withColumn("score", draw("q", "arm", "alpha", "beta")), "q")


def ucb_fit(spark, sf):
    f = PO.ucb_fit(log(spark, sf, False), RW.action_space(spark))
    return f.select("arm", "pulls", rnd("mean_reward", 6).alias("mean_reward"), "total_pulls")


def ucb_score(spark, sf):
    f = PO.ucb_score(PO.ucb_fit(log(spark, sf, False), RW.action_space(spark)))
    return f.select("arm", "pulls", rnd("ucb", 6).alias("ucb"), "is_choice")


def kernelucb_scores(spark, sf):
    return PO.kernelucb_linear(contexts(spark, sf, False), log(spark, sf, False), RW.action_space(spark),
                               alpha=1.0, dim=DIAG_DIM)


def kernelucb_score(spark, sf):
    return kernelucb_scores(spark, sf).select("q", "arm", rnd("score", 6).alias("score"))


def arm_argmax(spark, sf):
    s = kernelucb_scores(spark, sf).withColumn("score", rnd("score", 6))
    return PO.masked_argmax(s, "q", ~F.col("retriever_only") | (F.col("arm") < 8))


def neural_linear_score(spark, sf):
    lg = log(spark, sf, False)
    mom = PO.arm_moments(lg, DIAG_DIM)
    n = lg.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    w = (RW.action_space(spark).select("arm").join(mom, "arm", "left").join(n, "arm", "left")
         .select("arm", F.coalesce(F.transform("b", lambda v: v / F.greatest(F.col("n"), F.lit(1))),
                                   F.array_repeat(F.lit(0.0), DIAG_DIM)).alias("w")))
    c = contexts(spark, sf, False)
    sc = PO.neural_linear_score(c, w, 1.0).withColumn("score", rnd("score", 6))
    best = PO.masked_argmax(sc.join(c.select("q", "retriever_only"), "q"), "q",
                            ~F.col("retriever_only") | (F.col("arm") < 8))
    return best.join(sc, ["q", "arm"]).select("q", "arm", "score")


def epsgreedy_fit(spark, sf):
    lg = log(spark, sf, False)
    w = PO.epsgreedy_fit(lg, DIAG_DIM, arms=RW.action_space(spark))
    return w.select("arm", F.size("w").alias("dims"), rnd(PO.norm(F.col("w")), 6).alias("w_norm"),
                    F.transform("w", lambda v: rnd(v, 8)).alias("w"))


def epsgreedy_choice(spark, sf):
    """with probability epsilon a uniform arm, else argmax of w.x (md5 draws)."""
    lg = log(spark, sf, False)
    w = PO.epsgreedy_fit(lg, DIAG_DIM, arms=RW.action_space(spark))
    c = contexts(spark, sf, False)
    sc = c.crossJoin(F.broadcast(w)).select("q", "arm", PO.dot(F.col("x"), F.col("w")).alias("score"))
    greedy = PO.masked_argmax(sc, "q")
    u1 = md5_uniform(F.lit("42:eps"), F.col("q"))
    u2 = md5_uniform(F.lit("42:eps-arm"), F.col("q"))
    return greedy.select("q", F.when(u1 < PO.EPSILON, F.floor(u2 * X.N_ARMS).cast("long")).otherwise(F.col("arm")).alias("arm"),
                         (u1 < PO.EPSILON).alias("explored"))


def tree_policy(spark, sf):
    """One regression tree per arm (Spark ML, fitted on that arm's log); arms
    without data predict 0; the arm with the highest prediction wins."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    lg = cut_lineage(log(spark, sf, False)).withColumn("features", array_to_vector("x"))  # one fit per arm reads it
    c = cut_lineage(contexts(spark, sf, False)).withColumn("features", array_to_vector("x"))
    arms = [r["arm"] for r in lg.select("arm").distinct().collect()]  # at most 11 values
    preds = []
    for a in sorted(arms):
        m = DecisionTreeRegressor(labelCol="r", featuresCol="features", seed=42).fit(lg.filter(F.col("arm") == a))
        preds.append(m.transform(c).select("q", F.lit(a).cast("long").alias("arm"), F.col("prediction").alias("score")))
    missing = [a for a in range(X.N_ARMS) if a not in arms]
    if missing:
        preds.append(c.select("q").crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in missing], "arm long")))
                     .withColumn("score", F.lit(0.0)))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return PO.masked_argmax(out, "q")
