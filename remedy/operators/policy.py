"""Policy features, bandit fits and scores.

Additive policies (LinUCB, Thompson, UCB) are plain aggregates, so a batch fit
over a log equals the sequential fit. The epsilon-greedy SGD fold is sequential,
but each update is an affine map of the weights, so blocks of the ordered log are
composed in parallel and then combined in order (exact, no single-task group).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from remedy.plans.fixtures import CONSISTENCY_LEVELS, ENTAILMENT_LEVELS, FAILURE_LABELS

LINUCB_ALPHA = 2.0
EPSILON = 0.1
SGD_LR = 0.01
KERNEL_EPS = 1e-5


# ---- features -------------------------------------------------------------------

def _one_hot(c: Column, levels) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in levels]), lambda x: (x == c).cast("int"))


def one_hot_failure(c: Column) -> Column:
    return _one_hot(c, FAILURE_LABELS)


def one_hot_consistency(c: Column) -> Column:
    return _one_hot(c, CONSISTENCY_LEVELS)


def one_hot_entailment(c: Column) -> Column:
    return _one_hot(c, ENTAILMENT_LEVELS)


def budget_features(vram_used: Column, latency: Column, vram_budget: float = 6.0,
                    latency_budget: float = 3.0) -> tuple[Column, Column]:
    """Headroom features, floored at zero."""
    return (F.greatest(F.lit(0.0), (F.lit(vram_budget) - vram_used) / F.lit(1e5)),
            F.greatest(F.lit(0.0), (F.lit(latency_budget) - latency) / F.lit(1e4)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def context_vector(df: DataFrame, embedding_col: str = "qv") -> DataFrame:
    """Embedding ++ failure(5) ++ consistency(5) ++ query entail(3) ++ response
    entail(3) ++ budget(2), as ARRAY<DOUBLE>."""
    vh, lh = budget_features(F.col("vram"), F.col("latency"))
    parts = [F.col(embedding_col).cast("array<double>"),
             one_hot_failure(F.col("failure_label")).cast("array<double>"),
             one_hot_consistency(F.col("kg_consistency")).cast("array<double>"),
             one_hot_entailment(F.col("query_entailment")).cast("array<double>"),
             one_hot_entailment(F.col("response_entailment")).cast("array<double>"),
             F.array(vh, lh)]
    return df.withColumn("x", F.concat(*parts))


def with_query_embedding(df: DataFrame, vectors: DataFrame, n_rows: int, key: str = "q") -> DataFrame:
    """I1 default: the query embedding is an embeddings row (key mod n_rows, the rows
    of the table)."""
    v = vectors.select(F.col("vec_id").alias("_row"), F.col("v").alias("qv"))
    return df.withColumn("_row", F.col(key) % n_rows).join(v, "_row").drop("_row")


# ---- additive fits ----------------------------------------------------------------

LINUCB_STATE = "arm long, node long, a array<double>, b array<double>, n long"


def _state_batch(arm: int, node: int, a: np.ndarray, b: np.ndarray, n: int) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([arm]), pa.array([node]), one(a), one(b), pa.array([n])],
                                      names=["arm", "node", "a", "b", "n"])


def _outer_partials(d: int):
    """Per-partition, per-arm sums of x x^T and r x: one row of whole arrays per arm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            arms = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            r = batch.column(2).to_numpy(zero_copy_only=False)
            for arm in np.unique(arms):
                xs, rs = x[arms == arm], r[arms == arm]
                s = acc.setdefault(int(arm), [np.zeros((d, d)), np.zeros(d), 0])
                s[0] += xs.T @ xs
                s[1] += xs.T @ rs
                s[2] += len(rs)
        node = TaskContext.get().partitionId()
        for arm, (m, v, n) in acc.items():
            yield _state_batch(arm, node, m, v, n)

    return run


def _sum_states(key: tuple, t: pa.Table) -> pa.Table:
    add = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(axis=0)
    return pa.Table.from_batches([_state_batch(key[0].as_py(), key[1].as_py(), add("a"), add("b"), sum(t.column("n").to_pylist()))])


def linucb_fit(log: DataFrame, d: int, fan_in: int = 8) -> DataFrame:
    """Per arm sum x x^T (flattened, d x d), sum r x and the number of rows, from a log
    (arm, x, r): (arm, a, b, n); A is a + I.

    Every partition gives one row per arm; whole arrays are summed ``fan_in`` at a time in a
    tree keyed by (arm, node), so a task holds ``fan_in`` matrices, and the rows shuffled are
    partitions x arms, whatever d is."""
    from remedy.session import cut_lineage

    parts = log.select(F.col("arm").cast("long"), "x", F.col("r").cast("double"))
    level = cut_lineage(parts.mapInArrow(_outer_partials(d), LINUCB_STATE))
    top = level.agg(F.max("node")).first()[0] or 0
    while True:
        level = level.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("arm", "node").applyInArrow(_sum_states, LINUCB_STATE)
        top //= fan_in
        if not top:
            return cut_lineage(level).drop("node")
        level = cut_lineage(level)


def thompson_fit(log: DataFrame, arms: DataFrame) -> DataFrame:
    """alpha = 1 + sum r, beta = 1 + sum (1 - r) per arm (all arms listed)."""
    s = log.groupBy("arm").agg(F.sum("r").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return (arms.select("arm").join(s, "arm", "left")
            .select("arm", (1 + F.coalesce("_s", F.lit(0.0))).alias("alpha"),
                    (1 + F.coalesce(F.col("_n") - F.col("_s"), F.lit(0.0))).alias("beta")))


def _hash_uniform(q: np.ndarray, arm: np.ndarray, salt: int) -> np.ndarray:
    """Uniforms in (0, 1) from (q, arm, salt) by 64-bit mixing: the same row always draws
    the same number, whatever batch it comes in."""
    with np.errstate(over="ignore"):
        x = q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + arm.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x += np.uint64(salt * 0x8CB92BA72F3D8DD7 % 2**64)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _gamma_draws(q: np.ndarray, arm: np.ndarray, shape: np.ndarray, salt: int) -> np.ndarray:
    """Gamma(shape >= 1) draws by squeezing cubed normals, tried until accepted (a try is with
    a probability above 0.95)."""
    d = shape - 1 / 3
    c, out = 1 / np.sqrt(9 * d), d.copy()
    left, t = np.ones(len(d), dtype=bool), 0
    while left.any():
        u1, u2, u3 = (_hash_uniform(q, arm, salt + 3 * t + j) for j in range(3))
        z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + c * z) ** 3
        ok = left & (v > 0)
        ok[ok] = np.log(u3[ok]) < 0.5 * z[ok] ** 2 + d[ok] * (1 - v[ok] + np.log(v[ok]))
        out[ok], left, t = d[ok] * v[ok], left & ~ok, t + 1
    return out


def beta_draws(q: pd.Series, arm: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """Beta(alpha, beta) draws keyed by (q, arm), as a ratio of two Gamma draws."""
    qq, aa = q.to_numpy(np.int64), arm.to_numpy(np.int64)
    x = _gamma_draws(qq, aa, alpha.to_numpy(np.float64), 1)
    y = _gamma_draws(qq, aa, beta.to_numpy(np.float64), 1001)
    return pd.Series(x / (x + y))


# ---- one protocol for the policies ----------------------------------------------------

@dataclass(frozen=True)
class Policy:
    """A policy is a fit of a log (arm, x, r, step) to a state table, and a score of
    contexts (q, x, retriever_only) under that state: (q, arm, score). ``select`` plays
    the allowed arm with the highest score."""
    name: str
    fit: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame, DataFrame], DataFrame]

    def select(self, contexts: DataFrame, state: DataFrame) -> DataFrame:
        s = self.score(contexts, state)
        if "retriever_only" not in s.columns:
            s = s.join(contexts.select("q", "retriever_only"), "q")
        return masked_argmax(s, "q", ~F.col("retriever_only") | (F.col("arm") < 8))


def thompson_policy(arms: DataFrame) -> Policy:
    draw = F.pandas_udf(beta_draws, "double")

    def score(ctx: DataFrame, state: DataFrame) -> DataFrame:
        x = ctx.select("q", "retriever_only").crossJoin(F.broadcast(state))  # one row per arm
        return x.select("q", "arm", "retriever_only", draw("q", "arm", "alpha", "beta").alias("score"))

    return Policy("thompson", lambda log: thompson_fit(log, arms), score)


def ucb_policy(arms: DataFrame) -> Policy:
    def score(ctx: DataFrame, state: DataFrame) -> DataFrame:
        s = F.coalesce("ucb", F.lit(float("inf")))  # an arm never played comes first
        return ctx.select("q", "retriever_only").crossJoin(F.broadcast(ucb_score(state))).select(
            "q", "arm", "retriever_only", s.alias("score"))

    return Policy("ucb", lambda log: ucb_fit(log, arms), score)


def greedy_policy(arms: DataFrame, d: int, lr: float = SGD_LR) -> Policy:
    def score(ctx: DataFrame, state: DataFrame) -> DataFrame:
        return ctx.select("q", "x", "retriever_only").crossJoin(F.broadcast(state)).select(
            "q", "arm", "retriever_only", dot(F.col("x"), F.col("w")).alias("score"))

    return Policy("epsgreedy", lambda log: epsgreedy_fit(log, d, lr, arms=arms), score)


def ucb_fit(log: DataFrame, arms: DataFrame) -> DataFrame:
    """Pulls and mean reward per arm, total pulls."""
    s = log.groupBy("arm").agg(F.count(F.lit(1)).alias("pulls"), F.avg("r").alias("mean_reward"))
    j = arms.select("arm").join(s, "arm", "left").select(
        "arm", F.coalesce("pulls", F.lit(0)).alias("pulls"), F.coalesce("mean_reward", F.lit(0.0)).alias("mean_reward"))
    return j.withColumn("total_pulls", F.sum("pulls").over(W.partitionBy()))


def ucb_score(fit: DataFrame) -> DataFrame:
    """mean + sqrt(2 ln N / n); an unpulled arm is played first (lowest index)."""
    s = F.when(F.col("pulls") == 0, F.lit(None).cast("double")).otherwise(
        F.col("mean_reward") + F.sqrt(2 * F.log(F.col("total_pulls").cast("double")) / F.col("pulls")))
    x = fit.withColumn("ucb", s)
    key = F.struct(F.when(F.col("pulls") == 0, 1).otherwise(0), F.coalesce("ucb", F.lit(0.0)), -F.col("arm"))
    choice = x.agg(F.max_by("arm", key).alias("_c"))
    return x.crossJoin(choice).withColumn("is_choice", F.col("arm") == F.col("_c")).drop("_c")


def masked_argmax(scores: DataFrame, key: str = "q", allowed: Column | None = None) -> DataFrame:
    """arm with the highest score among the allowed arms; lowest arm on ties."""
    s = scores if allowed is None else scores.filter(allowed)
    return s.groupBy(key).agg(F.max_by("arm", F.struct(F.col("score"), -F.col("arm"))).alias("arm"))


# ---- LinUCB scoring (matrices per arm are small: arms x d x d) ------------------------

def linucb_state(fit: DataFrame, d: int):
    """The arrays of every arm (at most 11 rows, bounded by the model, not the data), A
    inverted once per arm."""
    state = {}
    for r in fit.toArrow().to_batches():
        for arm, a, b in zip(r.column("arm").to_pylist(), r.column("a"), r.column("b")):
            inv = np.linalg.inv(np.asarray(a.values).reshape(d, d) + np.eye(d))
            state[arm] = (inv, inv @ np.asarray(b.values))
    return state


def linucb_score(ctx: DataFrame, state: dict, n_arms: int, d: int, alpha: float = LINUCB_ALPHA) -> DataFrame:
    """F8: p = theta.x + alpha sqrt(x^T A^-1 x) for every allowed arm (arms without
    state use A = I, b = 0), masked argmax with the lowest arm on ties."""
    spark = ctx.sparkSession
    full = {a: state.get(a, (np.eye(d), np.zeros(d))) for a in range(n_arms)}
    bst = spark.sparkContext.broadcast(full)
    schema = "q long, arm long, score double"

    def run(batches):
        st = bst.value
        for bt in batches:
            if bt.empty:
                continue
            x = np.asarray(bt["x"].tolist(), dtype=np.float64)
            allow8 = bt["retriever_only"].to_numpy()
            rows = []
            for a in range(n_arms):
                inv, theta = st[a]
                p = x @ theta + alpha * np.sqrt(np.einsum("ij,jk,ik->i", x, inv, x))
                ok = (~allow8) | (a < 8)
                rows.append(pd.DataFrame({"q": bt["q"].to_numpy()[ok], "arm": a, "score": p[ok]}))
            yield pd.concat(rows)

    return ctx.select("q", "x", "retriever_only").mapInPandas(run, schema)


# ---- epsilon-greedy: exact parallel SGD fold -----------------------------------------

def _compose_block(d: int, lr: float):
    """Compose the affine updates w -> (I - lr x x^T) w + lr r x of one ordered block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        M = np.eye(d)
        c = np.zeros(d)
        for x, r in zip(pdf["x"], pdf["r"]):
            x = np.asarray(x, dtype=np.float64)
            M -= lr * np.outer(x, x @ M)  # rank-one update
            c += lr * (r - x @ c) * x
        return pd.DataFrame({"arm": [int(pdf["arm"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                             "first": [int(pdf["step"].iloc[0])], "m": [M.ravel().tolist()], "c": [c.tolist()]})

    return run


def _compose_maps(d: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        M = np.eye(d)
        c = np.zeros(d)
        for m, ci in zip(pdf["m"], pdf["c"]):
            Mi = np.asarray(m, dtype=np.float64).reshape(d, d)
            M = Mi @ M
            c = Mi @ c + np.asarray(ci, dtype=np.float64)
        return pd.DataFrame({"arm": [int(pdf["arm"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                             "first": [int(pdf["first"].iloc[0])], "m": [M.ravel().tolist()], "c": [c.tolist()]})

    return run


def epsgreedy_maps(log: DataFrame, d: int, lr: float = SGD_LR, block_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """The affine map w -> M w + c that the rows of a log (arm, step, x, r) make per arm, in
    step order: (arm, first, m, c).

    Every update is affine in w, so the ordered log is cut into blocks of ``block_rows``; each
    block's composite map is computed in parallel, then maps are composed in order, ``fan_in``
    at a time, until one per arm remains. Group sizes stay bounded at every level, and each
    level is materialised before its size is read."""
    from remedy.session import cut_lineage

    schema = ("arm long, block long, first long, m array<double>, c array<double>")
    x = log.select(F.col("arm").cast("long"), F.col("step").cast("long"), "x", F.col("r").cast("double"))
    # Blocks are ranges of the global step order; a (arm, block) group holds at
    # most block_rows rows, so no arm is ever gathered into one task.
    x = x.withColumn("block", (F.col("step") / F.lit(block_rows)).cast("long"))
    maps = cut_lineage(x.groupBy("arm", "block").applyInPandas(_compose_block(d, lr), schema))
    while True:
        n = maps.groupBy("arm").count().agg(F.max("count")).collect()[0][0]
        if n is None or n <= 1:
            return maps.drop("block")
        maps = cut_lineage(maps.withColumn("block", (F.col("block") / F.lit(fan_in)).cast("long"))
                               .groupBy("arm", "block").applyInPandas(_compose_maps(d), schema))


def epsgreedy_fit(log: DataFrame, d: int, lr: float = SGD_LR, block_rows: int = 4096,
                  fan_in: int = 64, arms: DataFrame | None = None) -> DataFrame:
    """Per-arm SGD weights ``w += lr (r - w.x) x`` over the log in ``step`` order, from the
    maps of its blocks: w = c (w0 = 0). With ``arms`` every arm has a row."""
    fitted = epsgreedy_maps(log, d, lr, block_rows, fan_in).select("arm", F.col("c").alias("w"))
    if arms is None:
        return fitted
    zero = F.array_repeat(F.lit(0.0), d)  # an arm without rows keeps its starting weights
    return arms.select(F.col("arm").cast("long")).join(fitted, "arm", "left").select("arm", F.coalesce("w", zero).alias("w"))


def advance(state: DataFrame, maps: DataFrame, d: int) -> DataFrame:
    """State (arm, pulls, w) after the maps (arm, n, m, c) of a batch: w -> M w + c. An arm
    without state starts at 0; one without a map stays."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = []
            for wi, m, c in zip(b["w"], b["m"], b["c"]):
                v = np.zeros(d) if wi is None else np.asarray(wi)
                w.append(v if m is None else np.asarray(m).reshape(d, d) @ v + np.asarray(c))
            yield pd.DataFrame({"arm": b["arm"], "pulls": b["pulls"], "w": w})

    j = state.join(maps, "arm", "full").withColumn("pulls", F.coalesce("pulls", F.lit(0)) + F.coalesce("n", F.lit(0)))
    return j.select("arm", "pulls", "w", "m", "c").mapInPandas(run, "arm long, pulls long, w array<double>")


# ---- KernelUCB (closed form of the rank-one inverse) -----------------------------------

def arm_moments(log: DataFrame, d: int) -> DataFrame:
    """Per-arm b = sum r x (d) and G = sum x x^T (d x d, flattened) as arrays."""
    return linucb_fit(log, d).select("arm", "b", F.col("a").alias("G"))


def kernelucb_linear(ctx: DataFrame, log: DataFrame, arms: DataFrame, alpha: float = 1.0,
                     eps: float = KERNEL_EPS, dim: int | None = None) -> DataFrame:
    """E20, linear kernel: with K_h = x.x_h, sum K r = x.b and sum K^2 = x^T G x
    (b = sum r x_h, G = sum x_h x_h^T per arm), so per-arm moments replace the
    (context, history) pairs. mu = x.b / (eps + x^T G x);
    sigma^2 = x.x - x^T G x / (eps + x^T G x); arms without history score
    alpha * sqrt(x.x).

    The moments (arms x d^2 values, bounded by the model) are collected once and
    broadcast; contexts are scored in Arrow batches with NumPy (mapInPandas)."""
    d = log.select(F.size("x")).first()[0] if dim is None else dim
    spark = ctx.sparkSession
    mom = {int(r["arm"]): (np.asarray(r["b"], dtype=np.float64), np.asarray(r["G"], dtype=np.float64).reshape(d, d))
           for r in arm_moments(log, d).collect()}
    arm_ids = sorted(int(r["arm"]) for r in arms.select("arm").collect())
    bst = spark.sparkContext.broadcast((arm_ids, mom))
    keep = [c for c in ("retriever_only",) if c in ctx.columns]  # carried through

    def run(batches):
        ids, m = bst.value
        for b in batches:
            if b.empty:
                continue
            x = np.asarray(b["x"].tolist(), dtype=np.float64)
            kxx = (x * x).sum(axis=1)
            out = []
            for a in ids:
                if a in m:
                    bv, G = m[a]
                    s1 = x @ bv
                    s2 = ((x @ G) * x).sum(axis=1)
                    sc = s1 / (eps + s2) + alpha * np.sqrt(np.maximum(0.0, kxx - s2 / (eps + s2)))
                else:
                    sc = alpha * np.sqrt(kxx)
                out.append(pd.DataFrame({"q": b["q"].to_numpy(), "arm": np.int64(a), "score": sc,
                                         **{c: b[c].to_numpy() for c in keep}}))
            yield pd.concat(out)

    schema = "q long, arm long, score double" + "".join(f", {c} boolean" for c in keep)
    return ctx.select("q", "x", *keep).mapInPandas(run, schema)


def neural_linear_score(ctx: DataFrame, weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    """F12 (scoring only): p = f.w_arm + alpha * ||f|| given features f and weights."""
    j = ctx.select("q", "x").crossJoin(F.broadcast(weights.select("arm", "w")))  # arms: fixed 11 rows
    return j.select("q", "arm", (dot(F.col("x"), F.col("w")) + alpha * norm(F.col("x"))).alias("score"))
