"""Bandit fits and scores against NumPy references (brute force, small fixtures)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remedy.operators import policy as PO
from remedy.operators import reward as RW


def _log(spark, n=300, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    arm = rng.integers(0, 4, size=n)
    r = rng.uniform(size=n)
    rows = [(int(i), int(arm[i]), x[i].tolist(), float(r[i])) for i in range(n)]
    return spark.createDataFrame(rows, "step long, arm long, x array<double>, r double").repartition(3), x, arm, r


def test_linucb_fit_symmetric_and_exact(spark):
    lg, x, arm, r = _log(spark)
    for fan_in in (2, 8):
        fit = {f.arm: f for f in PO.linucb_fit(lg.repartition(7), 5, fan_in).collect()}
        assert sorted(fit) == [0, 1, 2, 3]
        for k in range(4):
            xs = x[arm == k]
            assert np.allclose(np.array(fit[k].a).reshape(5, 5), xs.T @ xs) and fit[k].n == len(xs)
            assert np.allclose(fit[k].b, xs.T @ r[arm == k])


def test_linucb_score_of_wide_contexts(spark):
    """d = 120: the scores of the summed arrays equal those of the whole log in NumPy."""
    lg, x, arm, r = _log(spark, n=60, d=120, seed=4)
    state = PO.linucb_state(PO.linucb_fit(lg.filter("arm = 2"), 120), 120)
    cx = np.random.default_rng(6).normal(size=(3, 120))
    ctx = spark.createDataFrame([(i, cx[i].tolist(), False) for i in range(3)], "q long, x array<double>, retriever_only boolean")
    got = {(s.q, s.arm): s.score for s in PO.linucb_score(ctx, state, 3, 120, 2.0).collect()}
    xs = x[arm == 2]
    inv = np.linalg.inv(np.eye(120) + xs.T @ xs)
    for i in range(3):
        assert got[(i, 2)] == pytest.approx(inv @ (xs.T @ r[arm == 2]) @ cx[i] + 2.0 * np.sqrt(cx[i] @ inv @ cx[i]))
        assert got[(i, 0)] == pytest.approx(2.0 * np.sqrt(cx[i] @ cx[i]))


def test_linucb_score_matches_numpy(spark):
    lg, x, arm, r = _log(spark)
    state = PO.linucb_state(PO.linucb_fit(lg, 5), 5)
    rng = np.random.default_rng(5)
    cx = rng.normal(size=(6, 5))
    ctx = spark.createDataFrame([(i, cx[i].tolist(), i % 2 == 0) for i in range(6)],
                                "q long, x array<double>, retriever_only boolean")
    got = {(r.q, r.arm): r.score for r in PO.linucb_score(ctx, state, 11, 5, 2.0).collect()}
    for k in range(4):
        xs = x[arm == k]
        Ainv = np.linalg.inv(np.eye(5) + xs.T @ xs)
        theta = Ainv @ (xs.T @ r[arm == k])
        for i in range(6):
            want = theta @ cx[i] + 2.0 * np.sqrt(cx[i] @ Ainv @ cx[i])
            assert got[(i, k)] == pytest.approx(want)
    assert (0, 9) not in got and (1, 9) in got  # retriever-only rows see arms 0-7 only


def test_thompson_alpha_beta_sum(spark):
    lg, _, arm, _ = _log(spark)
    lg = lg.withColumn("r", RW.binarize(F.col("r")))
    fit = {r.arm: r for r in PO.thompson_fit(lg, RW.action_space(spark)).collect()}
    for k in range(11):
        assert fit[k].alpha + fit[k].beta == pytest.approx(2 + (arm == k).sum())


def test_ucb_unpulled_arm_first(spark):
    lg, _, _, _ = _log(spark)
    s = PO.ucb_score(PO.ucb_fit(lg, RW.action_space(spark))).filter("is_choice").first()
    assert s.arm == 4 and s.pulls == 0


def test_epsgreedy_parallel_fold_equals_sequential(spark):
    lg, x, arm, r = _log(spark, n=257, d=4, seed=3)
    got = {row.arm: np.array(row.w) for row in PO.epsgreedy_fit(lg, 4, lr=0.05, block_rows=7, fan_in=3).collect()}
    for k in range(4):
        w = np.zeros(4)
        for i in np.where(arm == k)[0]:
            w += 0.05 * (r[i] - w @ x[i]) * x[i]
        assert np.allclose(got[k], w)


def test_kernelucb_linear_matches_matrix_form(spark):
    lg, x, arm, r = _log(spark, n=40, d=3, seed=7)
    ctx_x = np.random.default_rng(8).normal(size=(5, 3))
    ctx = spark.createDataFrame([(i, ctx_x[i].tolist()) for i in range(5)], "q long, x array<double>")
    got = {(row.q, row.arm): row.score for row in
           PO.kernelucb_linear(ctx, lg, RW.action_space(spark), alpha=1.0, dim=3).collect()}
    for k in range(11):
        hist = x[arm == k]
        for i in range(5):
            c = ctx_x[i]
            if len(hist) == 0:
                want = np.sqrt(c @ c)
            else:
                K = hist @ c
                Kinv = np.linalg.inv(np.outer(K, K) + np.eye(len(K)) * 1e-5)
                mu = K @ Kinv @ r[arm == k]
                want = mu + np.sqrt(c @ c - K @ Kinv @ K)
            assert got[(i, k)] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_masked_argmax_lowest_arm_on_ties(spark):
    s = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.9), (1, 2, 0.9), (1, 9, 5.0)], "q long, arm long, score double")
    got = PO.masked_argmax(s, "q", F.col("arm") < 8).first()
    assert got.arm == 2
