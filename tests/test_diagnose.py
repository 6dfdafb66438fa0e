"""Failure cascade, entailment vote, reward: every branch on literal rows."""

import pytest
from pyspark.sql import functions as F

from remedy.operators import diagnose as D
from remedy.operators import policy as PO
from remedy.operators import reward as RW


@pytest.mark.parametrize("kg,qe,re,label,fail,verified", [
    ("CONFLICT", "NEUTRAL", "NEUTRAL", "SUPPORTS", "WRONG_PREDICATE_FAILURE", "SUPPORTS"),
    ("CONSISTENT", "NEUTRAL", "ENTAILMENT", "SUPPORTS", "INSUFFICIENT_EVIDENCE_FAILURE", "UNVERIFIED"),
    ("CONSISTENT", "ENTAILMENT", "CONTRADICTION", "SUPPORTS", "WRONG_RESPONSE_FAILURE", "SUPPORTS"),
    ("CONSISTENT", "ENTAILMENT", "NEUTRAL", "REFUTES", "WRONG_RESPONSE_FAILURE", "REFUTES"),
    ("MISSING", "CONTRADICTION", "ENTAILMENT", "SUPPORTS", "LABEL_EVIDENCE_MISMATCH_FAILURE", "UNVERIFIED"),
    ("MISSING", "ENTAILMENT", "ENTAILMENT", "REFUTES", "LABEL_EVIDENCE_MISMATCH_FAILURE", "UNVERIFIED"),
    ("CONSISTENT", "ENTAILMENT", "ENTAILMENT", "SUPPORTS", "NO_FAILURE", "SUPPORTS"),
    ("CONSISTENT", "CONTRADICTION", "ENTAILMENT", "REFUTES", "NO_FAILURE", "REFUTES"),
    # G2 defaults: missing consistency -> MISSING, entailments -> ENTAILMENT, label from query vote
    (None, None, None, None, "NO_FAILURE", "SUPPORTS"),
    (None, "CONTRADICTION", None, None, "NO_FAILURE", "REFUTES"),
])
def test_failure_cascade(spark, kg, qe, re, label, fail, verified):
    df = spark.createDataFrame([(kg, qe, re, label)], "kg string, qe string, re string, label string")
    f, v = D.failure_label(F.col("kg"), F.col("qe"), F.col("re"), F.col("label"))
    got = df.select(f, v).first()
    assert (got[0], got[1]) == (fail, verified)


def test_entailment_vote(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "q long")
    votes = spark.createDataFrame(
        [(1, 0, 1, 1), (1, 1, 1, 1), (2, 0, 2, 1), (2, 1, 0, 2), (3, 0, 2, 2), (3, 1, 1, 2)],
        "q long, r int, query_vote int, response_vote int")
    got = {r.q: (r.query_entailment, r.response_entailment)
           for r in D.entailment_vote(keys, votes, ["q"]).collect()}
    assert got[1] == ("NEUTRAL", "NEUTRAL")          # all neutral
    assert got[2] == ("ENTAILMENT", "CONTRADICTION")  # any entail wins
    assert got[3] == ("CONTRADICTION", "CONTRADICTION")
    assert got[4] == ("NEUTRAL", "NEUTRAL")          # no chunks


def _reward(spark, fail, kg, re, lat, vram, lb=3.0, vb=6.0, gate=True, cost=True):
    df = spark.createDataFrame([(fail, kg, re, lat, vram)], "f string, kg string, re string, lat double, v double")
    r = RW.reward(F.col("f"), F.col("kg"), F.col("re"), F.col("lat"), F.col("v"),
                  F.lit(lb).cast("double") if lb is not None else F.lit(None).cast("double"),
                  F.lit(vb).cast("double") if vb is not None else F.lit(None).cast("double"),
                  F.lit(gate), F.lit(cost))
    return df.select(r.alias("r")).first().r


def test_reward_full_and_parts(spark):
    r = _reward(spark, "NO_FAILURE", "CONSISTENT", "ENTAILMENT", 1.5, 3.0)
    assert r.total_reward == pytest.approx(1.0 * 0.5 * 0.5)
    assert (r.failure_reward, r.consistency_reward, r.factuality_reward) == (1.0, 1.0, 1.0)


def test_reward_gate_implies_zero(spark):
    assert _reward(spark, "NO_FAILURE", "CONSISTENT", "ENTAILMENT", 3.5, 1.0).total_reward == 0.0
    assert _reward(spark, "NO_FAILURE", "CONSISTENT", "ENTAILMENT", 1.0, 6.5).total_reward == 0.0


def test_reward_t7_two_overruns_without_gate(spark):
    # With gating off, two overruns make (1-lat)(1-vram) positive
    r = _reward(spark, "NO_FAILURE", "CONSISTENT", "ENTAILMENT", 6.0, 12.0, gate=False)
    assert r.total_reward == pytest.approx(1.0)


def test_reward_null_budget_neutral(spark):
    r = _reward(spark, "X", "CONFLICT", "ENTAILMENT", 100.0, 100.0, lb=None, vb=None)
    assert r.total_reward == pytest.approx(0.5)
    assert (r.latency_budget_strict, r.latency_rate) == (1.0, 0.0)


def test_binarize(spark):
    df = spark.createDataFrame([(0.39,), (0.4,)], "r double")
    assert [x[0] for x in df.select(RW.binarize(F.col("r"))).collect()] == [0.0, 1.0]


def test_action_space_weights_sum_to_one(spark):
    a = RW.action_space(spark)
    assert a.count() == 11
    assert a.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_one_hot_sums_to_one(spark):
    df = spark.createDataFrame([("WRONG_RESPONSE_FAILURE", "NOTRIPLETS", "NEUTRAL")], "f string, k string, e string")
    r = df.select(PO.one_hot_failure(F.col("f")), PO.one_hot_consistency(F.col("k")),
                  PO.one_hot_entailment(F.col("e"))).first()
    assert r[0] == [0, 0, 0, 1, 0] and r[1] == [0, 0, 0, 0, 1] and r[2] == [0, 0, 1]


def test_budget_features_floor_at_zero(spark):
    df = spark.createDataFrame([(7.0, 4.0), (1.0, 1.0)], "v double, l double")
    got = df.select(*PO.budget_features(F.col("v"), F.col("l"))).collect()
    assert tuple(got[0]) == (0.0, 0.0)
    assert got[1][0] == pytest.approx(5e-5) and got[1][1] == pytest.approx(2e-4)


def test_patchset(spark):
    df = spark.createDataFrame([("UNVERIFIED",), ("SUPPORTS",)], "v string")
    assert [r[0] for r in df.select(D.patchset(F.col("v"))).collect()] == ["retriever", "all"]


def test_allowed_arm_sets(spark):
    df = spark.createDataFrame([(p, a) for p in ("retriever", "generation", "all") for a in (0, 7, 8, 10)],
                               "p string, a int")
    got = {(r.p, r.a): r.ok for r in df.select("p", "a", D.allowed_arm(F.col("p"), F.col("a")).alias("ok")).collect()}
    assert got[("retriever", 7)] and not got[("retriever", 8)]
    assert got[("generation", 8)] and not got[("generation", 0)]
    assert all(got[("all", a)] for a in (0, 7, 8, 10))


def test_repaired_include_first_call(spark):
    from given import SF_SMALL
    from remedy.operators import repair as P
    from remedy.plans.diagnosis import _policy_choice, candidates_diagnosed, diagnosed

    d = _policy_choice(diagnosed(spark, SF_SMALL))
    c = candidates_diagnosed(spark, SF_SMALL)
    a = {r.q: r for r in P.repaired_traces(d, c, "chosen_arm").collect()}
    b = {r.q: r for r in P.repaired_traces(d, c, "chosen_arm", include_first_call=True).collect()}
    pre = {r.q: r for r in d.collect()}
    for q, r in a.items():
        if r.action >= 0:
            assert abs(b[q].latency - (r.latency + pre[q].latency)) < 1e-9
            assert b[q].vram == max(r.vram, pre[q].vram)
            assert b[q].reward.total_reward <= r.reward.total_reward + 1e-12 or r.reward.total_reward == 0
        else:
            assert b[q].latency == r.latency


def test_triple_rollup_and_answer_consistency_branches(spark):
    from remedy.operators import triples as TR

    claims = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "answer_id long")
    status = spark.createDataFrame(
        [(1, 10, "MISSING"), (1, 11, "CONSISTENT"),   # any CONSISTENT wins
         (2, 10, "MISSING"), (2, 12, "CONFLICT"),     # else CONFLICT
         (3, 10, "MISSING"),                          # else MISSING
         (5, 13, "CONSISTENT")],
        "answer_id long, fact_id long, status string")
    per = {r.answer_id: r.status for r in TR.triple_rollup(status, claims).collect()}
    assert per == {1: "CONSISTENT", 2: "CONFLICT", 3: "MISSING", 4: "MISSING", 5: "CONSISTENT"}  # T5: 4 has no candidates

    answers = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (6, ""), (7, "text but no triple"), (5, "e")], "answer_id long, answer_text string")
    per_triple = spark.createDataFrame(
        [(1, "CONSISTENT"), (2, "CONFLICT"), (2, "MISSING"), (3, "MISSING"), (5, "CONSISTENT")],
        "answer_id long, status string")
    got = {r.answer_id: r.consistency for r in TR.answer_consistency(answers, per_triple).collect()}
    assert got == {1: "CONSISTENT", 2: "CONFLICT", 3: "MISSING", 6: "EMPTYINPUT", 7: "NOTRIPLETS", 5: "CONSISTENT"}


def test_check_status_thresholds(spark):
    from remedy.operators import triples as TR

    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.8, 0.6], [1.0, 0.0], [1.0, 0.0]),   # subject 0.8 < 0.9
         ([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]),   # relation 0 < 0.9
         ([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]),   # object 0 < 0.1
         ([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.6, 0.8])],  # object 0.6 >= 0.1
        "qs array<double>, qr array<double>, qo array<double>, ds array<double>, dr array<double>, do array<double>")
    got = [r[0] for r in df.select(TR.check_status(*[F.col(c) for c in ("qs", "qr", "qo", "ds", "dr", "do")])).collect()]
    assert got == ["MISSING", "MISSING", "CONFLICT", "CONSISTENT"]
