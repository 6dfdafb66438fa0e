"""Tests of the executor-side dense top-k, resumable streams, model hooks, the policy
protocol, Beta draws and whole-table coverage."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from given import SF_SMALL
from remedy.functions import hooks as H
from remedy.operators import metrics as M
from remedy.operators import policy as PO
from remedy.operators import retrieve as R
from remedy.operators import reward as RW
from remedy.plans import fixtures as X
from remedy.plans import policies as PQ
from remedy.streaming import jobs as S


def test_dense_topk_blocks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(230, 5)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = R.dense_topk(df, df.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "q_id"), 4, part_rows=50, batch_rows=20)
    by = {}
    for r in got.collect():
        by.setdefault(r.q_id, {})[r["rank"]] = r.vec_id
    d = ((x[:, None] - x[None]) ** 2).sum(-1).round(6)
    for q in range(0, 230, 3):
        want = sorted(range(230), key=lambda j: (d[q, j], j))[:4]
        assert [by[q][k] for k in range(1, 5)] == want
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "BroadcastExchange" not in plan


def test_dense_topk_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>")
    none = df.limit(0)
    assert R.dense_topk(df, none.withColumnRenamed("vec_id", "q_id")).count() == 0
    assert R.dense_topk(none, df.withColumnRenamed("vec_id", "q_id")).count() == 0


def test_every_embedding_row_is_an_element(spark):
    n = X.n_vectors(spark, SF_SMALL)
    f = X.facts(spark, SF_SMALL)
    rows = f.agg(F.max("s_row"), F.max("o_row"), F.collect_set("r_row")).first()
    assert rows[0] < n - 2 and rows[1] < n - 2 and sorted(rows[2]) == [n - 2, n - 1]


@pytest.fixture
def event_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", folder / "events.parquet")
    shutil.copy(f"{SF_SMALL}/documents.parquet", folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("mode, key", [("append", ()), ("complete", ())])
def test_second_run_on_the_same_path_adds_nothing(spark, event_folder, tmp_path, mode, key):
    build = {"append": S.diagnose_stream, "complete": S.policy_stream}[mode]

    def run():
        ev = S.read_table_stream(spark, event_folder, "events", S.EVENTS_SCHEMA)
        out = S.run_to_table(spark, build(ev), "t", mode, key, path=str(tmp_path / f"out-{mode}"))
        return sorted(map(str, out.collect()))

    first = run()
    assert first and run() == first


def test_reindex_resumes_and_grows(spark, event_folder, tmp_path):
    def run():
        docs = S.read_table_stream(spark, event_folder, "documents", S.DOCS_SCHEMA)
        idx = S.run_reindex(spark, docs, str(tmp_path / "index"))
        return idx.postings.count(), tuple(idx.stats.first()), idx.df.count()

    first = run()
    assert run() == first
    shutil.copy(f"{SF_SMALL}/documents.parquet", f"{event_folder}/documents-2.parquet")
    more = run()
    assert more[0] == 2 * first[0] and more[1][0] == 2 * first[1][0] and more[1][1] == pytest.approx(first[1][1])
    assert more[2] == first[2]


def test_retried_batch_leaves_no_duplicates(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20)
    for _ in range(2):
        S.reindex_batch(docs, str(tmp_path / "i"), 0)
    assert spark.read.parquet(str(tmp_path / "i" / "stats")).count() == 1


def test_hooks_with_loaders_and_defaults(spark):
    df = spark.createDataFrame([("ab", "b", [0.5], 1), ("c", "d", [1.0], 2)], "t string, h string, v array<float>, n int")
    embed = H.embedder(lambda: lambda s: s.map(lambda x: [float(len(x))]))
    nli = H.nli_classifier(lambda: lambda p, h: pd.Series([0 if b in a else 1 for a, b in zip(p, h)], dtype="int32"))
    triplets = H.triplet_extractor(lambda: lambda s: "<triplet> " + s)
    gen = H.generator(lambda: lambda s: s.str.upper())
    r = df.select(embed(F.col("t")).alias("e"), nli(F.col("t"), F.col("h")).alias("c"),
                  triplets(F.col("t")).alias("x"), gen(F.col("t")).alias("g")).collect()
    assert [(list(x.e), x.c, x.x, x.g) for x in r] == [([2.0], 0, "<triplet> ab", "AB"), ([1.0], 1, "<triplet> c", "C")]
    d = df.select(H.embedder(column="v")(F.col("t")).alias("e"), H.nli_classifier(column="n")(F.col("t"), F.col("h")).alias("c"),
                  H.triplet_extractor(column="t")(F.col("h")).alias("x"), H.generator(column="h")(F.col("t")).alias("g")).collect()
    assert [(list(x.e), x.c, x.x, x.g) for x in d] == [([0.5], 1, "ab", "b"), ([1.0], 2, "c", "d")]


def test_beta_draws_have_the_moments_and_ignore_batches():
    n = 40_000
    for a, b in ((1.0, 1.0), (3.0, 9.0), (400.0, 250.0)):
        q, arm = pd.Series(np.arange(n)), pd.Series(np.full(n, 4))
        x = PO.beta_draws(q, arm, pd.Series(np.full(n, a)), pd.Series(np.full(n, b)))
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(x.mean() - mean) < 4 * np.sqrt(var / n) + 1e-4 and abs(x.var() / var - 1) < 0.05
        part = PO.beta_draws(q[100:110], arm[100:110], pd.Series(np.full(10, a)), pd.Series(np.full(10, b)))
        assert np.array_equal(part.to_numpy(), x[100:110].to_numpy())


def test_policies_share_one_protocol(spark):
    log, ctx = PQ.log(spark, SF_SMALL, False).cache(), PQ.contexts(spark, SF_SMALL, False)
    arms = RW.action_space(spark)
    binary = log.withColumn("r", RW.binarize(F.col("r")))
    for p, rows in ((PO.thompson_policy(arms), binary), (PO.ucb_policy(arms), log), (PO.greedy_policy(arms, PQ.DIAG_DIM), log)):
        state = p.fit(rows)
        assert state.count() == X.N_ARMS
        got = p.select(ctx, state).collect()
        assert len(got) == ctx.count()
        masked = {r.q for r in ctx.filter("retriever_only").collect()}
        assert all(r.arm < 8 for r in got if r.q in masked)


def test_every_arm_keeps_weights(spark):
    log = spark.createDataFrame([(2, 0, [1.0, 0.5], 1.0), (2, 1, [0.0, 1.0], 0.5)], "arm long, step long, x array<double>, r double")
    w = {r.arm: list(r.w) for r in PO.epsgreedy_fit(log, 2, arms=RW.action_space(spark)).collect()}
    assert len(w) == X.N_ARMS and w[0] == [0.0, 0.0]
    v = np.zeros(2)
    for x, r in (([1.0, 0.5], 1.0), ([0.0, 1.0], 0.5)):
        v = v + PO.SGD_LR * (r - v @ np.array(x)) * np.array(x)
    assert np.allclose(w[2], v)


def test_plans_scan_events_once_or_twice(spark):
    for df, most in ((PQ.log(spark, SF_SMALL, True), 1), (PQ.contexts(spark, SF_SMALL, False), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("event_id#") and \
            df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [event_id") <= most


def test_bootstrap_of_several_metrics_equals_each(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(rng.normal()), None if i % 5 == 0 else float(i)) for i in range(60)],
                               "id long, g string, x double, y double")
    both = {(r.metric, r.g): tuple(r)[2:] for r in M.bootstrap_metrics(df, "g", ["x", "y"], "id").collect()}
    for m in ("x", "y"):
        for r in M.bootstrap_ci(df, "g", m, "id").collect():
            assert both[(m, r.g)] == tuple(r)[1:]


def test_local_checkpoint_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from remedy import session
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:1"))
    with pytest.raises(ValueError):
        session.checkpoint_dir(fake)


def test_latest_of_repeated_pages(spark):
    from remedy.operators import corpus as C
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only"), ("a", 3, "new")],
                               "page_id string, ord int, lines string")
    assert sorted((r.page_id, r.lines) for r in C.latest_pages(df, "page_id", "ord").collect()) == [("a", "new"), ("b", "only")]


@pytest.mark.parametrize("broken, label, response", [
    ('{"label": "SUPPORTS", "response": "it is', "SUPPORTS", "it is"),
    ('{"label": "SUPPORTS", "response": "a, b",}', "SUPPORTS", "a, b"),
    ("{'label': 'REFUTES', 'response': 'no'}", "REFUTES", "no"),
    ('```json\n{"label": "SUPPORTS", "response": "x"\n```', "SUPPORTS", "x"),
    ('chatter {"label": "SUPPORTS", "response": "say \\"hi\\" {now}"} end', "SUPPORTS", 'say "hi" {now}'),
    ("no json at all", None, None),
])
def test_reply_repair(spark, broken, label, response):
    from remedy.functions import reply as RP
    r = spark.createDataFrame([(broken,)], "t string").select(RP.parse_reply(F.col("t")).alias("p")).first().p
    assert (r.label, r.response, r.parse_ok) == (label, response, label is not None)
