"""Corpus operators, ordering helpers, and stream-equals-batch."""

from pyspark.sql import functions as F

from given import SF_SMALL
from remedy.operators import corpus as C


def test_explode_evidence_first_tuple_null_page(spark):
    rows = [(1, [[["a", "b", "P1", "3"], ["a", "b", "P2", "4"]], [["a", None, None, None]]]),
            (2, [[["x", "y", "P1", "0"]]])]
    df = spark.createDataFrame(rows, "id long, evidence array<array<array<string>>>")
    got = sorted((r.claim_id, r.page, r.sent_idx) for r in C.explode_evidence(df).collect())
    assert got == [(1, "P1", 3), (2, "P1", 0)]
    inv = {(r.page, r.claim_id): r.n_refs for r in C.inverse_evidence(C.explode_evidence(df)).collect()}
    assert inv == {("P1", 1): 1, ("P1", 2): 1}


def test_evidence_lookup_and_audit(spark):
    ev = spark.createDataFrame([(1, 0, "P1", 1), (1, 1, "P9", 0), (2, 0, "P1", 5)],
                               "claim_id long, set_idx int, page string, sent_idx int")
    pages = spark.createDataFrame([("P1", "0\tA\tx\n1\tB")], "page_id string, lines string")
    sents = C.page_sentences(pages)
    assert [(r.claim_id, r.sentence) for r in C.evidence_sentences(ev, sents).collect()] == [(1, "B")]
    assert sorted((r.claim_id, r.page) for r in C.evidence_missing(ev, sents).collect()) == [(1, "P9"), (2, "P1")]


def test_global_rank_is_total_order(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1009)
    got = [r.k for r in C.global_rank(df, ["k", "id"], "rank").orderBy("rank").collect()]
    assert got == sorted(got) and C.global_rank(df, ["k", "id"]).select("rank").distinct().count() == 1000


def test_sample_with_replacement_exact_k(spark):
    df = spark.range(0, 37).withColumnRenamed("id", "q_id")
    s = C.sample_with_replacement(df, "q_id", 200, 42)
    assert s.count() == 200 and s.select("draw").distinct().count() == 200


def test_stream_equals_batch_diagnosis(spark):
    from remedy.plans.diagnosis import diagnosed
    from remedy.plans.streams import stream_diagnose

    s = {(r.q, r.failure_label, r.verified_label) for r in stream_diagnose(spark, SF_SMALL).collect()}
    b = {(r.q, r.failure_label, r.verified_label) for r in diagnosed(spark, SF_SMALL).collect()}
    assert s == b and len(s) == 1000


def test_stream_epsgreedy_equals_batch_fold(spark, tmp_path):
    """Two micro-batches, each cut into blocks, and a second run: the weights equal the batch
    fold over all events, and nothing is learned twice."""
    import numpy as np

    from remedy.operators import policy as PO
    from remedy.plans.policies import DIAG_DIM, log
    from remedy.streaming import jobs as S

    folder, ev = str(tmp_path / "in"), spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.filter("event_id < 400").coalesce(1).write.parquet(folder + "/a")
    ev.filter("event_id >= 400").coalesce(1).write.parquet(folder + "/b")
    import glob
    import os
    import shutil
    (tmp_path / "ev").mkdir()
    for k, part in enumerate(("a", "b")):
        shutil.copy(glob.glob(f"{folder}/{part}/part-*.parquet")[0], tmp_path / "ev" / f"events-{k}.parquet")
        os.utime(tmp_path / "ev" / f"events-{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    run = lambda: S.run_epsgreedy(spark, S.read_table_stream(
        spark, str(tmp_path / "ev"), "events", S.EVENTS_SCHEMA), str(tmp_path / "out"), block_rows=64).collect()
    s = {r.arm: (r.pulls, np.array(r.w)) for r in run()}
    lg = log(spark, SF_SMALL, False)
    b = {r.arm: np.array(r.w) for r in PO.epsgreedy_fit(lg, DIAG_DIM).collect()}
    n = {r.arm: r["count"] for r in lg.groupBy("arm").count().collect()}
    assert set(s) == set(b)
    for a in b:
        assert s[a][0] == n[a] and np.allclose(s[a][1], b[a])
    assert {r.arm: r.pulls for r in run()} == n


def test_ranks_hold_without_exchange_reuse(spark):
    """Every position once, whether or not Spark reuses the exchange of the rows."""
    from remedy.operators.corpus import global_rank, rank_in_group

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        x = spark.range(100_000).selectExpr("hash(id) as k", "id", "if(id % 3 = 0, null, id % 7) as g")
        r = global_rank(x, ["k", "id"]).agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
        assert tuple(r) == (100_000, 0, 99_999)
        got = rank_in_group(x, "g", ["k", "id"]).groupBy("g").agg(
            F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
        assert len(got) == 8 and all(r.n == r.d == r.m + 1 for r in got)
        want = rank_in_group(x, "g", ["k", "id"], "r").orderBy("g", "r").select("id").limit(500).collect()
        assert want == x.orderBy("g", "k", "id").select("id").limit(500).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
