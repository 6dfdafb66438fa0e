"""BCa intervals, sentence packing with overlap, short golds, first files, and sums of blocks."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from remedy.operators import metrics as M
from remedy.operators import retrieve as R
from remedy.sources import files as FS


def test_normal_cdf(spark):
    xs = [-6.5, -3.2, -1.96, -0.5, 0.0, 0.3, 1.0, 2.7, 5.1, 9.0, -9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(M.normal_cdf("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([statistics.NormalDist().cdf(x) for x in xs], abs=1e-14)


def bca(x, reps, level=0.95):
    """The published interval from replicates, the jackknife done row by row."""
    nd, n, mean = statistics.NormalDist(), len(x), float(np.mean(x))
    share = (sum(r < mean for r in reps) + sum(r <= mean for r in reps)) / (2 * len(reps))
    z0 = nd.inv_cdf(share)
    jack = np.array([np.mean(np.delete(x, i)) for i in range(n)])
    u = (n - 1) * (jack.mean() - jack)
    a = (u ** 3).sum() / n ** 3 / (6 * ((u ** 2).sum() / n ** 2) ** 1.5)
    out = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + nd.inv_cdf(q)
        out.append(float(np.percentile(reps, 100 * nd.cdf(z0 + z / (1 - a * z)))))
    return out


def test_bca_equals_the_row_by_row_jackknife(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.gamma(2.0, 3.0, 40), [60.0]])
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, id long, x double")
    got = M.bootstrap_ci(df, "g", "x", "id").filter("g = 'g'").first()
    u = df.select("id", "x", *[M.md5_uniform(F.lit("42"), F.lit(b), F.col("id")).alias(f"u{b}") for b in range(10)]).orderBy("id").toPandas()
    reps = []
    for b in range(10):
        w = np.array([sum(c <= v for c in M.POISSON_CDF) for v in u[f"u{b}"]])
        reps.append(float((w * u.x).sum() / w.sum()))
    low, high = bca(x, reps)
    assert got.ci_low == pytest.approx(low, abs=2e-8) and got.ci_high == pytest.approx(high, abs=2e-8)
    assert got.mean == pytest.approx(np.mean(reps), abs=2e-8)


def test_equal_values_have_no_interval(spark):
    df = spark.createDataFrame([("g", i, 2.5) for i in range(9)], "g string, id long, x double")
    r = M.bootstrap_ci(df, "g", "x", "id").filter("g = 'g'").first()
    assert r.mean == 2.5 and math.isnan(r.ci_low) and math.isnan(r.ci_high)


def greedy(words, budget, overlap):
    """Sentence by sentence."""
    out, start = [], 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (end == start or size + words[end] <= budget):
            size += words[end]
            end += 1
        out.append((start, end))
        if end == len(words):
            break
        nxt = end
        while nxt - 1 > start and sum(words[nxt - 1:end]) <= overlap and sum(words[nxt - 1:end + 1]) <= budget:
            nxt -= 1
        start = nxt
    return out


def test_sentence_bounds_equal_the_greedy_walk():
    rng = np.random.default_rng(0)
    for _ in range(300):
        words = rng.integers(1, rng.integers(2, 60), size=rng.integers(1, 60))
        budget, overlap = int(rng.integers(5, 80)), int(rng.integers(0, 30))
        got = R.sentence_bounds(words, budget, overlap)
        assert got == greedy(words.tolist(), budget, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(words) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))


def test_text_of_100000_sentences(spark):
    text = " ".join(f"Sentence {i} has six words here." for i in range(100_000))
    got = R.chunk_sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("pos").collect()
    assert {r.doc_id for r in got} == {1} and all(r.n_words <= R.CHUNK_SIZE for r in got)
    assert got[0].text.startswith("Sentence 0 ") and got[-1].text.endswith("Sentence 99999 has six words here.")
    assert got[1].text.split(".")[0] + "." in got[0].text  # neighbours share a sentence


def test_short_golds_without_a_nested_loop(spark):
    docs = [(1, "the cat sat"), (2, "concatenate é"), (3, "🙂 dog"), (4, ""), (5, None), (6, "a.b c")]
    golds = [(1, "cat"), (2, "é"), (3, "🙂"), (4, "a"), (5, "zebra"), (6, "."), (7, "the cat"), (8, ""), (9, "the cat sat"), (10, "ca"), (11, "caté")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(golds, "q_id long, question string")
    out = R.gold_containment(d, g)
    assert sorted(map(tuple, out.collect())) == sorted((q, i) for q, s in golds for i, t in docs if t is not None and s in t)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_first_files_only(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"t{i}", "0\tx", i // 10) for i in range(50)], "id string, text string, lines string, part int")
    rows.repartition("part").write.partitionBy("part").json(str(tmp_path / "p"))
    got = FS.read_slices(spark, str(tmp_path / "p"), 2)
    assert sorted(int(r.id) for r in got.collect()) == list(range(20)) and len(got.inputFiles()) == 2
    (tmp_path / "none").mkdir()
    assert FS.read_slices(spark, str(tmp_path / "none"), 2).count() == 0
