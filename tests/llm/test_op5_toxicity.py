import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from remedy.llm import op5_toxicity as o

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_on_given_labels(spark):
    r = o.op5_toxicity(spark, SF)
    lab = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic IS NOT NULL")
    got = r.filter("held_out").join(lab, "doc_id").select("toxic", "predicted", "score").collect()
    assert len(got) > 500 and all(0 <= x.score <= 1 for x in got)
    assert np.mean([x.toxic == x.predicted for x in got]) > 0.97
    assert np.mean([x.predicted for x in got if x.toxic == 1]) > 0.88
    assert r.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_and_id_are_no_input(spark):
    m = o.Model(np.where(np.arange(o.BINS + 1) % 7 == 0, 0.5, 0).astype(np.float32), -1.0)
    df = spark.createDataFrame([(1, "some text", 1), (2, "some text", 0), (None, "some text", None)], "doc_id long, text string, toxic int")
    got = o.score_text(df, m, score="p").collect()
    assert len({x.p for x in got}) == 1 and got[0].toxic == 1


def test_scores_match_brute_force_and_ignore_neighbours():
    rng = np.random.default_rng(0)
    w = np.where(rng.random(o.BINS + 1) < 0.3, rng.normal(size=o.BINS + 1), 0).astype(np.float32)
    w[o.BINS] = 0
    m, texts = o.Model(w, 0.25, -0.5), ["idiot, Idiot!", "", None, "ab", "abc", "é ü", "x" * 5000, "abcd"]

    def one(t):
        x, total = bytes(int(o.FOLD[c]) for c in (t or "").encode()), m.bias + m.per_kb * len((t or "").encode()) / 1000
        for n in o.ORDERS:
            for i in range(len(x) - n + 1):
                g = int.from_bytes(x[i:i + n], "big") * 11400714819323198485 % 2**64 ^ n * 0x9E3779B97F4A7
                total += float(w[g * 11400714819323198485 % 2**64 >> 64 - o.BITS])
        return 1 / (1 + np.exp(-min(max(total, -500), 500)))

    assert np.allclose(o.text_scores(pa.array(texts, pa.string()), m), [one(t) for t in texts], atol=1e-5)


def test_unseen_bins_have_no_ratio_and_markers_do():
    neg, pos = np.zeros(o.BINS, np.int64), np.zeros(o.BINS, np.int64)
    neg[1], pos[1], pos[2] = 500, 60, 50
    r = o.ratios(neg, pos, 900, 100)
    assert r[0] == 0 and abs(r[1]) < 0.2 and r[2] > 1.5


def test_degenerate_labels_and_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "x")], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 1), (1, None), (None, 1), (2, 5)], 0.75)):
        m = o.train(docs, spark.createDataFrame(rows, "doc_id long, label int"))
        got = [x.score for x in o.score_text(docs, m).collect()]
        assert len(got) == 4 and np.allclose(got, want)
    empty = docs.limit(0)
    assert o.score_text(empty, m).count() == 0
    both = o.train(docs.withColumn("extra", F.lit(1)).select("doc_id", "text"),
                   spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, label int"))
    assert np.isfinite(both.bias)
