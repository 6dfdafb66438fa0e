import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from remedy.llm import op3_mixing, op7_langid, op8_decontaminate, op9_simhash
from remedy.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = P.written(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(spark, stages):
    cols = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _, _ in stages] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(after.columns == cols for _, _, after in stages[:-1])
    assert stages[-1][2].columns[:len(cols)] == cols and "shard_id" in stages[-1][2].columns


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_does_what_its_operator_says(spark, stages):
    by = {n: (b, a) for n, b, a in stages}
    before, after = by["language_id"]
    pred = op7_langid.detect(before.select("doc_id", "text"), op7_langid.learned_from(before))
    assert ids(after) == ids(pred.filter("lang_pred <> 'und'"))
    before, after = by["near_duplicates"]
    near = op9_simhash.near_duplicates(before)
    assert ids(after) == sorted(r[0] for r in near.select("component_id").distinct().collect())
    before, after = by["decontamination"]
    rep = op8_decontaminate.decontaminate(before.select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(rep.filter("NOT contaminated")) and rep.filter("contaminated").count() > 0
    before, after = by["mixing"]
    rows = op3_mixing.mix_report(before.select("doc_id", "source", op3_mixing.n_words(F.col("text")).alias("size"))).collect()
    assert ids(after) == sorted(i for r in rows if r.size for i in [r.doc_id] * (r.taken // r.size))
    before, after = by["sharding"]
    assert ids(after) == ids(before)


def test_planted_rows(spark, docs_of):
    rng = np.random.default_rng(0)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text IS NOT NULL").first().text
    clean = [(i, text(80), "en", f"s{i % 3}") for i in range(40)]
    rows = clean + [(100, clean[0][1], "en", "s0"), (100, clean[0][1], "en", "s0"), (101, None), (102, ""), (103, "12 34"),
                    (104, bench), (105, text(5) + " " + bench), (None, text(50), None, None)]
    docs = docs_of(rows)
    for name, stage in P.STAGES[:3]:
        docs = P.written(stage(spark, docs, SF), name)
    got = sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x or 0))
    assert got == list(range(40)) + [None]


def test_empty_documents(spark, docs_of):
    docs = docs_of([])
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as E
    assert sorted(k for k in E.queries() if k.startswith("op") and k[2].isdigit()) == sorted(QUERIES)
    assert len(QUERIES) == 13 and E.queries()["pipeline"]
