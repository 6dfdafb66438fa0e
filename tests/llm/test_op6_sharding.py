import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from remedy.llm import op6_sharding as o

COLS = ["doc_id", "n_bytes", "depth", "shard_id", "shard_bytes", "shard_docs", "oversized"]


def duck(df, limit):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    return sorted(con.execute(o.sharding_sql(limit)).fetchall(), key=repr)


@pytest.mark.parametrize("limit", [200, 3_000, 50_000, 10**9])
def test_against_sql_on_given_documents(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, o.shard(docs, "doc_id", "text", limit).select(*COLS).collect()), key=repr)
    assert [tuple(r[COLS.index(c)] for c in COLS) for r in got] == [
        (r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in duck(docs, limit)]
    sizes = defaultdict(int)
    for r in got:
        sizes[r[3]] += r[1]
    assert all(v <= limit or dict((x[3], x[6]) for x in got)[k] for k, v in sizes.items())


def test_hot_key_nulls_ties_and_clashing_columns(spark):
    rows = [(7, "x" * 500, 1)] * 40 + [(None, "y" * 300, 2)] * 3 + [(i, "z" * i, 3) for i in range(60)] + [(99, None, 4), (98, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fine int")
    got = o.shard(df, "doc_id", "text", 1_000).collect()
    assert len(got) == len(rows) and "fine" in got[0].asDict()
    hot = {(r.shard_id, r.oversized) for r in got if r.doc_id == 7 and r.n_bytes == 500}
    assert len(hot) == 1 and next(iter(hot))[1]
    assert sorted(map(tuple, (tuple(r[c] for c in COLS) for r in got)), key=repr) == duck(df, 1_000)


def test_more_leaves_than_may_be_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, o.shard(docs, "doc_id", "text", 3_000).collect()), key=repr)
    monkeypatch.setattr(o, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, o.shard(docs, "doc_id", "text", 3_000).select(*docs.columns, *COLS[1:2], *COLS[2:]).collect()), key=repr) == want \
        or len(want) == docs.count()


def test_empty_and_written_shards(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert o.shard(empty, "doc_id", "text", 10).count() == 0
    df = spark.createDataFrame([(i, "t" * 100) for i in range(50)], "doc_id long, text string")
    out = str(tmp_path / "shards")
    o.write_shards(o.shard(df, "doc_id", "text", 1_000), out)
    folders = [f for f in os.listdir(out) if f.startswith("shard_id=")]
    for f in folders:
        assert spark.read.parquet(f"{out}/{f}").agg(F.sum("n_bytes")).first()[0] <= 1_000
    assert spark.read.parquet(out).count() == 50
