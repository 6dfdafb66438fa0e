import numpy as np
import pytest

from remedy.llm import op10_vptree as o


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = [len(v) for _, v in good]
    d = max(set(dims), key=lambda x: (dims.count(x), -x)) if dims else 0
    good = [(i, v) for i, v in good if len(v) == d]
    out = {}
    for q, v in good:
        if q in queries:
            s = sorted(((-float(v @ x), i) for i, x in good if i != q))
            s = [(round(-a, 9), i) for a, i in s]
            s.sort(key=lambda t: (-t[0], t[1]))
            out[q] = s[:k]
    return out


def found(spark, rows, queries, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = o.build_index(df, k=kw.get("k", o.K))
    got = o.search(index, df.filter(df.vec_id.isin(list(queries))), **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    assert all([r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == list(range(1, len(v) + 1)) for q, v in out.items())
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(o, "SHARD_ROWS", 300)
    monkeypatch.setattr(o, "QUERY_BLOCK", 20)
    monkeypatch.setattr(o, "LEAF", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    x = centre[rng.integers(0, 12, 900)] * rng.uniform(0.2, 3, (900, 1)) + rng.normal(size=(900, 8)) * 0.2
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # one vector shared by many
    queries = {i for i in range(0, 960, 20)} | {2000, 2059}
    want = brute(rows, queries, 20)
    assert found(spark, rows, queries, factor=1.0) == want


def test_recall_of_the_relaxed_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16))
    q = x[:100]
    tree = o.Tree(x, leaf=32)
    _, exact = tree.search(q, 20, 1.0)
    truth = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :20]
    assert (np.sort(exact) == np.sort(truth)).all()
    _, some = tree.search(q, 20, o.FACTOR)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(some, truth)]) / 20 >= 0.9


def test_odd_rows_and_small_tables(spark):
    rows = [(20, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (10, [-1.0, -1.0]), (20, [1.0, 2.0]), (40, [0.0, 0.0]), (60, None)]
    assert found(spark, rows, {20, 40, 60}, k=5) == {20: [(4.0, 1), (4.0, 2), (-3.0, 10)]}
    assert found(spark, [], {20}) == {}
    assert found(spark, [(20, [1.0])], {20}) == {}


def test_query_on_given_vectors_reaches_brute_force(spark):
    got = o.op10_vptree(spark, "/root/testdata/sf0.01").collect()
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    want = brute([(r.vec_id, list(r.embedding) if r.embedding else None) for r in d], {r.vec_id for r in d if r.vec_id % 20 == 0}, 20)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append(r.vec_id)
    assert mine.keys() == want.keys()
    assert np.mean([len(set(mine[q]) & {i for _, i in want[q]}) / len(want[q]) for q in want]) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 33])
def test_equal_points_build_a_tree(n):
    s, r = o.Tree(np.ones((n, 3)), leaf=2).search(np.ones((2, 3)), 4, 1.0)
    assert (r >= 0).sum(axis=1).tolist() == [min(n, 4)] * 2 and np.isfinite(s).sum() == 2 * min(n, 4)
