"""Triples by distinct element vectors, rounding after the search, streams over table folders."""

import numpy as np

from remedy.operators import retrieve as R
from remedy.operators import triples as TR


def _brute(claims, facts, vecs, k):
    out = set()
    for a, *rows in claims:
        q = np.concatenate([vecs[r] for r in rows])
        d = [(round(float(((q - np.concatenate([vecs[r] for r in f[1:]])) ** 2).sum()), 6), f[0]) for f in facts]
        out |= {(a, i, n + 1, s) for n, (s, i) in enumerate(sorted(d)[:k])}
    return out


def test_triple_topk_visits_more_subjects_until_settled(spark):
    rng = np.random.default_rng(5)
    vecs = {i: np.round(v / np.linalg.norm(v), 3) for i, v in enumerate(rng.normal(size=(60, 6)))}
    vecs[7] = vecs[3]  # equal vectors under two ids
    facts = [(i, int(rng.integers(40)), 50, int(52 + rng.integers(3))) for i in range(120)]
    facts.append((200, 3, 51, 59))
    claims = [(a, int(rng.integers(40)), 50, int(52 + rng.integers(4))) for a in range(30)] + [(90, 49, 51, 59)]
    v = spark.createDataFrame([(i, [float(x) for x in x]) for i, x in vecs.items()], "vec_id long, v array<double>")
    ids, vec = TR.distinct_vectors(v)
    assert vec.count() == 59
    f = TR.with_elements(spark.createDataFrame(facts, "fact_id long, s_row long, r_row long, o_row long"), ids)
    c = TR.with_elements(spark.createDataFrame(claims, "answer_id long, s_row long, r_row long, o_row long"), ids)
    got = TR.triple_topk(c, f, vec, 3, near=1).collect()  # 1, 8, then all subjects
    assert {(r.answer_id, r.fact_id, r["rank"], round(r.score, 6)) for r in got} == _brute(claims, facts, vecs, 3)
    status = TR.triple_status(TR.triple_topk(c, f, vec, 3), c, f, vec)
    assert status.count() == 3 * len(claims)


def test_block_topk_rounds_only_what_it_keeps():
    rng = np.random.default_rng(1)
    m, q = np.round(rng.normal(size=(700, 4)), 1), np.round(rng.normal(size=(50, 4)), 1)  # many ties
    ids = rng.permutation(700)
    d, i = R._block_topk(q, ids, m, 5, rows=16)
    for n in range(50):
        want = sorted(zip(np.round(((q[n] - m) ** 2).sum(axis=1), 6), ids))[:5]
        assert list(i[n]) == [x for _, x in want] and np.allclose(d[n], [x for x, _ in want])


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    from remedy.streaming import jobs as S

    rows = [(i, f"word{i} passage tokens", "en", "web", 10) for i in range(8)]
    spark.createDataFrame(rows, S.DOCS_SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = S.read_table_stream(spark, str(tmp_path), "documents", S.DOCS_SCHEMA)
    index = S.run_reindex(spark, docs)
    assert {r.doc_id for r in index.postings.collect()} == set(range(8))
    assert index.stats.first().n_chunks == 8


def test_term_counts_are_row_local(spark):
    rows = [(1, 0, "red red blue Green green red"), (2, 0, "the of and"), (3, 1, "one")]
    c = R.term_counts(spark.createDataFrame(rows, "doc_id long, pos int, text string"), ["doc_id", "pos"])
    assert "Exchange" not in c._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.dl, {(t.term, t.tf) for t in r.terms}) for r in c.collect()}
    assert got == {1: (6, {("red", 3), ("blue", 1), ("green", 2)}), 2: (0, set()), 3: (1, {("one", 1)})}


def test_tiles_rank_like_blocks(spark, tmp_path, monkeypatch):
    from remedy.operators import lexical as L

    rng = np.random.default_rng(3)
    words = [f"w{i}x" for i in range(60)]
    docs = [("a" if i % 3 else "b", i, " ".join(rng.choice(words, 40))) for i in range(90)]
    docs += [("b", 1, docs[1][2])]  # a passage held by two deltas
    L.add_deltas(str(tmp_path), spark.createDataFrame(docs, "delta string, doc_id long, text string"), {"a": (0, None), "b": (0, None)})
    index = L.open_index(spark, str(tmp_path))
    qs = spark.createDataFrame([(q, " ".join(rng.choice(words, 6))) for q in range(40)], "q_id long, question string")
    key = lambda df: {(r.q_id, r["rank"], r.delta, r.doc_id, r.pos, r.score, round(r.hit, 6)) for r in df.collect()}
    want = key(L.topk(index, qs, 4))
    monkeypatch.setattr(L, "MANY_QUERIES", 0)
    monkeypatch.setattr(L, "BATCH_QUERIES", 16)
    monkeypatch.setattr(L, "TILE_BLOCKS", 1)
    assert key(L.topk(index, qs, 4)) == want
