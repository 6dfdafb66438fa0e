"""The versioned index and top-k with score bounds, against a plain count of everything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from given import SF_SMALL
from remedy.functions import text as T
from remedy.operators import lexical as L
from remedy.operators import retrieve as R

STOP = set(T.STOP_WORDS)


def brute_topk(chunks, queries, k):
    """chunks: [(doc, pos, [terms])] -> {q: [(score, doc, pos)]}, every chunk scored."""
    n, avg = len(chunks), sum(len(t) for _, _, t in chunks) / len(chunks)
    df = {}
    for _, _, t in chunks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, terms in queries.items():
        rows = []
        for d, p, t in chunks:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
                    for w in set(terms) if w in t)
            if s:
                rows.append((round(s, 6), d, p))
        out[q] = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """800 one-chunk passages: every one holds 'xq' and most 'yq'; some hold rarer words."""
    rng = random.Random(2)
    texts = {}
    for i in range(800):
        words = ["xq"] * rng.randrange(1, 3) + (["yq"] if rng.random() < 0.6 else []) + [f"r{rng.randrange(300)}q" for _ in range(rng.randrange(1, 30))]
        texts[i] = " ".join(words)
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([("base" if i % 2 else "more", i, t) for i, t in texts.items()], "delta string, doc_id long, text string")
    L.add_deltas(path, docs.filter("delta = 'base'"), {"base": (0, None)})
    L.add_deltas(path, docs.filter("delta = 'more'"), {"more": (1, None)})
    return path, texts


QUERIES = {1: "xq r5q r7q", 2: "xq", 3: "xq yq", 4: "r1q r2q r3q yq", 5: "nothing here", 6: "r250q"}


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_topk_equals_scoring_everything(spark, built, version, k):
    path, texts = built
    held = [(i, 0, t.split()) for i, t in texts.items() if version or i % 2]
    index = L.open_index(spark, path, version)
    assert index.n_chunks == len(held)
    got = {}
    for r in L.topk(index, spark.createDataFrame(list(QUERIES.items()), "q_id long, question string"), k).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append((r.score, r.doc_id, r.pos))
    want = brute_topk(held, {q: t.split() for q, t in QUERIES.items()}, k)
    assert got == {q: [(pytest.approx(s, abs=2e-6), d, p) for s, d, p in w] for q, w in want.items() if w}


def test_bounds_leave_out_most_postings_of_a_word_in_every_chunk(spark, tmp_path, monkeypatch):
    """Beside rarer words, the word that all chunks hold is only looked up in the blocks that
    may still reach the k-th score."""
    monkeypatch.setattr(L, "BLOCK_CHUNKS", 16)
    rng = random.Random(8)
    texts = ["xq " + " ".join(f"r{rng.randrange(2000)}q" for _ in range(10)) for _ in range(640)]
    docs = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "delta string, doc_id long, text string")
    L.add_deltas(str(tmp_path / "i"), docs, {"d": (0, None)})
    index = L.open_index(spark, str(tmp_path / "i"))
    rare = texts[7].split()[1:4]
    qs = spark.createDataFrame([(1, " ".join(["xq", *rare]))], "q_id long, question string")
    w = L.query_weights(index, qs)
    assert {r.term: r.hot for r in w.collect()}["xq"]
    pairs = L.surviving_blocks(index, w, 1)
    joined = index.blocks.filter("term = 'xq'").join(pairs, ["delta", "block"]).agg(F.sum(F.size("chunks"))).first()[0]
    assert joined <= 640 / 8
    assert L.topk(index, qs, 1).first().doc_id == 7


def test_a_second_query_tokenises_nothing(spark, monkeypatch):
    from remedy.plans import index as I
    from remedy.plans import retrieval as Q

    first = sorted(map(tuple, Q.bm25_topk(spark, SF_SMALL).collect()))

    def never(*a, **k):
        raise AssertionError("tokenised again")
    monkeypatch.setattr(I.L, "add_deltas", never)
    again = Q.bm25_topk(spark, SF_SMALL)
    assert sorted(map(tuple, again.collect())) == first
    plan = again._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_a_delta_written_twice_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([("d", 1, "apples and pears"), ("d", 2, "pear")], "delta string, doc_id long, text string")
    for _ in range(2):
        L.add_deltas(str(tmp_path / "i"), docs, {"d": (0, None)})
    index = L.open_index(spark, str(tmp_path / "i"))
    assert index.n_chunks == 2 and {r.term: r.df for r in index.terms.collect()} == {"appl": 1, "pear": 2}
    assert L.has_deltas(spark, str(tmp_path / "i"), ["d"]) and not L.has_deltas(spark, str(tmp_path / "i"), ["d", "e"])
    assert not L.has_deltas(spark, str(tmp_path / "none"), ["d"])


def test_term_hits_of_any_candidates(spark, built):
    path, texts = built
    index = L.open_index(spark, path, 1)
    w = L.query_weights(index, spark.createDataFrame([(1, "xq r5q")], "q_id long, question string"))
    idf = {r.term: r.idf for r in w.collect()}
    cand = spark.createDataFrame([(1, i, 0) for i in range(50)], "q_id long, doc_id long, pos int")
    for r in L.term_hits(index, w, cand).collect():
        assert r.hit == pytest.approx(sum(v for t, v in idf.items() if t in texts[r.doc_id].split()))
