import gc
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from remedy.llm import op1_brown as o


def brute(docs):
    tok = [((t or "").encode().lower().split() + [None], zlib.crc32(str("" if i is None else i).encode()) % 10 == 0)
           for i, t in docs]
    c = Counter(w for ws, held in tok if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held, len(ws), sum(w in c for w in ws), n,
             sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws)) for ws, held in tok], c


def rows_of(spark, docs):
    from pyspark.sql import functions as F

    from remedy.llm.common import held_out
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return o.brown_scores(df.select("doc_id", "text", held_out(F.col("doc_id"), 10).alias("held_out"))).collect()


def sample():
    rng = np.random.default_rng(3)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    out = []
    for i in range(120):
        words = a if i % 2 else b
        out.append((i, " ".join(rng.choice(words, 40))))
    return out


def test_base_score_counts_and_gain_against_brute_force(spark):
    docs = sample() + [(500, None), (501, ""), (None, "a1 B2"), (7, "a1  a2\x0bZz"), (7, "a1  a2\x0bZz")]
    want, _ = brute(docs)
    got = rows_of(spark, docs)
    key = lambda r: (r[0], r[1], r[2], round(r[4], 6))
    assert sorted(map(key, want)) == sorted(
        (r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert {r.train_tokens for r in got} == {want[0][3]}
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes learn the two vocabularies


def test_distribution_sums_to_one(spark):
    rng = np.random.default_rng(0)
    grams = np.zeros((o.K, 2 * o.K), dtype=np.int64)
    grams[:, : o.K] = rng.integers(0, 5, (o.K, o.K))
    grams[:, o.UNK] = 0
    assert np.allclose((10 ** o.transitions(grams)).sum(axis=1), 1.0)


def likelihood(bigrams, cls, k):
    f = np.zeros((len(cls), k))
    f[np.arange(len(cls)), cls] = 1
    g = f.T @ bigrams @ f
    return g, sum(s * o._xlogx(x).sum() for s, x in ((1, g), (-1, g.sum(0)), (-1, g.sum(1))))


def test_exchange_ends_where_no_single_move_gains():
    rng = np.random.default_rng(2)
    n, k = 30, 4
    kind = rng.integers(0, 3, n)  # three hidden kinds that follow each other in turn
    b = np.zeros((n + 2, n + 2))
    b[:n, :n] = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 20, 1))
    b[n, :n], b[:n, n + 1] = 3, 2
    freq = b[:n].sum(axis=1)
    cls, g = o.exchange(b, freq, classes=k, sweeps=100)
    full = np.append(cls, [k, k + 1])
    again, best = likelihood(b, full, k + 2)
    assert np.allclose(g, again)
    for w in range(n):
        for c in range(k):
            other = full.copy()
            other[w] = c
            assert likelihood(b, other, k + 2)[1] <= best + 1e-4
    assert all(len(set(kind[cls == c])) <= 1 for c in range(k))


def test_empty_table_and_no_training_rows(spark):
    assert rows_of(spark, []) == []
    only_held = [(i, "x y") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = rows_of(spark, only_held)
    assert len(got) == len(only_held) and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert all(math.isfinite(r.score) and r.base_score == pytest.approx(0) for r in got)


def test_very_long_text_and_extra_column(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    got = rows_of(spark, [(1, long), (2, "w1 w2")])
    assert {r.n_tokens for r in got} == {60_001, 3}


class Taken:
    """Takes the function of a mapInArrow instead of running it."""
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_words_of_a_block_are_let_go_with_it(spark, monkeypatch):
    monkeypatch.setattr(o, "BLOCK_BYTES", 1000)
    docs = pa.record_batch({"doc_id": [1] * 40, "text": pa.array([f"w{i} ".encode() * 400 for i in range(40)]),
                            "held_out": [False] * 40})
    numbered = lambda: sum(isinstance(x, defaultdict) and isinstance(next(iter(x), None), bytes)
                           for x in gc.get_objects())
    gc.collect()
    gc.disable()  # a worker makes too few containers to collect its garbage often
    try:
        blocks = list(o.encode(Taken())(iter([docs])))
        assert len(blocks) == 40 and numbered() <= 1
    finally:
        gc.enable()


def test_parts_are_bounded_and_change_no_score(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    few = [f"f{i}" for i in range(200)]  # frequent, but no seeds
    docs = [(i, " ".join(rng.choice(few, 400)) + f" x{rng.integers(90)} x{rng.integers(90)}") for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).select(
        "doc_id", "text", (F.coalesce("doc_id", F.lit(0)) % 10 == 0).alias("held_out"))
    rows = lambda: sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 6))
                          for r in o.brown_scores(df, classes_of=20).collect())
    want = rows()
    for name, value in {"BLOCK_BYTES": 200_000, "PART_BYTES": 20_000, "SLICE": 7, "SLICE_TOKENS": 900, "MANY": 40}.items():
        monkeypatch.setattr(o, name, value)
    assert rows() == want
    monkeypatch.setattr(o, "BLOCK_BYTES", 1 << 24)
    monkeypatch.setattr(o, "MANY", 4 * o.K)
    blocks = o.encode(df.coalesce(1)).cache()
    parts = blocks.agg(F.sum("sends")).first()[0] // o.PART_BYTES + 1
    sent = o.word_contexts(blocks, parts, np.array([], np.uint64), np.array([], np.int64)).groupBy("part").agg(
        *[F.sum(F.octet_length(c)).alias(c) for c in ("h", "c", "around", "tables")]).collect()
    assert parts > 1 and max(r.h + r.c + r.around + r.tables for r in sent) <= 3 * o.PART_BYTES
    assert 0 < sum(r.around + r.tables for r in sent) < 1.5 * 400 * 270  # 2 bytes an occurrence without tables
