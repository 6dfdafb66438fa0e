"""Findings of round 4: many questions are scored without shuffling postings or questions."""

import numpy as np
import pyarrow as pa

from remedy.operators import lexical as L
from remedy.operators import retrieve as R


def _docs(rng, n, words):
    return [("a" if i % 3 else "b", i, " ".join(rng.choice(words, 40))) for i in range(n)] + [("b", 1, "w1x w2x w2x"), ("a", 9999, "w1x w2x w2x")]


def test_neither_postings_nor_questions_are_shuffled(spark, tmp_path, monkeypatch):
    """Before the tiles are scored, nothing is exchanged but the words that a batch asks for; the
    rows of a block stay together whatever the session says of files and row groups."""
    rng = np.random.default_rng(8)
    words = [f"w{i}x" for i in range(70)]
    plans, best, hadoop = [], L._best, spark.sparkContext._jsc.hadoopConfiguration()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    hadoop.setInt("parquet.block.size", 1024)
    try:
        L.add_deltas(str(tmp_path), spark.createDataFrame(_docs(rng, 400, words), "delta string, doc_id long, text string"), {"a": (0, None), "b": (0, None)})
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        hadoop.unset("parquet.block.size")
    index = L.open_index(spark, str(tmp_path))
    qs = spark.createDataFrame([(q, " ".join(rng.choice(words, 5))) for q in range(50)], "q_id long, question string")
    key = lambda df: {(r.q_id, r["rank"], r.delta, r.doc_id, r.pos, r.score, round(r.hit, 6)) for r in df.collect()}
    want = key(L.topk(index, qs, 4))
    monkeypatch.setattr(L, "MANY_QUERIES", 0)
    monkeypatch.setattr(L, "BATCH_QUERIES", 20)
    monkeypatch.setattr(L, "TILE_BLOCKS", 2)
    monkeypatch.setattr(L, "_best", lambda scores, k: plans.append(scores._jdf.queryExecution().executedPlan().toString()) or best(scores, k))
    assert key(L.topk(index, qs, 4)) == want and len(want) == 200
    assert len(plans) == 3 and not any("CoGroup" in p or "Exchange hashpartitioning" in p for p in plans)


def _rows(rng, blocks):
    """Rows of an index (block, delta, term, chunks) and its postings."""
    rows, flat = [], []
    for b in range(blocks):
        for t in rng.permutation(30)[:20]:
            held = [{"doc_id": int(b * 10 + c), "pos": int(c % 2), "tf": int(rng.integers(1, 4)), "dl": int(rng.integers(3, 9))} for c in sorted(rng.choice(10, rng.integers(1, 8), False))]
            rows.append({"block": b, "delta": "d" if b % 2 else "c", "term": f"t{t}", "chunks": held})
            flat += [(f"t{t}", "d" if b % 2 else "c", c) for c in held]
    return rows, flat


def test_tiles_of_whole_blocks_rank_like_all_pairs(monkeypatch):
    """Blocks cut by record batches are scored whole; by matrix products, by postings and by
    both the ranks are those of all (query, chunk) pairs, equal scores by id."""
    rng = np.random.default_rng(4)
    rows, flat = _rows(rng, 9)
    chunks = pa.list_(pa.struct([("doc_id", pa.int64()), ("pos", pa.int32()), ("tf", pa.int64()), ("dl", pa.int32())]))
    t = pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("delta", pa.string()), ("term", pa.string()), ("chunks", chunks)]))
    asked = [(q, f"t{i}", 1.0 + i / 7) for q in range(40) for i in rng.permutation(33)[:6]]  # t30 to t32 are in no block
    packed = L._pack(pa.table({"q_id": [a[0] for a in asked], "term": [a[1] for a in asked], "idf": [a[2] for a in asked]}))
    want = set()
    for q in range(40):
        idf, found = {a[1]: a[2] for a in asked if a[0] == q}, {}
        for term, delta, c in flat:
            if term in idf:
                gain = idf[term] * c["tf"] * (R.BM25_K1 + 1) / (c["tf"] + R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * c["dl"] / 5.0))
                s, h = found.get((c["doc_id"], c["pos"], delta), (0.0, 0.0))
                found[c["doc_id"], c["pos"], delta] = s + gain, h + idf[term]
        best = sorted((-round(s, 6), *at, round(h, 6)) for at, (s, h) in found.items())[:3]
        want |= {(q, *x) for x in best}
    for size, blocks, dense, cells in ((7, 1, 0.0, 50), (7, 64, 2.0, 1 << 20), (1000, 2, 0.01, 400)):
        monkeypatch.setattr(L, "DENSE", dense)
        monkeypatch.setattr(L, "CELLS", cells)
        for least in (0.0, 1.0):
            q = packed | {"least": np.full(40, least)}
            of, score, hit, doc, pos, delta = L._best_of(iter(t.to_batches(size)), q, 3, blocks, ["c", "d"], 5.0)
            got = {(int(packed["ids"][a]), -round(float(b), 6), int(c), int(d), "cd"[e], round(float(h), 6)) for a, b, h, c, d, e in zip(of, score, hit, doc, pos, delta)}
            assert got == want
    parts = list(L._tiles(iter(t.to_batches(7)), 2))
    assert len(parts) > 3 and sum(x.num_rows for x in parts) == t.num_rows
    assert sum(len(set(x.column("block").to_pylist())) for x in parts) == 9


def test_only_retrieved_texts_are_shuffled(spark):
    """nli_pairs, eval_projection: the ranks are sent to the texts, not the texts to the ranks."""
    from given import SF_SMALL
    from remedy.plans import corpus as CQ
    from remedy.plans import fixtures as X

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CQ._retrieved(spark, SF_SMALL, X.questions(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_streamed_ranks_make_no_row_a_pair(spark, tmp_path, monkeypatch):
    """The k best of plain postings equal those of all scores, also of a chunk that two batches
    hold and of passages and questions without an id; postings are added up in tasks of a few."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words, n))
    chunks = spark.createDataFrame([(i, p, text(12)) for i in range(60) for p in range(2)] + [(None, 0, text(9)), (None, 0, "w1x w2x"), (3, 0, text(5)), (70, 0, "the")],
                                   "doc_id long, pos int, text string")
    one, two = R.bm25_index(chunks), R.bm25_index(chunks.filter("doc_id < 9 or doc_id is null"), keep=False)
    counted = {(r.doc_id, r.pos, r.term): (r.tf, r.dl) for r in one.postings.collect()}
    assert counted[None, 0, "w1x"][1] == 9 and one.postings.count() == len(counted) and one.stats.first().n_chunks == 122
    index = R.BM25Index(one.postings.unionByName(two.postings), one.df.unionByName(two.df).groupBy("term").agg(F.sum("df").alias("df")), one.stats)
    qs = spark.createDataFrame([(q, text(6)) for q in range(30)] + [(99, "unheard"), (None, "w1x")], "q_id long, question string")
    qt = R.query_terms(qs)
    key = lambda df: {(r.q_id, r.doc_id, r.pos, r.score, r["rank"]) for r in df.collect()}
    want = key(R.top_k(R.bm25_scores(index, qt), 4))
    monkeypatch.setattr(L, "PART_ROWS", 300)
    monkeypatch.setattr(L, "BATCH_QUERIES", 12)
    found = R.bm25_scores(index, qt, k=4)
    assert key(R.top_k(found, 4)) == want and len(want) == 124
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[doc_id" not in plan


def test_small_files_share_a_micro_batch(spark, tmp_path):
    import glob

    from remedy.streaming import jobs as S

    rows = [(i, f"word{i} passage tokens", "en", "web", 10) for i in range(8)]
    spark.createDataFrame(rows, S.DOCS_SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = S.read_table_stream(spark, str(tmp_path), "documents", S.DOCS_SCHEMA, bytes_per_trigger=1 << 20)
    index = S.run_reindex(spark, docs, str(tmp_path / "index"))
    assert {r.doc_id for r in index.postings.collect()} == set(range(8)) and index.stats.first().n_chunks == 8
    assert len(glob.glob(str(tmp_path / "index" / "postings" / "batch=*"))) == 1
