"""Blocks inverted by themselves, tiles for frequent terms, words stemmed in tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from remedy.functions import stem as S
from remedy.operators import lexical as L


def test_stem_word_is_english_stem(spark):
    rng = random.Random(4)
    ends = sorted({*S.ENDINGS, *S.SPECIAL, *S.AFTER_1A, "sses", "ied", "eedly", "ingly", "us", "ogi"})
    words = {"".join(rng.choice("aeiouyblstnrwx") for _ in range(rng.randrange(6))) + "".join(rng.choice(ends) for _ in range(rng.randrange(1, 3)))
             for _ in range(3000)} | {"", "y", "é", "naïvely", "straße", "日本語s", "yyyy"}
    t = spark.createDataFrame([(w,) for w in words], "term string").repartition(4)  # not folded by the optimizer
    assert [(r.term, r.s) for r in t.select("term", S.english_stem(F.col("term")).alias("s")).collect() if S.stem_word(r.term) != r.s] == []


def test_a_block_is_inverted_by_itself():
    t = pa.table({"block": [7] * 4, "doc_id": [5, 3, 5, None], "pos": pa.array([0, 1, 0, 0], pa.int32()),
                  "words": ["reds red blue", "", "red", "blue blues"]})
    got = {r["term"]: r for r in L._invert(t).to_pylist()}
    assert set(got) == {"red", "blue"} and got["red"]["block"] == 7
    # the chunk that comes twice adds up, with its largest length
    assert got["red"]["chunks"] == [{"doc_id": 5, "pos": 0, "tf": 3, "dl": 3}]
    assert {(c["doc_id"], c["tf"], c["dl"]) for c in got["blue"]["chunks"]} == {(5, 1, 3), (None, 2, 2)}
    assert (got["blue"]["max_tf"], got["blue"]["min_dl"]) == (2, 2)
    assert L._invert(t.slice(1, 1)).num_rows == 0


def test_terms_in_many_chunks_are_scored_in_tiles(spark, tmp_path, monkeypatch):
    """Two questions of words that all chunks hold: no (question, chunk) row is made."""
    rng = random.Random(6)
    docs = [("d", i, " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randrange(4, 30)))) for i in range(300)]
    L.add_deltas(str(tmp_path), spark.createDataFrame(docs, "delta string, doc_id long, text string"), {"d": (0, None)})
    index = L.open_index(spark, str(tmp_path))
    qs = spark.createDataFrame([(1, "ab cd"), (2, "gh ef ab")], "q_id long, question string")
    key = lambda df: {(r.q_id, r["rank"], r.doc_id, r.pos, r.score, round(r.hit, 6)) for r in df.collect()}
    want = key(L.topk(index, qs, 3))
    monkeypatch.setattr(L, "MANY_MATCHES", 1000)
    monkeypatch.setattr(L, "block_scores", lambda *a: 1 / 0)
    assert key(L.topk(index, qs, 3)) == want


def test_short_golds_of_every_size(spark):
    from remedy.operators import retrieve as R

    texts = {1: "a b", 2: "ab", 3: "xaby", 4: "日本語 ab", 5: "", 6: "𝒳 is wide 𝒳y", 7: "b\x00a"}
    golds = {10: "a", 11: "ab", 12: "aby", 13: "日本", 14: "𝒳y", 15: "is wide", 16: "", 17: "zz", 18: "\x00a", 19: "a"}
    got = R.gold_containment(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                             spark.createDataFrame(list(golds.items()), "q_id long, question string"))
    assert sorted((r.q_id, r.doc_id) for r in got.collect()) == sorted((g, d) for g, x in golds.items() for d, t in texts.items() if x in t)
    # one scan counts the runs of all sizes, in arrays
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_a_cosine_is_computed_once_a_pair(spark):
    """answer_relevancy joins vectors to distinct pairs of rows; the answers carry ids only."""
    from given import SF_SMALL
    from remedy.plans import diagnosis as D

    found = D.answer_relevancy(spark, SF_SMALL)._jdf.queryExecution()
    assert "Aggregate [qrow" in found.optimizedPlan().toString()
    assert "BroadcastHashJoin" not in found.executedPlan().toString()


def test_counts_search_the_documents_once(spark, monkeypatch):
    from given import SF_SMALL
    from remedy.operators import retrieve as R
    from remedy.plans import corpus as CQ

    calls, plain = [], R.gold_containment
    monkeypatch.setattr(R, "gold_containment", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert len(CQ.corpus_counts(spark, SF_SMALL).collect()) == 7
    assert len(calls) == 1


def test_pieces_are_matched_once_and_only_in_chosen_texts(spark):
    """Chunks of a few documents: the pieces of the others are not looked for, and the rows
    of a document do not carry all its pieces."""
    from remedy.operators import retrieve as R

    docs = spark.createDataFrame([(i, f"w{i} " * (300 * i)) for i in range(4)] + [(9, None), (10, " \n")], "doc_id long, text string").repartition(2)
    ids = spark.createDataFrame([(1,), (2,), (9,)], "doc_id long").repartition(2)
    got = R.chunk_windows(docs.join(ids, "doc_id", "left_semi"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.index("regexp_extract_all") < plan.index("Join LeftSemi")  # above the join
    assert "posexplode(transform(" in plan
    rows = sorted(map(tuple, got.collect()))
    want = [(i, p, " ".join([f"w{i}"] * min(128, 300 * i - 112 * p))) for i in (1, 2) for p in range((300 * i - 17) // 112 + 1)]
    assert rows == want


def test_texts_without_a_candidate_are_not_shuffled(spark):
    """Long golds: the texts are searched where they are read; those that no gold may be in
    are left out before the lookup by id. Ids may repeat or be null, as before."""
    from remedy.operators import retrieve as R

    texts = [(1, "one two three four"), (1, "one two three four"), (2, "two three"), (3, "zero one two three"), (None, "one two three"), (4, None)]
    golds = [(10, "one two three"), (11, "two three four"), (12, "no such words")]
    got = R.gold_containment(spark.createDataFrame(texts, "doc_id long, text string").repartition(3),
                             spark.createDataFrame(golds, "q_id long, question string"))
    # both rows of document 1 are candidates and both are looked up
    assert sorted(map(tuple, got.collect())) == [(10, 1)] * 4 + [(10, 3)] + [(11, 1)] * 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "RepartitionByExpression" not in plan


def test_only_one_column_of_postings_is_read_to_count_them(spark, tmp_path, monkeypatch):
    from pyspark.sql import GroupedData

    plans, plain = [], GroupedData.agg
    monkeypatch.setattr(GroupedData, "agg", lambda self, *e: plans.append(plain(self, *e)) or plans[-1])
    L.add_deltas(str(tmp_path), spark.createDataFrame([("d", 1, "ab cd ab"), ("d", 2, "cd")], "delta string, doc_id long, text string"), {"d": (0, None)})
    read = [p for p in (x._jdf.queryExecution().executedPlan().toString() for x in plans) if "chunks:array" in p]
    assert read and all("chunks:array<struct<tf:bigint>>" in p for p in read)
    assert {(r.term, r.df) for r in L.open_index(spark, str(tmp_path)).terms.collect()} == {("ab", 1), ("cd", 2)}
