"""Registered retrieval and corpus-evaluation queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.functions.num import rnd
from remedy.operators import lexical as L
from remedy.operators import metrics as M
from remedy.operators import retrieve as R
from remedy.plans import fixtures as X
from remedy.plans.index import VERSIONS, index_at
from remedy.session import cut_lineage
from remedy.sources.tables import table


def _chunks(spark, sf):
    return R.chunk_windows(X.passages(spark, sf))


def ranked_with_text(spark, sf, qs, k):
    """BM25 top-k of the shared index with the chunk texts, materialised once (k rows per
    question): the metrics read it several times. Only the documents in the ranked lists are
    chunked again for their texts."""
    ranked = L.topk(index_at(spark, sf), qs, k)
    r, txt = R.chunk_text_for(ranked, table(spark, sf, "documents"))
    rt = cut_lineage(r.join(txt, ["doc_id", "pos"]))
    return rt.select("q_id", "doc_id", "pos", "score", "rank"), rt.select("doc_id", "pos", "text").distinct()


def _gold(spark, sf):
    """Gold passages per question: the question text itself, when some document
    contains it verbatim (D6 over whole documents)."""
    qs = X.questions(spark, sf)
    # The gold pairs are small (matches per question) and feed three branches:
    # materialise them once (reliable checkpoint).
    pairs = cut_lineage(R.gold_containment(table(spark, sf, "documents"), qs))
    has = pairs.select("q_id").distinct()
    gold = has.join(qs, "q_id").select("q_id", F.col("question").alias("gold"))
    n_gold = (qs.select("q_id").join(gold.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_gold")), "q_id", "left")
              .select("q_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold")))
    return gold, n_gold


def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: BM25 top-5 chunks per benchmark item, scored against gold passages
    (context precision@5 and recall)."""
    qs = X.questions(spark, sf)
    ranked, chunks = ranked_with_text(spark, sf, qs, 5)
    gold, n_gold = _gold(spark, sf)
    hits = M.chunk_hits(ranked, chunks, gold)
    cp = M.context_precision(hits, n_gold, 5)
    cr = M.context_recall(ranked, chunks, gold, n_gold)
    nh = hits.groupBy("q_id").agg(F.sum(F.col("hit").cast("int")).cast("long").alias("n_hits"))
    return (n_gold.join(cp, "q_id").join(cr, "q_id").join(nh, "q_id", "left")
            .select("q_id", "n_gold", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"),
                    rnd("context_precision", 6).alias("context_precision"),
                    rnd("context_recall", 6).alias("context_recall")))


def dedupe_passages(spark, sf):
    return X.passages(spark, sf)


def chunk_windows(spark, sf):
    return _chunks(spark, sf)


def chunk_sentences(spark, sf):
    return R.chunk_sentences(X.passages(spark, sf))


def bm25_stats(spark, sf):
    i = index_at(spark, sf)
    return i.terms.select("term", "df", F.lit(i.n_chunks).cast("long").alias("n_chunks"), rnd(F.lit(i.avgdl), 6).alias("avgdl"))


def bm25_topk(spark, sf):
    return L.topk(index_at(spark, sf), X.questions(spark, sf), 5).select("q_id", "doc_id", "pos", "score", "rank")


def bm25_refreshed(spark, sf):
    """A11 + C5: BM25 top-5 at each version of the refreshed corpus, from one index of deltas."""
    qs, out = X.questions(spark, sf), None
    for v in range(1, VERSIONS + 1):
        top = L.topk(index_at(spark, sf, v), qs, 5).select(F.lit(v).alias("kb_version"), "q_id", "doc_id", "pos", "score", "rank")
        out = top if out is None else out.unionByName(top)
    return out


def gold_containment(spark, sf):
    return R.gold_containment(table(spark, sf, "documents"), X.questions(spark, sf))


def gold_containment_short(spark, sf):
    """D6 of golds without an interior term: the first word of every item, and its first two."""
    q = X.questions(spark, sf)
    words = F.split("question", " ")
    two = q.select((F.col("q_id") * 2 + 1).alias("q_id"), F.array_join(F.slice(words, 1, 2), " ").alias("question"))
    golds = q.select((F.col("q_id") * 2).alias("q_id"), F.get(words, 0).alias("question")).unionByName(two)
    return R.gold_containment(table(spark, sf, "documents"), golds)


def precision_at_k(spark, sf):
    ranked, chunks = ranked_with_text(spark, sf, X.questions(spark, sf), 5)
    gold, _ = _gold(spark, sf)
    p = M.precision_at_k(M.chunk_hits(ranked, chunks, gold))
    return p.select("q_id", "k", rnd("precision", 6).alias("precision"))


def context_precision(spark, sf):
    return retrieval_eval(spark, sf).select("q_id", "context_precision")


def context_recall(spark, sf):
    return retrieval_eval(spark, sf).select("q_id", "context_recall")


def dense_topk(spark, sf):
    """Every embedding as a query against all embeddings (exact L2, k=5)."""
    v = X.vectors(spark, sf)
    return R.dense_topk(v.select("vec_id", "v"), v.select(F.col("vec_id").alias("q_id"), "v"), 5) \
        .select("q_id", "vec_id", "rank", "score")


def _reranked(spark, sf, k, n):
    index, qs = index_at(spark, sf), X.questions(spark, sf)
    w = L.query_weights(index, qs)
    return L.rerank(w, L.topk(index, qs, k, w), n)


def rerank_topn(spark, sf):
    return _reranked(spark, sf, 10, 3)


def similarity_filter(spark, sf):
    scored, txt = R.chunk_text_for(_reranked(spark, sf, 10, 10).drop("rank"), table(spark, sf, "documents"))
    return R.similarity_filter(scored, txt, 0.4).select("q_id", "doc_id", "pos", "score")


def pack_context(spark, sf):
    ranked = L.topk(index_at(spark, sf), X.questions(spark, sf), 20).select("q_id", "doc_id", "pos", "score", "rank")
    ranked, txt = R.chunk_text_for(ranked, table(spark, sf, "documents"))
    return R.pack_context(ranked, txt, 2000)


def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked chunks of every question under each of the 36 configurations. One
    ranking a retriever (k = 20, with its rerank order) serves them all: a smaller k is a
    prefix, the rerank orders that prefix anew, and the prompt does not change the ranking.
    The dense retriever compares a question's vector with those of the documents (embedding
    rows of their ids) and returns their first chunk."""
    index, qs = index_at(spark, sf), X.questions(spark, sf)
    w = L.query_weights(index, qs)
    lexical = L.topk(index, qs, 20, w).select(F.lit("bm25").alias("retriever"), "q_id", "doc_id", "pos", "rank", "hit")
    v = X.vectors(spark, sf).select("vec_id", "v")
    docs = v.join(X.passages(spark, sf).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = X.vectors(spark, sf).select(F.col("vec_id").alias("q_id"), "v").join(qs.select("q_id"), "q_id", "left_semi")
    near = R.dense_topk(docs, asked, 20)
    near = cut_lineage(near.select("q_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("pos"), "rank"))
    dense = L.term_hits(index, w, near).select(F.lit("dense").alias("retriever"), "q_id", "doc_id", "pos", "rank", "hit")
    both = cut_lineage(lexical.unionByName(dense))
    total = w.groupBy("q_id").agg(F.sum("idf").alias("tot"))
    both = both.join(total, "q_id", "left").withColumn("share", F.coalesce(rnd(F.col("hit") / F.col("tot"), 6), F.lit(0.0)))
    # the configurations: k cuts a prefix; a reranker keeps its best 3 of it
    cut = both.withColumn("topk", F.explode(F.array(*map(F.lit, (5, 10, 20))))).filter(F.col("rank") <= F.col("topk"))
    order = W.partitionBy("retriever", "q_id", "topk").orderBy(F.col("share").desc(), "doc_id", "pos")
    again = cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
    out = cut.withColumn("reranker", F.lit(False)).unionByName(again.withColumn("reranker", F.lit(True)))
    prompts = F.explode(F.array(*map(F.lit, ("simple_qa", "paraphrase_qa", "simplify_qa"))))
    return out.select("q_id", "retriever", "topk", "reranker", prompts.alias("prompt_edit"), "rank", "doc_id", "pos")
