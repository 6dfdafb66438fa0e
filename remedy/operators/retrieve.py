"""Retrieval: chunking, BM25, exact dense top-k, rerank, similarity filter, packing,
and the gold-containment join used by the context metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from remedy.functions.num import np_rnd, rnd

from remedy.functions import text as T
from remedy.functions.stem import stem_table
from remedy.session import bounded_broadcast

# BM25 constants (Robertson & Zaragoza): not given by the reference, stated here.
BM25_K1 = 1.5
BM25_B = 0.75
CHUNK_SIZE = 128
CHUNK_OVERLAP = 16


def chunk_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, carry=()) -> DataFrame:
    """Fixed windows of ``size`` word pieces with ``overlap`` (stride size-overlap).

    A chunk is an exact substring of the source text (pieces keep their trailing
    blanks; the chunk's own trailing blanks are removed). A tail window lying wholly
    inside the previous overlap is not emitted. Runs row-local: no shuffle.
    """
    stride = size - overlap
    n = F.size("_p")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(stride))
    # pieces come out of a generator, so no filter on them is pushed below it (and below a join
    # that chooses the texts), where they would be matched again; rows carry a chunk's text
    # only, not all pieces of its document
    x = df.select(F.col(id_col), F.explode(F.array(T.pieces(text_col))).alias("_p"), *carry).filter(F.size("_p") > 0)
    texts = F.transform(starts, lambda s: F.regexp_replace(
        F.array_join(F.slice(F.col("_p"), s + 1, F.lit(size)), ""), r"\s+$", ""))
    return x.select(*carry, id_col, F.posexplode(texts).alias("pos", "text"))


def sentence_bounds(words: np.ndarray, budget: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks as ranges [start, end) of sentences with ``words`` words each: as many sentences
    as fit the budget, at least one. The next chunk begins again with the last sentences of
    the one before, as many as hold at most ``overlap`` words and leave room for a new one."""
    total = np.concatenate([[0], np.cumsum(words)])
    out, start, n = [], 0, len(words)
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, total[start] + budget, "right")) - 1)
        out.append((start, end))
        if end == n:
            break
        # the first sentence that may be repeated: few enough words, and room for the next
        least = max(total[end] - overlap, total[end + 1] - budget)
        start = max(start + 1, min(end, int(np.searchsorted(total, least, "left"))))
    return out


def chunk_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    budget: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Whole sentences packed into chunks of at most ``budget`` words, ``overlap`` words of
    whole sentences shared by neighbours (a sentence longer than the budget is a chunk of its
    own). Bounds come from a search in the running word counts, and a chunk joins its own
    sentences only, so the work is linear in the text (an array slice in SQL would copy the
    whole array for every chunk). Sentences are split and counted in SQL."""
    def pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sents, words in batches:
            out = []
            for s, w in zip(sents, words):
                w = np.asarray(w, dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(w)])
                out.append([{"text": " ".join(s[i:j]), "n_words": int(total[j] - total[i])}
                            for i, j in sentence_bounds(w, budget, overlap)])
            yield pd.Series(out)

    packed = F.pandas_udf(pack, "array<struct<text: string, n_words: int>>")
    sents = F.filter(F.split(F.col(text_col), r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))
    x = df.select(id_col, sents.alias("_s")).filter(F.size("_s") > 0)
    x = x.withColumn("_w", F.transform("_s", lambda s: F.regexp_count(s, F.lit(r"\S+"))))
    return x.select(id_col, F.posexplode(packed("_s", "_w")).alias("pos", "c")).select(id_col, "pos", "c.text", "c.n_words")


@dataclass
class BM25Index:
    postings: DataFrame   # doc_id, pos, term, tf, dl
    df: DataFrame         # term, df
    stats: DataFrame      # n_chunks, avgdl (one row)


def term_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dl, terms): the number of index terms of each chunk, and its distinct ones with
    their counts (term, tf). Row-local: runs in the sorted terms are counted, so a task holds
    one chunk, however many it reads."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                          lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        entries = F.transform(F.array(starts), lambda at: F.transform(at, lambda x, j: F.struct(
            F.get(s, x).alias("term"), (F.coalesce(F.get(at, j + 1), n) - x).cast("long").alias("tf"))))
        return F.struct(n.alias("dl"), F.get(entries, 0).alias("terms"))

    counted = F.get(F.transform(F.array(F.sort_array(T.index_terms("text"))), runs), 0)
    return chunks.select(*keys, counted.alias("_c")).select(*keys, "_c.dl", "_c.terms")


def bm25_index(chunks: DataFrame, keep: bool = True) -> BM25Index:
    """Term frequency, document frequency, length, average length and N of a set of
    chunks, in memory of one job (the streamed index; ``lexical`` keeps the shared one).

    One tokenising pass takes the terms of every chunk, kept by a reliable checkpoint. A chunk is
    shuffled once, as one row of words, and its terms are stemmed and counted in arrays. Postings
    that the caller writes need not be kept here."""
    from remedy.operators import lexical as L
    from remedy.session import cut_lineage

    keys = ["doc_id", "pos"]
    # terms are letters and digits, so a blank parts them
    words = F.struct(F.size("_t").alias("dl"), F.array_join("_t", " ").alias("words"))
    kept = cut_lineage(chunks.select(*keys, T.index_terms("text").alias("_t")).select(*keys, words.alias("_w")).select(*keys, "_w.*"))
    n_chunks, n_terms = kept.agg(F.count(F.lit(1)), F.sum("dl")).first()
    blocks = max(1, math.ceil(n_chunks / (16 * L.BLOCK_CHUNKS)))
    spread = min(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    parts = max(1, spread, math.ceil((n_terms or 0) / L.PART_ROWS))
    kinds = dict(kept.dtypes)
    shape = (f"block long, term string, max_tf long, min_dl int, chunks array<struct<doc_id: {kinds['doc_id']}, pos: {kinds['pos']}, "
             "tf: long, dl: int>>")
    dealt = kept.select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block"), *keys, "words").repartition(parts, "block")
    postings = dealt.groupBy("block").applyInArrow(L._invert, shape).select("term", F.inline("chunks")).select(*keys, "term", "tf", "dl")
    postings = cut_lineage(postings) if keep else postings
    dfreq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = kept.groupBy(*keys).agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
    return BM25Index(postings, dfreq, stats)


def query_terms(queries: DataFrame, q_col: str = "q_id", text_col: str = "question") -> DataFrame:
    """Distinct stems per query, stop words left out (each counted once). The distinct terms
    of all queries are stemmed once."""
    raw = queries.select(F.col(q_col).alias("q_id"), F.explode(F.array_distinct(T.index_terms(text_col))).alias("term"))
    return raw.join(stem_table(raw), "term").select("q_id", F.col("stem").alias("term")).distinct()


def bm25_scores(index: BM25Index, qterms: DataFrame, k: int | None = None) -> DataFrame:
    """Per (query, chunk) BM25 score, rounded to 6 places before any ranking.

    With ``k`` only chunks that may be among the k best of a query are returned: they are found
    in arrays (``lexical.chunk_topk``), and no other pair becomes a row.

    The per-query idf table (queries x their distinct terms) is broadcast after a
    row-count check; the postings stream through the join in their chunk
    partitioning, so the (query, chunk) sum runs without a shuffle and only the
    per-query top-k leaves each partition. Beyond the size bound the planner joins
    on ``term`` (AQE splits hot terms)."""
    from remedy.session import cut_lineage

    stats, dfreq = F.broadcast(index.stats), index.df  # stats: one row
    if k is not None:  # only the terms asked for are counted
        qterms = cut_lineage(qterms)
        dfreq = dfreq.join(bounded_broadcast(qterms.select("term").distinct()), "term", "left_semi")
    idf = (qterms.join(dfreq, "term")
                 .crossJoin(stats)
                 .select("q_id", "term", "df",
                         F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
                         "avgdl"))
    if k is not None:
        from remedy.operators import lexical as L

        return L.chunk_topk(index.postings, cut_lineage(idf), k, index.stats.first().avgdl or 0.0)
    tf, dl = F.col("tf"), F.col("dl")
    contrib = F.col("idf") * tf * (BM25_K1 + 1) / (
        tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.col("avgdl")))
    return (index.postings.join(bounded_broadcast(idf.drop("df")), "term")
               .groupBy("doc_id", "pos", "q_id").agg(F.sum(contrib).alias("_s"))
               .select("q_id", "doc_id", "pos", rnd("_s", 6).alias("score")))


def top_k(scores: DataFrame, k: int, descending: bool = True, part: str = "q_id",
          order_ids=("doc_id", "pos")) -> DataFrame:
    """Per-query top-k with ``row_number`` (planned as a WindowGroupLimit); ties by id."""
    o = F.col("score").desc() if descending else F.col("score").asc()
    w = W.partitionBy(part).orderBy(o, *[F.col(c).asc() for c in order_ids])
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- dense exact top-k -------------------------------------------------------

def _row_topk(cd: np.ndarray, ci: np.ndarray, k: int):
    """Exact k smallest per row by (distance, id): a linear-time partition picks
    every entry not above the k-th smallest distance (ties included), and only
    those few candidates are sorted."""
    kk = min(k, cd.shape[1])
    kth = np.partition(cd, kk - 1, axis=1)[:, kk - 1:kk]
    rows, cols = np.nonzero(cd <= kth)
    dv, iv = cd[rows, cols], ci[rows, cols]
    order = np.lexsort((iv, dv, rows))
    rows, dv, iv = rows[order], dv[order], iv[order]
    counts = np.bincount(rows, minlength=cd.shape[0])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    take = starts[:, None] + np.arange(kk)[None, :]
    return dv[take], iv[take]


def _near_topk(d: np.ndarray, ids: np.ndarray, k: int, places: int | None, group: int = 32):
    """Like ``_row_topk`` for finite distances that are rounded (or not) only here: the k-th
    smallest of the minima of ``group`` columns bounds a row's k-th distance, and only the
    entries below it, with those that rounding may make equal, are rounded and sorted."""
    kk, n = min(k, d.shape[1]), d.shape[1] // group
    if n < kk:
        d = d if places is None else np_rnd(d, places)
        return _row_topk(d, np.broadcast_to(ids, d.shape), k)
    least = d[:, :n * group].reshape(d.shape[0], n, group).min(axis=2)
    kth = np.partition(least, kk - 1, axis=1)[:, kk - 1:kk]
    slack = 0.0 if places is None else 2.0 * 10.0 ** -places
    rows, cols = np.nonzero(d <= kth + slack)
    dv, iv = d[rows, cols], ids[cols]
    dv = dv if places is None else np_rnd(dv, places)
    order = np.lexsort((iv, dv, rows))
    dv, iv = dv[order], iv[order]
    counts = np.bincount(rows, minlength=d.shape[0])
    take = np.concatenate([[0], np.cumsum(counts)[:-1]])[:, None] + np.arange(kk)[None, :]
    return dv[take], iv[take]


def _block_topk(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, rows: int = 1024, places: int | None = 6):
    """(distance, id) of each query's k nearest rows of ``m``: squared L2 by matrix products,
    ``rows`` queries at a time, ties (after rounding to ``places``) by id."""
    qn, mn, out = (q * q).sum(axis=1), (m * m).sum(axis=1), []
    finite = bool(np.isfinite(qn).all() and np.isfinite(mn).all())
    for s in range(0, len(q), rows):
        d = q[s:s + rows] @ m.T
        d *= -2.0
        d += mn[None, :]
        d += qn[s:s + rows, None]
        np.maximum(d, 0.0, out=d)
        if finite:
            out.append(_near_topk(d, ids, k, places))
        else:
            d = d if places is None else np_rnd(d, places)
            out.append(_row_topk(d, np.broadcast_to(ids, d.shape), k))
    return np.concatenate([d for d, _ in out]), np.concatenate([i for _, i in out])


def dense_topk(index: DataFrame, queries: DataFrame, k: int = 5, part_rows: int = 20_000,
               batch_rows: int = 5_000, places: int | None = 6) -> DataFrame:
    """F1/D3: exact L2 nearest neighbours, ascending distance (rounded to ``places``, None:
    as computed), ties by id.

    ``index``: (vec_id, v array<double>); ``queries``: (q_id, v). Both sides are hashed,
    the index into parts of about ``part_rows`` and the queries into blocks of about
    ``batch_rows``; a task meets one block with one part in matrix products and returns
    k rows per query. Nothing passes through the driver and nothing is broadcast; a task
    holds one part and one block, whatever the sizes. A per-query window keeps the k best."""
    parts = max(1, math.ceil(index.count() / part_rows))
    blocks = max(1, math.ceil(queries.count() / batch_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = index.select(F.col("vec_id").cast("long").alias("vec_id"), "v").withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    q = queries.select(F.col("q_id").cast("long").alias("q_id"), "v").withColumn(
        "block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        d, i = _block_topk(matrix(left), right.column("vec_id").to_numpy(), matrix(right), k, places=places)
        return pa.table({"q_id": np.repeat(left.column("q_id").to_numpy(), d.shape[1]), "vec_id": i.ravel(), "score": d.ravel()})

    near = q.groupBy("part", "block").cogroup(x.groupBy("part", "block")).applyInArrow(
        meet, "q_id long, vec_id long, score double")
    return top_k(near, k, descending=False, order_ids=("vec_id",))


# ---- rerank, similarity filter, packing --------------------------------------

def chunk_text_for(ranked: DataFrame, docs: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts of the chunks a ranked list refers to, without re-chunking the corpus.

    The ranked list (k rows per query) is materialised once; only documents whose
    ids it contains are chunked again (a size-checked broadcast semi join on the
    id). Returns (materialised ranked list, chunk texts of those documents)."""
    from remedy.session import cut_lineage

    r = cut_lineage(ranked)
    ids = r.select(F.col("doc_id").alias(id_col)).distinct()
    sel = docs.select(id_col, text_col).join(bounded_broadcast(ids), id_col, "left_semi")
    return r, chunk_windows(sel, id_col, text_col)

def rerank_topn(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, scorer, n: int = 3) -> DataFrame:
    """F3 with a plugged-in pair scorer: an Arrow ``pandas_udf(question, text) -> double`` (e.g.
    a cross-encoder) rescores (query, chunk) candidates; the best n stay. ``lexical.rerank``
    is the scorer of the registered queries."""
    pairs = (candidates.select("q_id", "doc_id", "pos")
             .join(chunks, ["doc_id", "pos"])
             .join(queries.select("q_id", "question"), "q_id"))
    return top_k(pairs.select("q_id", "doc_id", "pos", rnd(scorer("question", "text"), 6).alias("score")), n)


def similarity_filter(scored: DataFrame, chunks: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """keep similarities >= cutoff, drop empty texts, drop duplicates and
    near-duplicates (same text after lower-casing and blank squeezing), keeping the
    best-ranked copy. Applies to similarity scores only (never to distances)."""
    x = (scored.filter(F.col("score") >= cutoff)
         .join(chunks, ["doc_id", "pos"])
         .filter(F.trim("text") != ""))
    norm = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    w = W.partitionBy("q_id", "_norm").orderBy(F.col("score").desc(), "doc_id", "pos")
    return (x.withColumn("_norm", norm).withColumn("_r", F.row_number().over(w))
             .filter(F.col("_r") == 1).drop("_r", "_norm", "text"))


def pack_context(ranked: DataFrame, chunks: DataFrame, budget_chars: int = 2000,
                 sep: str = "\n\n") -> DataFrame:
    """pack ranked chunk texts into prompts of about ``budget_chars`` characters:
    pack number = (running length before the chunk) div budget. Each pack is
    bounded by k chunks of one query, so the per-group collect is bounded."""
    x = ranked.join(chunks, ["doc_id", "pos"])
    w = W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    x = x.withColumn("pack", (F.col("_before") / F.lit(budget_chars)).cast("long"))
    return (x.groupBy("q_id", "pack")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                           lambda s: s["text"]), sep).alias("context"),
                  F.count(F.lit(1)).alias("n_chunks")))


# ---- gold containment ---------------------------------------------------------

def _grams(text: str, sizes: list[int]) -> Column:
    """Distinct runs of so many characters (1 to 3 each) of a text as numbers, 21 bits a
    character and none of them 0, so that runs of two sizes differ. Linear in the length."""
    def runs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                c = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
                codes = [np.zeros(max(len(c) - q + 1, 0), np.int64) for q in sizes]
                for q, code in zip(sizes, codes):
                    for i in range(q):
                        code <<= 21
                        code |= c[i:i + len(code)]
                out.append(np.unique(np.concatenate(codes)))
            yield pd.Series(out)

    return F.pandas_udf(runs, "array<long>")(F.col(text))


def _anchored(d: DataFrame, golds: DataFrame, anchors: DataFrame, held: Column, kept: bool = False) -> DataFrame:
    """Pairs (_g, _d): every gold meets the texts that hold the rarest of its ``anchors``
    (_g, term), and is looked for there. ``held``: the terms of a text as an array. The terms of
    the texts are counted in one pass and met with the rarest ones, a row a gold, in another,
    both where the texts are read. ``kept`` candidates are materialised, so that no other text
    is shuffled to be met with them."""
    from remedy.session import cut_lineage

    vocab = bounded_broadcast(anchors.select("term").distinct())
    doc_terms = d.select("_d", F.explode(held).alias("term"))
    dfreq = doc_terms.join(vocab, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rarest = cut_lineage(anchors.join(dfreq, "term")
              .withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("_df", "term")))
              .filter(F.col("_r") == 1).select("_g", "term"))
    cand = doc_terms.join(bounded_broadcast(rarest), "term").select("_g", "_d")
    if kept:
        cand = cut_lineage(cand)
        d = d.join(bounded_broadcast(cand.select("_d").distinct()), "_d", "left_semi")
    return (cand.join(golds, "_g").join(d, "_d")
                .filter(F.contains(F.col("_dt"), F.col("_gt"))).select("_g", "_d"))


def gold_containment(docs: DataFrame, golds: DataFrame, doc_id: str = "doc_id",
                     doc_text: str = "text", gold_id: str = "q_id", gold_text: str = "question", q: int = 3) -> DataFrame:
    """Pairs (gold, doc) with gold text a case-sensitive substring of the doc.

    Exact, without a nested loop over all pairs: a term strictly inside the gold (neither its
    first nor its last term) is a whole term of any text containing the gold. Each gold is
    anchored on its rarest interior term; candidate docs come from an equi-join on that term
    and are verified with ``contains``. Golds of fewer than three terms have no interior term;
    they are anchored on their rarest run of ``q`` characters (on themselves, if shorter), and
    only runs that some gold holds are indexed. An empty gold is in every text.

    Terms are counted where the texts are read; of long golds only candidate texts are shuffled.
    """
    d = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_dt"))
    g = golds.select(F.col(gold_id).alias("_g"), F.col(gold_text).alias("_gt")).withColumn("_ts", T.terms("_gt"))
    long, short = g.filter(F.size("_ts") >= 3), g.filter((F.size("_ts") < 3) & (F.col("_gt") != ""))
    interior = long.select("_g", F.explode(F.slice("_ts", 2, F.size("_ts") - 2)).alias("term")).distinct()
    out = _anchored(d, long.select("_g", "_gt"), interior, F.array_distinct(T.terms("_dt")), kept=True)
    k = F.least(F.char_length("_gt"), F.lit(q))
    sizes = sorted(r[0] for r in short.select(k.alias("k")).distinct().collect())  # 1 to q
    if sizes:
        runs = [short.filter(k == n).select("_g", F.explode(_grams("_gt", [n])).alias("term")) for n in sizes]
        out = out.unionByName(_anchored(d, short.select("_g", "_gt"), reduce(DataFrame.unionByName, runs), _grams("_dt", sizes)))
    # an empty gold meets every text by the length of the text's empty beginning
    empty = g.select("_g", F.char_length("_gt").alias("_k")).filter("_k = 0")
    begins = d.select("_d", F.char_length(F.substring("_dt", 1, 0)).alias("_k"))
    out = out.unionByName(begins.join(empty, "_k").select("_g", "_d"))
    return out.select(F.col("_g").alias(gold_id), F.col("_d").alias(doc_id))
