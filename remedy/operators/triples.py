"""Knowledge-triple consistency: candidate facts per answer triple, thresholded
subject/relation/object similarity, per-triple and per-answer roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.functions.num import rnd
from remedy.operators.policy import dot
from remedy.operators.retrieve import dense_topk
from remedy.session import bounded_broadcast, cut_lineage

#: distances are rounded to 6 places
EPS = 2e-6
STATUS_RANK = {"CONSISTENT": 1, "CONFLICT": 2, "MISSING": 3}


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, c) and (c, v): rows of equal vectors share one c, the smallest of their ids.
    Kept by a reliable checkpoint, since several joins read both."""
    v = vectors.select("vec_id", "v")
    distinct = cut_lineage(v.groupBy("v").agg(F.min("vec_id").alias("c"), F.collect_list("vec_id").alias("_ids")))
    return distinct.select(F.explode("_ids").alias("vec_id"), "c"), distinct.select("c", "v")


def with_elements(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach the vectors of s, r and o by their c (s_c, r_c, o_c), no vector itself: a row
    stays narrow, however many rows share an element. Joined on the key."""
    out = df
    for e in ("s", "r", "o"):
        out = out.join(ids.select(F.col("vec_id").alias(f"{e}_row"), F.col("c").alias(f"{e}_c")), f"{e}_row")
    return out


def _tail_distances(claims: DataFrame, facts: DataFrame, vec: DataFrame) -> DataFrame:
    """(r_c, o_c, fr, fo, dt): squared L2 between the relation and object vectors of every
    tail (r, o) of a claim and every tail of a fact, of which there are few (one a dimension
    row), however many subjects share them."""
    def pairs(e):
        a = claims.select(f"{e}_c").distinct().join(vec.select(F.col("c").alias(f"{e}_c"), F.col("v").alias("_a")), f"{e}_c")
        b = facts.select(F.col(f"{e}_c").alias(f"f{e}")).distinct().join(
            vec.select(F.col("c").alias(f"f{e}"), F.col("v").alias("_b")), f"f{e}")
        d = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return a.crossJoin(b).select(f"{e}_c", f"f{e}", d.alias(f"_d{e}"))

    tails = claims.select("r_c", "o_c").distinct().crossJoin(
        facts.select(F.col("r_c").alias("fr"), F.col("o_c").alias("fo")).distinct())
    t = tails.join(pairs("r"), ["r_c", "fr"]).join(pairs("o"), ["o_c", "fo"])
    return cut_lineage(t.select("r_c", "o_c", "fr", "fo", (F.col("_dr") + F.col("_do")).alias("dt")))


def triple_topk(claims: DataFrame, facts: DataFrame, vec: DataFrame, k: int = 3, near: int = 32) -> DataFrame:
    """the k most similar facts per answer triple. With unit element vectors, the highest
    summed cosine equals the smallest squared L2 distance of the concatenated vectors, which
    is the sum of the distances of subjects and of tails (relation, object). ``claims`` and
    ``facts`` name their vectors by c (``with_elements``); ``vec`` holds them (c, v).

    Exact, without a distance for every pair of triples: the dense top-k operator gives every
    distinct subject its ``near`` nearest subjects of facts, and their facts are ranked by the
    whole distance. A claim is settled when its k-th distance lies below that of the farthest
    subject seen, as no unseen fact is nearer; the others look at eight times as many subjects,
    at last at all. Distances are rounded to 6 places for the ranking, ties by fact id."""
    keys = ["s_c", "r_c", "o_c"]
    f = facts.select("fact_id", *(F.col(c).alias(f"f{c[0]}") for c in keys))
    # of facts with equal vectors the k smallest ids can be among the k best
    w = W.partitionBy("fs", "fr", "fo").orderBy("fact_id")
    f = cut_lineage(f.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r"))
    dt = _tail_distances(claims, facts, vec)
    heads = cut_lineage(f.select(F.col("fs").alias("c")).distinct().join(vec, "c")).withColumnRenamed("c", "vec_id")
    total = heads.count()
    left = cut_lineage(claims.select(*keys).distinct())
    done = None
    while total and not left.isEmpty():
        asked = left.select(F.col("s_c").alias("c")).distinct().join(vec, "c").select(F.col("c").alias("q_id"), F.col("v").alias("v"))
        found = dense_topk(heads, asked, near, places=None)
        found = cut_lineage(found.select(F.col("q_id").alias("s_c"), F.col("vec_id").alias("fs"), F.col("score").alias("ds")))
        # per subject and tail only the k best, and what rounding may make equal to them
        x = found.join(f, "fs")
        by = W.partitionBy("s_c", "fr", "fo")
        x = x.withColumn("_r", F.row_number().over(by.orderBy("ds", "fact_id")))
        x = x.withColumn("_k", F.min(F.when(F.col("_r") == k, F.col("ds"))).over(by))
        x = x.filter(F.col("_k").isNull() | (F.col("ds") <= F.col("_k") + EPS)).select("s_c", "fr", "fo", "ds", "fact_id")
        s = left.join(x, "s_c").join(bounded_broadcast(dt), ["r_c", "o_c", "fr", "fo"])
        s = s.select(*keys, "fact_id", rnd(F.col("ds") + F.col("dt"), 6).alias("score"))
        best = W.partitionBy(*keys).orderBy("score", "fact_id")
        s = cut_lineage(s.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        if near < total:
            far = found.groupBy("s_c").agg(F.max("ds").alias("_far"))
            nearest = dt.groupBy("r_c", "o_c").agg(F.min("dt").alias("_dt"))
            kth = s.filter(F.col("rank") == k).select(*keys, F.col("score").alias("_kth"))
            settled = cut_lineage(kth.join(far, "s_c").join(bounded_broadcast(nearest), ["r_c", "o_c"])
                                  .filter(F.col("_kth") + EPS < F.col("_far") + F.col("_dt")).select(*keys))
            left = cut_lineage(left.join(settled, keys, "left_anti"))
            s = s.join(settled, keys, "left_semi")
        else:
            left = left.limit(0)
        done = s if done is None else done.unionByName(s)
        near *= 8
    if done is None:
        done = f.select(F.col("fs").alias("s_c"), F.col("fr").alias("r_c"), F.col("fo").alias("o_c"), "fact_id",
                        F.lit(0.0).alias("score")).limit(0)
    out = claims.select("answer_id", *keys).join(done.select(*keys, "fact_id", "score"), keys)
    last = W.partitionBy("answer_id").orderBy("score", "fact_id")
    return (out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
               .select("answer_id", "fact_id", "rank", "score"))


def status_of(s: Column, r: Column, o: Column, thresholds=(0.9, 0.9, 0.1)) -> Column:
    """Ordered thresholds on the similarities of subject, relation and object: subject or
    relation below -> MISSING; object below -> CONFLICT; else CONSISTENT."""
    ts, tr, to = thresholds
    return (F.when(s < ts, F.lit("MISSING"))
             .when(r < tr, F.lit("MISSING"))
             .when(o < to, F.lit("CONFLICT"))
             .otherwise(F.lit("CONSISTENT")))


def check_status(q_s: Column, q_r: Column, q_o: Column, d_s: Column, d_r: Column, d_o: Column,
                 thresholds=(0.9, 0.9, 0.1)) -> Column:
    """D5 of one pair of triples by their element vectors."""
    return status_of(dot(q_s, d_s), dot(q_r, d_r), dot(q_o, d_o), thresholds)


def triple_status(cands: DataFrame, claims: DataFrame, facts: DataFrame, vec: DataFrame,
                  thresholds=(0.9, 0.9, 0.1)) -> DataFrame:
    """D5 of every candidate. The similarity of two elements is computed once per pair of
    distinct vectors, not once per pair of triples."""
    c = claims.select("answer_id", "s_c", "r_c", "o_c")
    f = facts.select("fact_id", *(F.col(f"{e}_c").alias(f"f{e}") for e in "sro"))
    j = cut_lineage(cands.select("answer_id", "fact_id").join(c, "answer_id").join(f, "fact_id"))
    for e in "sro":
        a, b = (vec.select(F.col("c").alias(n), F.col("v").alias(v)) for n, v in ((f"{e}_c", "_a"), (f"f{e}", "_b")))
        p = j.select(f"{e}_c", f"f{e}").distinct().join(a, f"{e}_c").join(b, f"f{e}")
        p = p.select(f"{e}_c", f"f{e}", dot(F.col("_a"), F.col("_b")).alias(f"_{e}"))
        j = j.join(p, [f"{e}_c", f"f{e}"])
    return j.select("answer_id", "fact_id", status_of(F.col("_s"), F.col("_r"), F.col("_o"), thresholds).alias("status"))


def triple_rollup(status: DataFrame, claims: DataFrame) -> DataFrame:
    """CONSISTENT if any candidate is, else CONFLICT if any, else MISSING; a
    triple without candidates is MISSING (T5)."""
    rk = F.when(F.col("status") == "CONSISTENT", 1).when(F.col("status") == "CONFLICT", 2).otherwise(3)
    best = status.groupBy("answer_id").agg(F.min(rk).alias("_m"))
    name = (F.when(F.col("_m") == 1, F.lit("CONSISTENT")).when(F.col("_m") == 2, F.lit("CONFLICT"))
             .otherwise(F.lit("MISSING")))
    return claims.select("answer_id").join(best, "answer_id", "left").select("answer_id", name.alias("status"))


def answer_consistency(answers: DataFrame, per_triple: DataFrame) -> DataFrame:
    """E5: CONFLICT if any triple conflicts; else MISSING if any is missing; else
    EMPTYINPUT for empty text; else NOTRIPLETS when no triple; else CONSISTENT."""
    agg = per_triple.groupBy("answer_id").agg(
        F.bool_or(F.col("status") == "CONFLICT").alias("_c"),
        F.bool_or(F.col("status") == "MISSING").alias("_m"),
        F.count(F.lit(1)).alias("_n"))
    j = answers.join(agg, "answer_id", "left")
    out = (F.when(F.coalesce("_c", F.lit(False)), F.lit("CONFLICT"))
            .when(F.coalesce("_m", F.lit(False)), F.lit("MISSING"))
            .when(F.length("answer_text") == 0, F.lit("EMPTYINPUT"))
            .when(F.coalesce("_n", F.lit(0)) == 0, F.lit("NOTRIPLETS"))
            .otherwise(F.lit("CONSISTENT")))
    return j.select("answer_id", out.alias("consistency"))
