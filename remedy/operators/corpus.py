"""Corpus preparation: claim evidence, inverse evidence map, evidence page filter and
sentence lookup, positional splits, corpus cap / refresh, counts, seeded order and
sampling with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.functions import text as T
from remedy.operators.metrics import md5_uniform


def explode_evidence(claims: DataFrame, id_col: str = "id", all_tuples: bool = False) -> DataFrame:
    """One row per evidence set (first tuple only, T17), null page dropped;
    the sentence index is cast to INT. ``all_tuples`` keeps every tuple."""
    sets = claims.select(F.col(id_col).alias("claim_id"), F.posexplode("evidence").alias("set_idx", "es"))
    if all_tuples:
        t = sets.select("claim_id", "set_idx", F.explode("es").alias("tp"))
    else:
        t = sets.select("claim_id", "set_idx", F.get(F.col("es"), 0).alias("tp"))
    return (t.select("claim_id", "set_idx", F.get(F.col("tp"), 2).alias("page"),
                     F.get(F.col("tp"), 3).try_cast("int").alias("sent_idx"))
             .filter(F.col("page").isNotNull()))


def inverse_evidence(evidence: DataFrame) -> DataFrame:
    """Page -> claim ids with duplicates kept, in relational form
    (page, claim_id, n_refs): no page's list is ever gathered into one row."""
    return evidence.groupBy("page", "claim_id").agg(F.count(F.lit(1)).alias("n_refs"))


def evidence_pages(pages: DataFrame, evidence: DataFrame, page_col: str = "page_id") -> DataFrame:
    """Pages cited by any claim (left semi join; duplicates of a page kept).
    The cited-page set is broadcast after a size check, so pages are not shuffled."""
    from remedy.session import bounded_broadcast

    ev = evidence.select(F.col("page").alias(page_col)).distinct()
    return pages.join(bounded_broadcast(ev), page_col, "left_semi")


def page_sentences(pages: DataFrame, page_col: str = "page_id", lines_col: str = "lines") -> DataFrame:
    """B4 exploded: (page, sent_idx, sentence) with element 0 dropped."""
    return pages.select(F.col(page_col).alias("page"),
                        F.posexplode(T.split_sentences(lines_col)).alias("sent_idx", "sentence"))


def latest_pages(pages: DataFrame, page_col: str, ordinal_col: str) -> DataFrame:
    """Of rows that repeat a page id the one with the greatest source ordinal. Only
    (id, ordinal) is grouped; the rows then meet the winners on both."""
    last = pages.groupBy(page_col).agg(F.max(ordinal_col).alias(ordinal_col))
    return pages.join(last, [page_col, ordinal_col], "left_semi").dropDuplicates([page_col])


def evidence_sentences(evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """(claim, distinct tidy evidence sentence) by an equi join on (page, index)."""
    j = evidence.join(sentences, ["page", "sent_idx"])
    return j.select("claim_id", F.translate("sentence", "\t", " ").alias("sentence")).distinct()


def evidence_missing(evidence: DataFrame, sentences: DataFrame) -> DataFrame:
    """D2 audit: evidence whose page or sentence index does not exist (left anti)."""
    return evidence.join(sentences.select("page", "sent_idx"), ["page", "sent_idx"], "left_anti")


def _sorted_once(df: DataFrame, order_cols: list) -> DataFrame:
    """Rows range-partitioned and sorted by ``order_cols``, each with _pid and _row, its place
    in its partition. Kept by a reliable checkpoint: whatever reads it sees one and the same
    partitioning, while range bounds sampled anew would give other rows to a partition."""
    from remedy.session import cut_lineage

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id holds the partition in its upper 31 bits and the row number below
    s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn(
        "_mid", F.monotonically_increasing_id())
    return cut_lineage(s).withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")


def global_rank(df: DataFrame, order_cols: list, out: str = "rank") -> DataFrame:
    """0-based position in a total order, without a single-partition window: the place in the
    range partition plus the rows of the partitions before (one row per partition)."""
    s = _sorted_once(df, order_cols)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_pid", (F.sum("_c").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))).alias("_o"))
    return (s.join(F.broadcast(offs), "_pid")  # one row per partition
             .withColumn(out, F.coalesce("_o", F.lit(0)) + F.col("_row"))
             .drop("_pid", "_row", "_o"))


def rank_in_group(df: DataFrame, group: str, order_cols: list, out: str = "rank") -> DataFrame:
    """0-based position within ``group``, also for a group of any size: groups are numbered
    piece by piece where range partitions cut them, and a piece starts behind the pieces of
    its group in the partitions before it. At most one group runs on into a partition, so
    the table of starts has no more rows than there are partitions."""
    s = _sorted_once(df, [group, *order_cols])
    pieces = s.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_m"))
    before = F.sum("_c").over(W.partitionBy(group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
    starts = pieces.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), before.alias("_o")).filter("_o > 0")
    first = pieces.select(F.col(group).alias("_g1"), F.col("_pid").alias("_p1"), "_m")
    x = s.join(first, F.col(group).eqNullSafe(F.col("_g1")) & (F.col("_pid") == F.col("_p1")))
    x = x.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")), "left")
    return (x.withColumn(out, F.col("_row") - F.col("_m") + F.coalesce("_o", F.lit(0)))
             .drop("_pid", "_row", "_m", "_o", "_g", "_p", "_g1", "_p1"))


def split_range(df: DataFrame, order_col: str, train: int = 1000, validation: int = 1000) -> DataFrame:
    """A5: positional split: rows 0..train-1 train, next ``validation`` rows validation.
    Positions come from range partitions and their row counts, so no task merges the
    candidates of all partitions."""
    x = global_rank(df, [order_col], "_rn").filter(F.col("_rn") < train + validation)
    return x.withColumn("split", F.when(F.col("_rn") < train, F.lit("train")).otherwise(F.lit("validation"))).drop("_rn")


def corpus_cap(df: DataFrame, order_col: str, n: int = 100_000) -> DataFrame:
    """The first n rows by ``order_col`` (unique). Only the order column is ranked; the
    rows then meet the kept keys."""
    keys = global_rank(df.select(order_col), [order_col], "_rn").filter(F.col("_rn") < n).select(order_col)
    return df.join(keys, order_col, "left_semi")


def refresh_sample(secondary: DataFrame, id_col: str, version: int, n: int = 100, seed: int = 42) -> DataFrame:
    """C5 sample: n rows of the secondary corpus ordered by md5(seed, version, id)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(version)), F.col(id_col).cast("string")))
    return secondary.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


def refresh_draws(secondary: DataFrame, id_col: str, versions: int = 3, n: int = 100, p: float = 0.5,
                  seed: int = 42) -> DataFrame:
    """C5 draws: (draw, id): version u draws, with probability p (from md5(seed, u)), a
    deterministic n-row sample of the secondary corpus."""
    out = None
    for v in range(1, versions + 1):
        drawn = refresh_sample(secondary, id_col, v, n, seed).filter(md5_uniform(F.lit(str(seed)), F.lit(str(v))) <= p)
        drawn = drawn.select(F.lit(v).alias("draw"), id_col)
        out = drawn if out is None else out.unionByName(drawn)
    return out


def corpus_refresh(primary: DataFrame, secondary: DataFrame, id_col: str, versions: int = 3,
                   n: int = 100, p: float = 0.5, seed: int = 42) -> DataFrame:
    """C5 re-aimed: each version extends the one before. Version v is the primary corpus and
    the samples of all versions up to v that were drawn. UNION ALL, no dedupe: a passage
    drawn twice is held twice."""
    every = lambda first: F.explode(F.sequence(first, F.lit(versions))).alias("kb_version")
    draws = refresh_draws(secondary, id_col, versions, n, p, seed)
    return (primary.select(every(F.lit(1)), F.lit("primary").alias("origin"), id_col)
            .unionByName(draws.select(every(F.col("draw")), F.lit("secondary").alias("origin"), id_col)))


def epoch_order(df: DataFrame, id_col: str, epochs: int = 2, seed: int = 42) -> DataFrame:
    """Seeded shuffle per epoch: position by md5(seed, epoch, id)."""
    spark = df.sparkSession
    ep = F.broadcast(spark.range(1, epochs + 1).select(F.col("id").alias("epoch")))  # fixed small
    x = df.select(id_col).crossJoin(ep).withColumn(
        "_k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(id_col).cast("string"))))
    r = global_rank(x, ["epoch", "_k", id_col], "_g")
    first = r.groupBy("epoch").agg(F.min("_g").alias("_m"))
    return r.join(F.broadcast(first), "epoch").select(
        "epoch", id_col, (F.col("_g") - F.col("_m")).alias("step"))


def sample_with_replacement(df: DataFrame, order_col: str, k: int = 200, seed: int = 42) -> DataFrame:
    """Exactly k draws with replacement: draw j picks the row at position
    floor(u(seed, j) * N) of the ordered dataset (an equi join on the position)."""
    spark = df.sparkSession
    ranked = global_rank(df, [order_col], "_pos")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    draws = (spark.range(k).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n))
             .withColumn("_pos", F.floor(md5_uniform(F.lit(str(seed)), F.col("draw")) * F.col("_n")).cast("long"))
             .drop("_n"))
    return draws.join(ranked, "_pos").drop("_pos")
