"""Evaluation: context precision/recall, EM, value counts, group means, bootstrap CIs,
before/after deltas and action frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from remedy.functions.num import rnd

from remedy.functions import text as T


def chunk_hits(ranked: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Per (q_id, rank): does the chunk contain any gold passage of its query (D6
    inside a query's own small lists: gold x k rows per query)."""
    r = ranked.select("q_id", "rank", "doc_id", "pos").join(chunks, ["doc_id", "pos"])
    x = r.join(gold.select("q_id", "gold"), "q_id", "left")
    return (x.groupBy("q_id", "rank")
             .agg(F.coalesce(F.bool_or(F.contains("text", "gold")), F.lit(False)).alias("hit")))


def precision_at_k(hits: DataFrame, ks=(1, 2, 3, 4, 5)) -> DataFrame:
    """Share of the first k chunks containing a gold passage; the divisor is
    the number of chunks actually available among the first k (T8)."""
    kk = hits.sparkSession.range(1, max(ks) + 1).select(F.col("id").cast("int").alias("k")) \
        .filter(F.col("k").isin(*ks))
    x = hits.join(F.broadcast(kk), F.col("rank") <= F.col("k"))
    return (x.groupBy("q_id", "k")
             .agg((F.sum(F.col("hit").cast("double")) / F.count(F.lit(1))).alias("precision")))


def context_precision(hits: DataFrame, has_gold: DataFrame, K: int = 5) -> DataFrame:
    """Mean over k = 1..K of precision@k; lists shorter than K repeat their last
    value; null when the gold list or the context list is empty."""
    h = hits.filter(F.col("rank") <= K)
    w = W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("_p", F.sum(F.col("hit").cast("double")).over(w) / F.col("rank"))
    agg = h.groupBy("q_id").agg(
        F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_n"),
        F.max_by("_p", "rank").alias("_last"))
    cp = (F.col("_sum") + (F.lit(K) - F.col("_n")) * F.col("_last")) / F.lit(K)
    return (has_gold.select("q_id", "n_gold").join(agg, "q_id", "left")
            .select("q_id", F.when((F.col("n_gold") > 0) & (F.col("_n") > 0), cp).alias("context_precision")))


def context_recall(ranked: DataFrame, chunks: DataFrame, gold: DataFrame, has_gold: DataFrame) -> DataFrame:
    """Share of gold passages found in any retrieved chunk; null when either
    list is empty."""
    r = ranked.select("q_id", "doc_id", "pos").join(chunks, ["doc_id", "pos"])
    found = (gold.select("q_id", "gold").join(r, "q_id")
             .groupBy("q_id", "gold").agg(F.bool_or(F.contains("text", "gold")).alias("_f")))
    per_q = found.groupBy("q_id").agg(F.sum(F.col("_f").cast("double")).alias("_found"))
    n_ctx = ranked.groupBy("q_id").agg(F.count(F.lit(1)).alias("_nc"))
    return (has_gold.select("q_id", "n_gold").join(per_q, "q_id", "left").join(n_ctx, "q_id", "left")
            .select("q_id", F.when((F.col("n_gold") > 0) & (F.coalesce("_nc", F.lit(0)) > 0),
                                   F.coalesce("_found", F.lit(0.0)) / F.col("n_gold")).alias("context_recall")))


def value_counts_by(df: DataFrame, split_col: str, cols: list[str]) -> DataFrame:
    """Value counts of several columns split by a boolean, via one unpivot."""
    u = df.select(split_col, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [split_col], cols, "column", "value")
    return u.groupBy(split_col, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def rate_with_overall(df: DataFrame, group_col: str, flag_col: str, out: str) -> DataFrame:
    """Mean of a boolean per group plus the overall row (group = null)."""
    return (df.rollup(group_col).agg(F.avg(F.col(flag_col).cast("double")).alias(out),
                                     F.count(F.lit(1)).alias("n")))


# ---- bootstrap ----------------------------------------------------------------
# Poisson(1) cumulative probabilities P(X <= k), k = 0..7 (weights beyond 8 are
# folded into 8; P(X > 8) < 1.2e-6).
def _poisson_cdf(kmax: int = 8):
    import math
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


POISSON_CDF = _poisson_cdf()


def md5_uniform(*cols) -> F.Column:
    """Deterministic uniform in [0, 1) from md5 of the key (same in DuckDB)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: F.Column) -> F.Column:
    w = F.lit(len(POISSON_CDF))
    for k in reversed(range(len(POISSON_CDF))):
        w = F.when(u < F.lit(POISSON_CDF[k]), F.lit(k)).otherwise(w)
    return w


# The rational approximation of the normal distribution (Hart 1968, West 2005).
PHI_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376)
PHI_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: str) -> str:
    """SQL expression of the normal distribution at ``x`` (14 places within 7 of 0)."""
    def horner(c):
        out = f"{c[0]!r}D"
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v!r}D)"
        return out

    tail = f"(exp(-0.5D * {x} * {x}) * {horner(PHI_TOP)} / {horner(PHI_BOTTOM)})"
    return f"(CASE WHEN isnan({x}) THEN {x} WHEN abs({x}) > 7 THEN if({x} > 0, 1D, 0D) WHEN {x} > 0 THEN 1D - {tail} ELSE {tail} END)"


def bootstrap_metrics(df: DataFrame, group_col: str, metrics: list[str], row_id: str,
                      resamples: int = 10, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Poisson bootstrap of the mean of several columns, per group and overall
    (group null): (metric, group, n, mean, ci_low, ci_high), the interval bias-corrected and
    accelerated (BCa).

    Each row gets one Poisson(1) weight per resample from md5(seed, resample, row). One
    grouping sums the weights, the weighted columns of all resamples, and the first three
    powers; the overall row is the total of the groups. Per resample the weighted mean
    sum(w*x)/sum(w); ``mean`` is the mean of these. The bias correction is the normal quantile
    of the share of replicates below the observed mean (ties count half), one of 2 x resamples
    steps. The acceleration needs the third powers of the jackknife, which for a mean are the
    deviations from it: a = m3 / (6 m2^1.5 sqrt(n)). Bounds are percentiles, interpolated, of
    the replicates, rounded to 8 places. A group of one row gives (value, NaN, NaN); one whose
    values are all equal, or whose replicates all lie on one side of the mean, has NaN bounds."""
    from statistics import NormalDist

    # a weight is the number of Poisson cumulative probabilities not above the row's uniform
    cdf = "array(" + ", ".join(f"{c!r}D" for c in POISSON_CDF) + ")"
    uniform = f"conv(substring(md5(concat_ws('|', '{seed}', b, cast({row_id} as string))), 1, 8), 16, 10) / 4294967296D"
    w = F.expr(f"transform(transform(sequence(0, {resamples - 1}), b -> {uniform}), "
               f"u -> cast(size(filter({cdf}, c -> c <= u)) as double))")
    x = df.select(group_col, *[F.col(m).cast("double").alias(m) for m in metrics], w.alias("_w"))
    sums = [F.expr("count(1) AS n")]
    for m in metrics:
        sums += [F.expr(f"first({m}) AS _x_{m}"), F.expr(f"count({m}) AS _n_{m}"), F.expr(f"min({m}) AS _lo_{m}"), F.expr(f"max({m}) AS _hi_{m}")]
        sums += [F.expr(f"sum(power({m}, {p})) AS _p{p}_{m}") for p in (1, 2, 3)]
    for b in range(resamples):
        for m in metrics:  # rows where the metric is null have no weight for it
            sums += [F.expr(f"sum(_w[{b}] * {m}) AS _s_{b}_{m}"), F.expr(f"sum(if({m} is null, null, _w[{b}])) AS _w_{b}_{m}")]
    per = x.groupBy(group_col).agg(*sums)
    gtype = x.schema[group_col].dataType
    whole = {"_x": F.first, "_l": F.min, "_h": F.max}
    total = per.agg(*[whole.get(c[:2], F.sum)(c).alias(c) for c in per.columns[1:]])
    both = per.unionByName(total.withColumn(group_col, F.lit(None).cast(gtype)))
    ratio = lambda b, m: f"if(_w_{b}_{m} > 0, _s_{b}_{m} / _w_{b}_{m}, null)"
    rows = F.explode(F.array(*[F.expr(
        f"struct('{m}' AS metric, _x_{m} AS x1, _n_{m} AS c, _lo_{m} = _hi_{m} AS flat, try_divide(_p1_{m}, _n_{m}) AS e1, "
        f"try_divide(_p2_{m}, _n_{m}) AS e2, try_divide(_p3_{m}, _n_{m}) AS e3, array_sort(array_compact(array("
        + ", ".join(ratio(b, m) for b in range(resamples)) + "))) AS r)") for m in metrics]))
    t = both.select(group_col, "n", rows.alias("t")).select(group_col, "n", "t.*")
    k = F.size("r")
    t = t.withColumn("mean", F.when(k > 0, F.aggregate("r", F.lit(0.0), lambda s, v: s + v) / k))
    # twice the number of replicates below the observed mean, ties counted once, to 9 places
    below = "aggregate(r, 0, (s, v) -> s + int(round(v * 1e9D) < round(e1 * 1e9D)) + int(round(v * 1e9D) <= round(e1 * 1e9D)))"
    quantiles = {n: [NormalDist().inv_cdf(i / (2 * n)) for i in range(1, 2 * n)] for n in range(1, resamples + 1)}
    table = "CASE k " + " ".join(f"WHEN {n} THEN array({', '.join(f'{v!r}D' for v in q)})" for n, q in quantiles.items()) + " END"
    m2, m3 = "(e2 - e1 * e1)", "(e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1)"
    tail = NormalDist().inv_cdf((1 - level) / 2)
    # each step binds what the next one uses more than once: bias and acceleration, the shifted
    # quantiles, their probabilities, and the percentiles of the sorted replicates
    steps = f"transform(array({below}), b -> named_struct('b', b, 'k', size(r)))"
    steps = (f"transform({steps}, s -> transform(array(s.k), k -> named_struct('z0', if(n > 1 and not flat and s.b > 0 and s.b < 2 * k, "
             f"try_element_at({table}, s.b), double('NaN')), 'a', coalesce(try_divide({m3}, 6 * power(greatest({m2}, 0D), 1.5D) * sqrt(double(c))), double('NaN'))))[0])")
    steps = f"transform({steps}, s -> transform(array({tail!r}D, {-tail!r}D), q -> s.z0 + coalesce(try_divide(s.z0 + q, 1 - s.a * (s.z0 + q)), double('NaN'))))[0]"
    steps = f"transform(transform({steps}, z -> {normal_cdf('z')}), p -> if(isnan(p), p, p * (size(r) - 1)))"
    at = "transform(array(int(floor(p))), i -> r[i] + (r[least(i + 1, size(r) - 1)] - r[i]) * (p - i))[0]"
    t = t.withColumn("ci", F.expr(f"transform({steps}, p -> if(isnan(p), p, {at}))"))

    def bound(i: int) -> F.Column:
        return F.when(F.isnan(F.get("ci", i)), F.lit(float("nan"))).otherwise(rnd(F.get("ci", i), 8))

    return t.select("metric", group_col, "n", rnd(F.when(F.col("n") == 1, F.col("x1")).otherwise(F.col("mean")), 8).alias("mean"),
                    bound(0).alias("ci_low"), bound(1).alias("ci_high"))


def bootstrap_ci(df: DataFrame, group_col: str, value_col: str, row_id: str,
                 resamples: int = 10, seed: int = 42) -> DataFrame:
    """``bootstrap_metrics`` of one column."""
    return bootstrap_metrics(df, group_col, [value_col], row_id, resamples, seed).drop("metric")
