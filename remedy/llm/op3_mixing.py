"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and S words wants every document T/S times on average: each takes
the whole part, and the fraction becomes an inclusion probability. The cube method then
rounds the fractions. While three documents are undecided, the probabilities move along
the null space of the two balancing constraints (document total, word total) until one
reaches 0 or 1; the direction is random with the weights that keep every expectation.
At most two undecided documents remain per group. Groups are buckets of about GROUP_ROWS
documents of one source, as many as its own documents need (a large source has many, so
none is hot). One bucket of a source waits for what the others leave undecided, and only
there does the source land: there the longest documents are decided first, each against
ALONG shorter ones together, and the last two land with their probabilities. So every
document keeps its inclusion probability, also in a small source, and a source misses its
target by no more than a document that is left to the end, a short one.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the
words of all; a target stops at 3 times its source's words, the excess is reshared by
weight until none is above.

Defined cases: null or empty text has size 0 and takes 0; rows equal in source, id and
size are one unit whose copies share its draws as evenly as possible; null ids and null
sources are ordinary values; an empty table gives an empty mix. Draws are seeded by
source, pass and bucket, buckets by a hash of id and size, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.llm.common import WORD, written
from remedy.operators.corpus import global_rank
from remedy.sources.tables import table

CAP = 3.0
GROUP_ROWS = 5_000
ALONG = 256
FAR = 4
EPS = 1e-9
_COLS = "_mx_s string, _mx_b long, _mx_g long, _mx_i long, _mx_n long, _mx_base long, _mx_x double, _mx_z long"


def n_words(text: Column) -> Column:
    """Words of the mixing contract; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> adds target. Each round is one aggregation over sources."""
    ranked = global_rank(per_source.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_r")
    s = written(ranked.withColumn("w", (F.col("_r") % 3 + 1).cast("double")).withColumn(
        "limit", F.col("source_size") * F.lit(cap)).drop("_r", "_null"), "sources")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        # sources at their limit under the current rate give their excess to the others
        free = (F.col("limit") > F.col("w") * F.lit(rate)) & (F.col("limit") > 0)
        r = s.agg(F.sum(F.when(free, F.col("w"))).alias("w"),
                  F.sum(F.when(~free, F.col("limit")).otherwise(0.0)).alias("used")).first()
        if not r["w"]:
            break
        new = (total - r["used"]) / r["w"]
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return s.withColumn("target", F.least(F.col("limit"), F.col("w") * F.lit(rate))).drop("w", "limit")


def flight(x: list[float], size: list[float], rng: np.random.Generator) -> tuple[list[float], list[int]]:
    """Cube flight over (count, size) constraints; returns probabilities and the indexes,
    at most two, still strictly between 0 and 1."""
    act: list[int] = []
    u = rng.random(len(x)).tolist()
    for i in range(len(x)):
        if x[i] < EPS or x[i] > 1 - EPS:
            x[i] = round(x[i])
            continue
        act.append(i)
        if len(act) < 3:
            continue
        a, b, c = act
        d = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if d == (0, 0, 0):
            d = (1.0, -1.0, 0.0)
        up = min((1 - x[k]) / v if v > 0 else x[k] / -v for k, v in zip(act, d) if v)
        down = min(x[k] / v if v > 0 else (1 - x[k]) / -v for k, v in zip(act, d) if v)
        t = up if u[i] * (up + down) < down else -down
        for k, v in zip(act, d):
            x[k] = min(1.0, max(0.0, x[k] + t * v))
            if x[k] < EPS or x[k] > 1 - EPS:
                x[k] = float(round(x[k]))
        act = [k for k in act if 0.0 < x[k] < 1.0]
    return x, act


def _moved(x: np.ndarray, d: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random step along ``d``, up or down until a probability is 0 or 1, with the weights
    that keep every expectation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(d > 0, (1 - x) / d, np.where(d < 0, x / -d, np.inf)).min()
        down = np.where(d > 0, x / d, np.where(d < 0, (1 - x) / -d, np.inf)).min()
    x = np.clip(x + (up if rng.random() * (up + down) < down else -down) * d, 0.0, 1.0)
    return np.where((x < EPS) | (x > 1 - EPS), np.round(x), x)


def settle_longest(x: list[float], size: list[float], rng: np.random.Generator, along: int = ALONG) -> list[float]:
    """Documents by falling size are decided one by one, the longest first, against the next
    ``along`` undecided ones together: those move a little each, in proportion to the room
    they have, so that both totals stay. One that is FAR times as long as any other can only
    be made up for in words, by all others; there the document total gives way. The (at most
    two) left at the end are short."""
    v, z = np.array(x), np.array(size)
    v = np.where((v < EPS) | (v > 1 - EPS), np.round(v), v)
    for a in range(len(v)):
        while 0.0 < v[a] < 1.0:
            o = np.flatnonzero((v[a + 1:] > 0) & (v[a + 1:] < 1)) + a + 1
            if len(o) < 2:
                return v.tolist()
            far = z[a] > FAR * z[o[0]]
            o = o if far else o[:along]
            room = np.minimum(v[o], 1 - v[o])
            s0, s1, s2 = room.sum(), (room * z[o]).sum(), (room * z[o] ** 2).sum()
            det = s0 * s2 - s1 * s1
            if far:
                d = -room * z[a] / s1
            elif det > 1e-9 * s0 * s2:
                d = room * ((z[a] * s1 - s2) + (s1 - z[a] * s0) * z[o]) / det
            else:  # all of one size: its words stand for both totals
                d = -room * z[o] * z[a] / s2
            at = np.concatenate([[a], o])
            v[at] = _moved(v[at], np.concatenate([[1.0], d]), rng)
    return v.tolist()


def land(x: list[float], size: list[float], act: list[int], rng: np.random.Generator) -> list[float]:
    """Landing of the last (at most two) documents: the document total is given up first, so
    two move on along the word total until one is decided; the last is drawn with its
    probability. Every expectation stays."""
    v = np.array(x)
    if len(act) == 2:
        d = np.zeros(len(v))
        d[act[0]], d[act[1]] = size[act[1]], -size[act[0]]
        v = _moved(v, d, rng) if d.any() else v
    for k in act:
        if 0.0 < v[k] < 1.0:
            v[k] = float(rng.random() < v[k])
    return v.tolist()


def _sorted(key: tuple, pdf: pd.DataFrame, step: int) -> tuple[pd.DataFrame, list[float], list[float], np.random.Generator]:
    # large documents first: they are the hardest to place, and the small ones absorb them
    pdf = pdf.sort_values(["_mx_z", "_mx_i", "_mx_n"], ascending=[False, True, True], na_position="last")
    source = None if pd.isna(key[0]) else key[0]
    name = f"{source!r}|{int(key[1])}" + (f"|{step}" if step else "")
    seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
    size = pdf["_mx_z"].astype("float64").tolist()
    return pdf, pdf["_mx_x"].tolist(), size, np.random.default_rng(seed)


def _fly_group(step: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One pass over a bucket; bucket 0 waits for the landing."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == 0:
            return pdf
        pdf, x, size, rng = _sorted(key, pdf, step)
        return pdf.assign(_mx_x=flight(x, size, rng)[0])
    return run


def _land_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, x, size, rng = _sorted(key, pdf, 0)
    x = settle_longest(x, size, rng)
    act = [k for k, v in enumerate(x) if 0.0 < v < 1.0]
    return pdf.assign(_mx_x=land(x, size, act, rng))


def cube_counts(units: DataFrame, most: int) -> DataFrame:
    """Units (_mx_* columns, fractions in _mx_x, buckets of their source in _mx_b, at most
    ``most``) with every fraction rounded to 0 or 1.

    A pass flies all buckets but the first of each source; the at most two documents a
    bucket leaves undecided are dealt again, to as few buckets as hold them, until one is
    left a source. It lands with the buckets that waited."""
    cols = [c.split()[0] for c in _COLS.split(", ")]
    done, last, step = [], [], 0
    while most > 1:
        step += 1
        flown = written(units.withColumn("_mx_g", F.pmod(
            F.xxhash64("_mx_i", "_mx_z", "_mx_n", F.lit(step)), F.col("_mx_b"))).select(*cols).groupBy(
            "_mx_s", "_mx_g").applyInPandas(_fly_group(step), _COLS), "mix-flown")
        waits, decided = F.col("_mx_g") == 0, F.col("_mx_x").isin(0.0, 1.0)
        done.append(flown.filter(~waits & decided))
        last.append(flown.filter(waits))
        units = flown.filter(~waits & ~decided).withColumn(
            "_mx_b", F.ceil(F.col("_mx_b") * 2 / GROUP_ROWS).cast("long")).drop("_mx_g")
        most = math.ceil(most * 2 / GROUP_ROWS)
    last.append(units.withColumn("_mx_g", F.lit(0).cast("long")).select(*cols))
    landed = reduce(DataFrame.unionByName, last).groupBy("_mx_s", "_mx_g").applyInPandas(_land_group, _COLS)
    return reduce(DataFrame.unionByName, done, landed)


def mix_counts(rows: DataFrame) -> DataFrame:
    """(doc_id long, source, size) -> one row per distinct unit with n (its copies),
    total (draws of all copies), source_size and target."""
    rows = written(rows.select("doc_id", "source", "size"), "mix-sizes")
    units = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    per_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.ceil(F.count("*") / GROUP_ROWS).cast("long").alias("_mx_b"))
    targets = written(source_targets(per_source), "targets")
    most = targets.agg(F.max("_mx_b")).first()[0] or 1
    # one row per source; the planner broadcasts it when small, else AQE splits the hot source
    t = targets.withColumnRenamed("source", "_src")
    want = units.join(t, units["source"].eqNullSafe(t["_src"])).drop("_src").withColumn(
        "want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(0.0))
    base = F.floor(F.col("want") + EPS)
    cubed = cube_counts(want.select(
        F.col("source").alias("_mx_s"), "_mx_b", F.col("doc_id").alias("_mx_i"), F.col("n").alias("_mx_n"),
        base.cast("long").alias("_mx_base"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("want") - base)).otherwise(0.0).alias("_mx_x"),
        F.col("size").alias("_mx_z")), most)
    return cubed.drop("_mx_b").join(t, F.col("_mx_s").eqNullSafe(F.col("_src"))).select(
        F.col("_mx_i").alias("doc_id"), F.col("_mx_s").alias("source"), F.col("_mx_z").alias("size"),
        F.col("_mx_n").alias("n"), (F.col("_mx_base") + F.col("_mx_x").cast("long")).alias("total"),
        "source_size", "target")


def mix_report(rows: DataFrame) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words)."""
    c = F.floor(F.col("total") / F.col("n")) + F.when(F.col("_i") < F.col("total") % F.col("n"), 1).otherwise(0)
    return mix_counts(rows).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * c).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it was drawn (0 to 3 times).

    Documents meet their draws on the nearly unique (id, size, source)."""
    keyed = docs.withColumn("_mk_z", n_words(F.col(text)))
    counts = mix_counts(keyed.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col("_mk_z").alias("size"))).select(
        F.col("doc_id").alias("_mk_i"), F.col("source").alias("_mk_s"), F.col("size").alias("_mk_size"),
        F.col("n").alias("_mk_n"), F.col("total").alias("_mk_t")).filter("_mk_t > 0")
    j = keyed.join(counts, keyed[doc_id].eqNullSafe(F.col("_mk_i")) & keyed[source].eqNullSafe(F.col("_mk_s"))
                   & (F.col("_mk_z") == F.col("_mk_size")))
    single = j.filter("_mk_n = 1").withColumn("_mk_c", F.col("_mk_t"))
    w = W.partitionBy(doc_id, source, "_mk_z").orderBy(F.xxhash64(text))
    copies = j.filter("_mk_n > 1").withColumn("_mk_r", F.row_number().over(w) - 1).withColumn(
        "_mk_c", F.floor(F.col("_mk_t") / F.col("_mk_n")).cast("long")
        + F.when(F.col("_mk_r") < F.col("_mk_t") % F.col("_mk_n"), 1).otherwise(0)).drop("_mk_r")
    both = single.unionByName(copies).filter("_mk_c > 0")
    return both.withColumn("_mk_e", F.explode(F.array_repeat(F.lit(0), F.col("_mk_c").cast("int")))).select(
        *[docs[c] for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_report(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


QUERIES = {"op3_mixing": op3_mixing}
