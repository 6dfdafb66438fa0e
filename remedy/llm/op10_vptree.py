"""Approximate nearest neighbours by vantage-point trees, one per shard.

Nearness is the inner product. Within a shard vectors are lifted by one coordinate,
sqrt(M^2 - |x|^2) with M the shard's largest norm, so that the Euclidean order from a
query (lifted by 0) is the inner-product order and the triangle inequality holds. A node
holds a vantage point and splits its points at the median distance to it; the range of
distances on either side bounds how near a query can come. A side is skipped when that
bound exceeds ``factor`` times the query's k-th distance so far: factor 1 is exact, less
prunes more. Leaves are scored by matrix products.

Equal vectors are one tree point with their k + 1 smallest ids, so a vector shared by a
third of the rows costs one point and loses no answer. Every shard is searched for every
block of queries; each returns a query's best few, merged by rank.

Defined cases: vectors that are null, empty, zero, of another than the commonest dimension
or hold a null or non-finite component take no part, nor do rows without an id; ties go to
the smaller id; rows that repeat the query's id are not its neighbours; fewer candidates
than k give fewer rows; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.llm.common import written
from remedy.sources.tables import table

K = 20
FACTOR = 0.8
SHARD_ROWS = 20_000
QUERY_BLOCK = 20_000
LEAF = 256
SPARE = 6  # points kept beyond k while scores come from matrix products
SLACK = 1e-9


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(fine)
    dims = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.filter(F.size("v") == (dims["d"] if dims else 0))


class Tree:
    """Vantage-point tree over the rows of ``x``; points[i] is the original row."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        norm2 = np.einsum("ij,ij->i", x, x)
        self.top = float(norm2.max())
        lifted = np.hstack([x, np.sqrt(np.maximum(self.top - norm2, 0))[:, None]])
        self.points = np.arange(len(x))
        self.nodes: list[tuple] = []  # (start, end) or (vantage row, split, hi_in, lo_out, hi_out, in, out)
        self._build(lifted, 0, len(x), leaf, np.random.default_rng(0))
        self.x = x[self.points]
        self.place = np.empty(len(x), dtype=np.int64)
        self.place[self.points] = np.arange(len(x))

    def _build(self, z: np.ndarray, start: int, end: int, leaf: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end))
        own = self.points[start:end]
        if end - start <= leaf:
            return at
        vantage = int(own[rng.integers(len(own))])
        d = np.sqrt(np.maximum(((z[own] - z[vantage]) ** 2).sum(axis=1), 0))
        order = np.argsort(d, kind="stable")
        self.points[start:end], d, half = own[order], d[order], (end - start) // 2
        left = self._build(z, start, start + half, leaf, rng)
        right = self._build(z, start + half, end, leaf, rng)
        self.nodes[at] = (vantage, float(d[half]), float(d[half - 1]), float(d[half]), float(d[-1]), left, right)
        return at

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best found for each row of q, best first; -inf where none."""
        base = np.einsum("ij,ij->i", q, q) + self.top
        best = np.full((len(q), k), -np.inf)
        rows = np.full((len(q), k), -1, dtype=np.int64)

        def reach(act: np.ndarray) -> np.ndarray:
            worst = best[act, k - 1]
            return np.where(np.isinf(worst), np.inf, factor * np.sqrt(np.maximum(base[act] - 2 * worst, 0)) + SLACK)

        def visit(at: int, act: np.ndarray) -> None:
            if not len(act):
                return
            node = self.nodes[at]
            if len(node) == 2:
                s = q[act] @ self.x[node[0]:node[1]].T
                some = s.max(axis=1) > best[act, k - 1]
                act, s = act[some], s[some]
                if len(act):
                    both = np.hstack([best[act], s])
                    ids = np.hstack([rows[act], np.broadcast_to(np.arange(node[0], node[1]), s.shape)])
                    top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                    best[act] = np.take_along_axis(both, top, axis=1)
                    rows[act] = np.take_along_axis(ids, top, axis=1)
                return
            vantage, split, hi_in, lo_out, hi_out, left, right = node
            d = np.sqrt(np.maximum(base[act] - 2 * (q[act] @ self.x[self.place[vantage]]), 0))
            near_in, near_out = d - hi_in, np.maximum(lo_out - d, d - hi_out)
            inner = d <= split
            for first, second, mine, far1, far2 in ((left, right, inner, near_in, near_out), (right, left, ~inner, near_out, near_in)):
                g, f1, f2 = act[mine], far1[mine], far2[mine]
                visit(first, g[f1 <= reach(g)])
                visit(second, g[f2 <= reach(g)])

        visit(0, np.arange(len(q)))
        return best, np.where(rows >= 0, self.points[rows], -1)


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(shard, ids, tree): every usable row is indexed; one pickled tree per shard."""
    r = usable(rows, vec_id, vector)
    w = W.partitionBy("v").orderBy("vec_id")
    # Spark keeps only the first k + 1 of a group in each task before the shuffle
    first = r.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    points = written(first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    shards = max(1, math.ceil(points.count() / SHARD_ROWS))

    def plant(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        ids = [np.array(x, dtype=np.int64) for x in t.column("ids").to_pylist()]
        x = np.array(t.column("v").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        return pa.table({"shard": t.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps((ids, Tree(x)))], pa.binary())})

    keyed = points.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(shards)))
    return written(keyed.groupBy("shard").applyInArrow(plant, "shard long, tree binary"), "trees")


def search(index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest, its own id left out."""
    q = written(usable(queries, vec_id, vector).distinct(), "queries")
    blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))
    packed = q.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))

    def find(key: tuple, t: pa.Table, trees: pa.Table) -> pa.Table:
        out = {"query_id": [], "qh": [], "vec_id": [], "score": []}
        ids = t.column("vec_id").to_numpy()
        qh = t.column("qh").to_numpy()
        x = np.array(t.column("v").combine_chunks().flatten().to_numpy()).reshape(max(1, len(ids)), -1)[:len(ids)]
        for blob in trees.column("tree") if len(ids) else ():
            members, tree = pickle.loads(blob.as_py())
            if tree.x.shape[1] != x.shape[1]:
                continue
            _, rows = tree.search(x, k + 1 + SPARE, factor)
            at, col = np.nonzero(rows >= 0)
            hit = rows[at, col]
            # the measure itself, summed alike for every pair
            score = np.einsum("ij,ij->i", x[at], tree.x[tree.place[hit]])
            n = np.array([len(members[p]) for p in hit], dtype=np.int64)
            out["vec_id"].append(np.concatenate([members[p] for p in hit]) if len(hit) else np.zeros(0, np.int64))
            for name, values in (("query_id", ids[at]), ("qh", qh[at]), ("score", score)):
                out[name].append(np.repeat(values, n))
        types = {"query_id": np.int64, "qh": np.int64, "vec_id": np.int64, "score": np.float64}
        cols = {c: np.concatenate([np.zeros(0, types[c]), *v]) for c, v in out.items()}
        own = cols["vec_id"] == cols["query_id"]
        # a shard passes on a query's k best, so the merge reads k rows a query and shard
        cols = {c: v[~own] for c, v in cols.items()}
        order = np.lexsort((cols["vec_id"], -cols["score"], cols["qh"], cols["query_id"]))
        cols = {c: v[order] for c, v in cols.items()}
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(cols["query_id"]) != 0) | (np.diff(cols["qh"]) != 0)
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        keep = np.arange(len(order)) - first < k
        return pa.table({c: v[keep] for c, v in cols.items()})

    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    shards = index.agg(F.max("shard")).first()[0] or 0
    asked = packed.withColumn("qh", F.xxhash64("v")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long"))))
    got = asked.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(
        find, "query_id long, qh long, vec_id long, score double")
    w = W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(rows), rows.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op10_vptree": op10_vptree}
