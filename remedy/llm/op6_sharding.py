"""Sharding by extendible hashing.

A directory is indexed by leading bits of a 60-bit key hash. It starts as one bucket; only
a bucket above the byte limit splits on its next bit, until each fits. A bucket holding a
single hash value cannot split and stays, however large (``oversized``).

Defined cases: a null key hashes as the text ``null``; null or empty text has 0 bytes;
repeated rows share a shard and all stay; an empty table gives no shards; other columns
pass through ``shard`` untouched (helper columns carry a ``_xh_`` prefix).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.llm.common import written
from remedy.sources.tables import table

BITS = 60
SHARD_BYTES = 64 * 1024 * 1024
# Bits looked at beyond log2(total / limit) in one aggregation; deeper buckets take another.
LOOKAHEAD = 4
# The directory is broadcast up to this many leaves (about 10 MB); beyond it is joined.
BROADCAST_LEAVES = 100_000


def key_hash(key: Column) -> Column:
    """First 60 bits of the md5 of the key as text."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaf buckets (depth, prefix, shard_bytes, shard_docs, oversized) of ``sizes``
    (_xh_h long, _xh_b long). Each round sums the still oversized buckets over a few more
    bits; the row count of a round is bounded by total bytes / limit, not by documents."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("_xh_b")).first()[0] or 0
    step = max(1, math.ceil(math.log2(max(total / limit, 1)))) + LOOKAHEAD
    top, leaves, pending = 0, [], None
    while True:
        low = min(BITS, top + step)
        rows = sizes
        if pending is not None:
            rows = sizes.withColumn("prefix", _prefix(F.col("_xh_h"), F.lit(top))).join(
                pending, "prefix", "left_semi")
        fine = rows.groupBy(_prefix(F.col("_xh_h"), F.lit(low)).alias("fine")).agg(
            F.sum("_xh_b").alias("b"), F.count("*").alias("n"),
            F.min("_xh_h").alias("lo"), F.max("_xh_h").alias("hi"))
        every = fine.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(low)))).withColumn(
            "prefix", F.expr(f"shiftright(fine, {low} - depth)"))
        nodes = written(every.groupBy("depth", "prefix").agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).withColumn("done", (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))), "directory")
        open_parents = nodes.filter(~F.col("done")).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        closed = nodes.filter("done").withColumn("parent", F.expr("shiftright(prefix, 1)"))
        first = closed.filter(F.col("depth") == top)
        if top:  # the root of a later round was open by construction
            first = first.limit(0)
        leaves.append(closed.join(open_parents, ["depth", "parent"], "left_semi").unionByName(first))
        pending = nodes.filter(~F.col("done") & (F.col("depth") == low)).select("prefix")
        if pending.isEmpty():
            break
        top = low
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return written(out.select(
        F.col("depth").cast("int").alias("depth"), "prefix", "shard_bytes", "shard_docs",
        (F.col("shard_bytes") > limit).alias("oversized")), "leaves").select("*")


def shard(df: DataFrame, key: str, text: str, limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with n_bytes, shard_id, depth, shard_bytes, shard_docs and oversized added.

    A row meets its leaf by an equality on (depth, prefix), tried at each depth that has
    leaves (at most 61); no bucket is collected."""
    sized = df.withColumn("_xh_h", key_hash(F.col(key))).withColumn(
        "n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
    sizes = written(sized.select("_xh_h", F.col("n_bytes").alias("_xh_b")), "sizes")
    leaves = directory(sizes, limit)
    depths = [r[0] for r in leaves.select("depth").distinct().collect()] or [0]
    tagged = leaves.select(
        F.col("depth").alias("_xh_d"), F.col("prefix").alias("_xh_p"), "depth",
        F.concat(F.lit("d"), F.col("depth"), F.lit("_"), F.col("prefix")).alias("shard_id"),
        "shard_bytes", "shard_docs", "oversized")

    def located(rows: DataFrame, leaves_side: DataFrame) -> DataFrame:
        probe = rows.withColumn("_xh_d", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))).withColumn(
            "_xh_p", F.expr(f"shiftright(_xh_h, {BITS} - _xh_d)"))
        return probe.join(leaves_side, ["_xh_d", "_xh_p"]).drop("_xh_d", "_xh_p")

    if leaves.count() <= BROADCAST_LEAVES:
        return located(sized, F.broadcast(tagged)).drop("_xh_h")
    # beyond the bound whole rows are not multiplied: hashes are located first
    return sized.join(located(sizes.select("_xh_h").distinct(), tagged), "_xh_h").drop("_xh_h")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each written by one task (its bytes are bounded by the limit)."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, "doc_id", "text").drop("text")


def sharding_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB: the same leaves by summing every prefix at every depth."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT k::INTEGER AS depth, h >> ({BITS} - k) AS prefix, sum(n_bytes)::BIGINT AS b, count(*) AS n,
        (sum(n_bytes) <= {limit} OR min(h) = max(h)) AS done
      FROM d, range(0, {BITS + 1}) r(k) GROUP BY 1, 2),
leaf AS (SELECT t.* FROM t LEFT JOIN t q ON q.depth = t.depth - 1 AND q.prefix = t.prefix >> 1
         WHERE t.done AND (q.depth IS NULL OR NOT q.done))
SELECT d.doc_id, d.n_bytes, leaf.depth, 'd' || leaf.depth || '_' || leaf.prefix AS shard_id,
  leaf.b AS shard_bytes, leaf.n AS shard_docs, leaf.b > {limit} AS oversized
FROM d JOIN leaf ON d.h >> ({BITS} - leaf.depth) = leaf.prefix"""


QUERIES = {"op6_sharding": op6_sharding}
ORACLE = {"op6_sharding": sharding_sql()}
