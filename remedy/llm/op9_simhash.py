"""SimHash near-duplicates by anchor-point covering.

A fingerprint bit is set when over half of the document's shingle hashes have it. To find
all fingerprints within ``k`` bits without comparing all, anchors are the words of a
covering code: the product of two binary Golay [23, 12] codes over bits 0-22 and 23-45.
That code is perfect, so every 23-bit half lies within radius 3 of exactly one codeword,
and a fingerprint has one home anchor. It is also replicated to every anchor within the
covering radius plus the threshold: e1 + e2 <= k, where e is a half's distance beyond 3.
If s and t differ in at most k bits, s is a replica at the home anchor of t, so comparing
replicas with the homes per anchor misses no pair. For k = 2 a fingerprint has about 61
replicas over 2^24 anchors; only distinct fingerprints take part. Linked fingerprints are
joined into components by least-label propagation with pointer jumping.

Defined cases: null, empty or blank text has fingerprint zero and links like any other;
under ``width`` words the whole sequence is one shingle; equal rows get equal results and
all stay; a component_id is the smallest non-null doc_id reachable, null if there is none;
an empty table gives an empty result. Very long texts are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.llm.common import written
from remedy.sources.tables import table

WIDTH = 3
MAX_BITS = 2
SEED = 42
# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
HALF = 23
SLICE = 1 << 15


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    w = text.lower().split()  # bytes: A-Z only, and exactly the contract's blanks
    if not w:
        return 0
    if len(w) < width:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, n = xxhash.xxh64_intdigest, len(w) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SLICE):
        part = w[i:i + SLICE + width - 1]
        h = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[j:] for j in range(width)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << j for j in range(64) if 2 * counts[j] > n))


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, fp long): th is a hash of the text, to tell rows of one id, or without
    one, apart; fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
                       F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: equal within a coset."""
    v = v.copy()
    for bit in range(HALF - 1, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


@lru_cache(maxsize=None)
def _cosets(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of weight <= 3 (excess 0) or exactly 3 + excess, grouped by syndrome:
    start offsets (2049) and patterns. XOR with a word gives the anchors at that distance."""
    weights = np.array([bin(i).count("1") for i in range(1 << 12)], dtype=np.uint8)
    every = np.arange(1 << HALF, dtype=np.int64)
    weight = weights[every & 0xFFF] + weights[every >> 12]
    pick = every[weight <= 3] if excess == 0 else every[weight == 3 + excess]
    syn = _syndromes(pick)
    order = np.argsort(syn, kind="stable")
    return np.searchsorted(syn[order], np.arange(2049)), pick[order]


def replicas(fp: np.ndarray, k: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, is home) of every replica of the fingerprints."""
    half = [(fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << HALF) - 1)).astype(np.int64) for s in (0, HALF)]
    syn = [_syndromes(h) for h in half]
    idx, anchor, home = [], [], []
    for e1 in range(k + 1):
        s1, p1 = _cosets(e1)
        for e2 in range(k + 1 - e1):
            s2, p2 = _cosets(e2)
            n1, n2 = s1[syn[0] + 1] - s1[syn[0]], s2[syn[1] + 1] - s2[syn[1]]
            n = n1 * n2
            i = np.repeat(np.arange(len(fp)), n)
            at = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            a = half[0][i] ^ p1[s1[syn[0][i]] + at // n2[i]]
            b = half[1][i] ^ p2[s2[syn[1][i]] + at % n2[i]]
            idx.append(i)
            anchor.append(a << HALF | b)
            home.append(np.full(len(i), e1 + e2 == 0))
    return np.concatenate(idx), np.concatenate(anchor), np.concatenate(home)


def links(fps: DataFrame, k: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b), a < b, within k bits of each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                i, anchor, home = replicas(fp, k)
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(anchor), pa.array(home)],
                                                 names=["fp", "anchor", "home"])

    member = fps.select("fp").mapInArrow(run, "fp long, anchor long, home boolean")
    homes = member.filter("home").select(F.col("fp").alias("b"), "anchor")
    # per anchor: replicas probe the few homes; only links leave the join
    near = member.select(F.col("fp").alias("a"), "anchor").join(homes.hint("shuffle_hash"), "anchor").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k))
    return near.select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (fp, label: smallest id or null), edges (a, b) -> (fp, root, component_id).

    Each round takes the least label among the neighbours, then the label of the label;
    only linked fingerprints take part, and labels are fingerprints until the end. A
    fingerprint has a bounded number of neighbours within k bits, so no key is hot here;
    labels shared by many are split by the skew join."""
    both = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    cur = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        seen = both.join(cur.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(
            F.min("lb").alias("lb"))
        step = cur.join(seen, "a").select("a", F.col("l").alias("old"), F.least("l", "lb").alias("l"))
        jump = cur.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        nxt = written(step.join(jump, "l").select("a", "old", F.least("l", "ll").alias("l")), "labels")
        if nxt.filter("l <> old").isEmpty():
            break
        cur = nxt.select("a", "l")
    root = nodes.join(cur.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "label", F.coalesce("l", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("label").alias("component_id"))
    return root.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    width: int = WIDTH, k: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, fp (long), root (one fingerprint of the
    component), component_id."""
    fps = written(fingerprints(docs, doc_id, text, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("label")), "nodes")
    classes = components(nodes, written(links(nodes, k), "links"))
    return fps.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             width: int = WIDTH, k: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, rows
    without an id last, of several texts that of the smallest hash (of rows repeating it,
    one)."""
    near = near_duplicates(docs, doc_id, text, width, k)
    # copies collapse first, so that a large component is a few rows a task
    texts = near.groupBy("root", "doc_id", "th").agg(F.count("*").alias("rows"))
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", "rows")).alias("k"))
    keep = written(best.select(F.col("k.doc_id").alias("_sh_i"), F.col("k.th").alias("_sh_t"), F.col("k.rows").alias("rows")), "kept")
    on = docs[doc_id].eqNullSafe(F.col("_sh_i")) & (F.xxhash64(docs[text]) == F.col("_sh_t"))
    kept = docs.join(keep.drop("rows"), on, "left_semi")
    if keep.filter("rows > 1").isEmpty():
        return kept
    return kept.withColumn("_sh_t", F.xxhash64(F.col(text))).dropDuplicates([doc_id, "_sh_t"]).drop("_sh_t")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
