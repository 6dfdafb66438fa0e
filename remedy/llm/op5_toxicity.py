"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are folded (A-Z to a-z, other ASCII to blanks, further bytes as they are) and their
byte grams of the lengths ORDERS hashed into BINS bins. For each bin
r = log(P(bin | toxic) / P(bin | not)) over the texts that hold it, smoothed in proportion
to the classes so that an unseen bin gets 0; bins whose two rates differ by less than Z
standard errors get 0 too. A ridge logistic regression is fitted on count * r and on the
text's length, which takes the part of the many unmarked grams of a long text: a marker
weighs by how often it comes for the length. A text's score is its probability.

The classifier is fitted on at most TRAIN_ROWS labelled rows that are not held out, those
with the smallest id hash (the documented bound); every document is scored whole.

Defined cases: a null text scores like an empty one, by the intercept; null labels and
null ids are not learned from; an id labelled twice is learned from once per label row;
with no labels, or one class only, the score is that class's rate (0.5 without any);
repeated rows get equal results; other columns pass through ``score_text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedy.llm.common import held_out, written
from remedy.sources.tables import table

BITS = 21
BINS = 1 << BITS
ORDERS = (3, 4, 6, 8)
TRAIN_ROWS = 20_000
PRIOR = 4.0  # weight of the class-proportional prior, in texts
Z = 6.0
RIDGE = 3.0
STEPS = 200
RATE = 0.05
CHUNK = 1 << 14
# Texts are hashed in runs of about so many bytes, to bound a task's memory.
RUN_BYTES = 2 << 20


@dataclass
class Model:
    weight: np.ndarray  # per bin: fitted coefficient times log-count ratio
    bias: float
    per_kb: float = 0.0


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint32)
    fold[:128] = 32
    for c in range(26):
        fold[65 + c] = fold[97 + c] = 97 + c
    return fold


FOLD = _fold()


def gram_bins(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each order the bins of the grams that start at each byte; BINS where one would
    cross the end of its text."""
    x = np.concatenate([FOLD[raw], np.full(7, 32, np.uint32)]).astype(np.uint64)
    two = x[:-1] << np.uint64(8) | x[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    out = []
    for n in ORDERS:
        # Fixed value: the odd multiplier of multiplicative hashing, one product for each order
        g = (eight >> np.uint64(64 - 8 * n)) * np.uint64(11400714819323198485) ^ np.uint64(n * 0x9E3779B97F4A7)
        b = ((g * np.uint64(11400714819323198485)) >> np.uint64(64 - BITS)).astype(np.int32)
        for k in range(1, n):
            cut = ends - k
            b[cut[cut >= 0]] = BINS
        out.append(b)
    return out


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) for stretches of rows; null counts as empty."""
    n, texts = len(texts), texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + RUN_BYTES, side="right")) - 1)
        end = min(end, n)
        o = off[at:end + 1] - off[at]
        yield at, end, raw[off[at]:off[end]], o[:-1], o[1:]
        at = end


def _count(rows: DataFrame) -> DataFrame:
    """(label, t) -> per chunk of bins, the texts of either class that hold each bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(BINS + 1, np.int32), np.zeros(BINS + 1, np.int32)]
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False)
            for at, end, raw, starts, ends in _runs(b.column(1)):
                grams = gram_bins(raw, ends)
                for i in range(at, end):
                    c = seen[int(label[i])]
                    u = np.concatenate([g[starts[i - at]:ends[i - at]] for g in grams])
                    c[u] = c[u] + 1  # repeated bins of one text are assigned the same value
        for k in range(0, BINS, CHUNK):
            part = [c[k:k + CHUNK] for c in seen]
            if part[0].any() or part[1].any():
                yield pa.RecordBatch.from_pydict({
                    "chunk": [k], "neg": pa.array([part[0].tobytes()], pa.binary()),
                    "pos": pa.array([part[1].tobytes()], pa.binary())})

    def total(batches: Iterator[pa.Table]) -> pa.Table:
        t = batches
        sums = [sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in t.column(c)) for c in ("neg", "pos")]
        return pa.table({"chunk": [t.column("chunk")[0].as_py()], "neg": pa.array([sums[0].tobytes()], pa.binary()),
                         "pos": pa.array([sums[1].tobytes()], pa.binary())})

    schema = "chunk long, neg binary, pos binary"
    return rows.select("label", "t").mapInArrow(run, schema).groupBy("chunk").applyInArrow(total, schema)


def ratios(neg: np.ndarray, pos: np.ndarray, n0: int, n1: int, z: float = Z) -> np.ndarray:
    """Log-count ratio per bin, 0 where the classes do not differ beyond chance."""
    n, both = n0 + n1, (neg + pos) / (n0 + n1)
    p, q = (pos + PRIOR * both) / (n1 + PRIOR), (neg + PRIOR * both) / (n0 + PRIOR)
    se = np.sqrt(np.maximum(both * (1 - both), 1.0 / n) * (1 / n1 + 1 / n0))
    keep = (np.abs(pos / n1 - neg / n0) >= z * se) & (both > 0)
    r = np.zeros(len(neg))
    r[keep] = np.log(p[keep] / q[keep])
    return r


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], kb: np.ndarray, labels: np.ndarray, r: np.ndarray) -> Model:
    """Ridge logistic regression by Adam on count * r (rows: bins and counts) and the length."""
    used = np.flatnonzero(r)
    place = np.zeros(len(r), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    col = place[np.concatenate([b for b, _ in rows])]
    val = r[used][col] * np.concatenate([c for _, c in rows]) if len(used) else np.zeros(0)
    theta = np.zeros(len(used) + 2)  # coefficients, per kilobyte, intercept
    theta[-1] = np.log(labels.mean() / (1 - labels.mean()))
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        score = theta[-1] + theta[-2] * kb + np.bincount(owner, weights=val * theta[col], minlength=len(rows))
        err = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        g = np.bincount(col, weights=val * err[owner], minlength=len(used)) + RIDGE * theta[:-2]
        g = np.append(g, [err @ kb, err.sum()]) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-12)
    weight = np.zeros(BINS + 1, np.float32)
    weight[used] = theta[:-2] * r[used]
    return Model(weight, float(theta[-1]), float(theta[-2]))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, label 0 or 1): learns from the ``limit`` label
    rows with the smallest id hash; only their ids are broadcast."""
    spark = docs.sparkSession
    ids = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).orderBy(
        F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    ids = written(ids.select("doc_id", F.col("label").cast("int").alias("label")), "tox-labels")
    rows = written(docs.join(F.broadcast(ids), "doc_id").select(
        "label", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t")), "tox-sample")
    n = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        rate = min(max((n1 + 0.5) / (n0 + n1 + 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BINS + 1, np.float32), float(np.log(rate / (1 - rate))))
    neg, pos = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for x in _count(rows).toLocalIterator():  # BINS sums, whatever the input
        neg[x["chunk"]:x["chunk"] + CHUNK] = np.frombuffer(x["neg"], np.int64)
        pos[x["chunk"]:x["chunk"] + CHUNK] = np.frombuffer(x["pos"], np.int64)
    r = ratios(neg, pos, n0, n1)
    shared = spark.sparkContext.broadcast(np.append(r != 0, False))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, counts, kb = [], [], []
            for at, end, raw, starts, ends in _runs(b.column(1)):
                grams = gram_bins(raw, ends)
                for i in range(end - at):
                    u = np.concatenate([g[starts[i]:ends[i]] for g in grams])
                    u, c = np.unique(u[shared.value[u]], return_counts=True)
                    bins.append(u.astype(np.int32).tobytes())
                    counts.append(c.astype(np.int32).tobytes())
                    kb.append((ends[i] - starts[i]) / 1000)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.binary()), pa.array(counts, pa.binary()),
                                              pa.array(kb, pa.float64())], names=["label", "bins", "counts", "kb"])

    got = rows.mapInArrow(features, "label int, bins binary, counts binary, kb double").collect()  # at most ``limit`` rows
    got.sort(key=lambda x: (x["label"], x["kb"], bytes(x["bins"])))
    return fit_logistic([(np.frombuffer(x["bins"], np.int32), np.frombuffer(x["counts"], np.int32)) for x in got],
                        np.array([x["kb"] for x in got]), np.array([x["label"] for x in got], float), np.append(r, 0.0))


def text_scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for at, end, raw, starts, ends in _runs(texts):
        out[at:end] += model.per_kb * (ends - starts) / 1000
        for bins in gram_bins(raw, ends):
            hit = np.flatnonzero(model.weight[bins])
            out[at:end] += np.bincount(np.searchsorted(ends, hit, side="right"), weights=model.weight[bins[hit]],
                                       minlength=end - at)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score_text(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic added."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text_scores(b.column(at), shared.value))], names=names)

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = train(docs, labels.filter(~held_out(F.col("doc_id"), 5)))
    out = score_text(docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text"), model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op5_toxicity": op5_toxicity}
