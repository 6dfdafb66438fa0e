"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A
text is cross-parsed against each: the longest prefix of what is left that occurs in the
sample is one phrase. phrases * log2(sample size) / bytes estimates the cross entropy in
bits per byte, and the language with the least wins (ties: the smaller name).

The automata become one transition table (state x byte class), so a task parses thousands
of stretches in step with array lookups. Texts are parsed whole, in stretches of SEGMENT
bytes; a stretch end closes a phrase, alike for every language.

The sample: per language, whole distinct texts in order of their hash until TRAIN_BYTES
bytes are reached (the documented bound of the classifier). A text longer than that gives
up to LONG_PIECES whole pieces of PIECE_BYTES bytes, chosen by hash: one in the first
round, its others in later rounds, which come only while the texts have not filled the
sample. Counts of rows, labels and lengths play no part in a prediction.

Defined cases: text that is null, empty or without a letter gives ``und`` with score 0,
and so does everything when nothing could be learned; rows with a null lang are not
learned from; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedy.llm.common import held_out, written
from remedy.sources.tables import table

TRAIN_BYTES = 30_000
# At most so many distinct texts (and pieces) of a language are looked at; also under the limit up to which
# Spark keeps only the first rows of a group before its shuffle.
TRAIN_TEXTS = 400
# A text longer than TRAIN_BYTES is learned from by pieces, together at most TRAIN_BYTES.
PIECE_BYTES = 1_000
LONG_PIECES = 30
SEGMENT = 1024
LANES = 8192
# Texts are parsed in runs of about so many bytes, to bound a task's memory.
RUN_BYTES = 4 << 20
UND = "und"


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  # byte -> class (uint8); 0: not in any sample
    table: np.ndarray  # (language, state, class) -> offset of the next state, or -1
    base: np.ndarray  # offset of each language's start state
    weight: np.ndarray  # log2 of the sample size


def byte_classes() -> np.ndarray:
    """Fold A-Z to a-z, everything in ASCII that is no letter to a blank."""
    fold = np.arange(256)
    fold[:128] = 32
    for c in range(26):
        fold[65 + c] = fold[97 + c] = 97 + c
    return fold


def suffix_automaton(text: np.ndarray, n_classes: int) -> np.ndarray:
    """Transitions (state x class, -1: none) of the automaton of all substrings."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), n_classes), -1, dtype=np.int64)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            out[s, c] = t
    return out


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Model from texts per language."""
    fold, langs = byte_classes(), sorted(samples)
    joined = [fold[np.frombuffer(b"\n".join(samples[x]), dtype=np.uint8)] for x in langs]
    seen = np.unique(np.concatenate(joined)) if joined else np.zeros(0, dtype=np.int64)
    code = np.zeros(256, dtype=np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    n = len(seen) + 1
    parts, base, at = [], [], 0
    for x in joined:
        t = suffix_automaton(code[x], n)
        parts.append(np.where(t >= 0, t * n + at, -1).astype(np.int32).ravel())
        base.append(at)
        at += t.size
    return Model(langs, code[fold].astype(np.uint8), np.concatenate(parts) if parts else np.zeros(0, np.int32),
                 np.array(base, dtype=np.int64), np.log2([max(2, len(x)) for x in joined]))


def sample_units(h: Column, b: Column, limit: int) -> Column:
    """What a text of hash ``h`` and ``b`` bytes can give to a sample: an array of (round,
    first byte, bytes), the whole text or pieces of a long one in order of their hash."""
    pieces = F.sequence(F.lit(0), F.floor((b - 1) / PIECE_BYTES).cast("int"))
    ranked = F.slice(F.array_sort(F.transform(pieces, lambda i: F.struct(F.xxhash64(h, i).alias("k"), i.alias("i")))),
                     1, LONG_PIECES)
    unit = lambda r, at, size: F.struct(
        r.cast("int").alias("round"), at.cast("int").alias("at"), size.cast("int").alias("size"))
    return F.when(b <= limit, F.array(unit(F.lit(0), F.lit(0), b))).otherwise(F.transform(
        ranked, lambda x, r: unit(r, x["i"] * PIECE_BYTES, F.least(F.lit(PIECE_BYTES), b - x["i"] * PIECE_BYTES))))


def train(rows: DataFrame, lang: str, text: str, limit: int = TRAIN_BYTES) -> Model:
    """Learns from the rows given. Only hashes and lengths are ranked; then the chosen
    texts and pieces, at most ``limit`` bytes a language and one text of at most ``limit``
    bytes more, are fetched."""
    r = rows.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("b"), F.col(text).alias("t"))
    w = W.partitionBy("lang").orderBy("round", "h")
    # copies collapse before they are ranked, and within a task before the shuffle
    units = r.select("lang", "h", "b").distinct().select("lang", "h", F.inline(sample_units(F.col("h"), F.col("b"), limit)))
    top = units.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= TRAIN_TEXTS).drop("r")
    chosen = written(top.withColumn("before", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1))).filter(
        F.coalesce("before", F.lit(0)) < limit).drop("before"), "lang-sample")
    part = F.substr(F.col("t").cast("binary"), F.col("at") + 1, F.col("size"))
    got = r.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "round", part.alias("t")).groupBy(
        "lang", "h", "round").agg(F.first("t").alias("t")).collect()
    samples: dict[str, list[bytes]] = {}
    for x in sorted(got, key=lambda x: (x["lang"], x["h"], x["round"])):
        samples.setdefault(x["lang"], []).append(bytes(x["t"]))
    return fit(samples)


def phrases(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """Phrase counts (language x text) of the texts codes[starts[i]:ends[i]]."""
    size = ends - starts
    pieces = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), pieces)
    first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(SEGMENT, ends[owner] - first)
    order = np.argsort(-length, kind="stable")
    n_lang, table_, base = len(model.langs), model.table, model.base
    fresh = np.array([[table_[b + c] if c else -1 for c in range(int(model.classes.max()) + 1)] for b in base])
    # a byte that starts no phrase is a phrase of its own: back to the start state
    alone = fresh < 0
    some_alone = alone.any(axis=0)
    fresh = np.where(alone, base[:, None], fresh)
    out = np.zeros((n_lang, len(size)), dtype=np.int64)
    for at in range(0, len(order), LANES):
        lane = order[at:at + LANES]
        pos, left = first[lane], length[lane]
        state = np.repeat(base[:, None], len(lane), axis=1)
        count = np.zeros((n_lang, len(lane)), dtype=np.int32)
        alive = len(lane)
        for t in range(int(left[0])):
            while alive and left[alive - 1] <= t:
                alive -= 1
            c = codes[pos[:alive] + t]
            s = state[:, :alive]
            nxt = table_[s + c]
            stop = nxt < 0
            count[:, :alive] += stop
            if some_alone[c].any():  # it also ends the phrase before it, if one is open
                count[:, :alive] += alone[:, c] & (s != base[:, None])
            np.copyto(s, nxt)
            np.copyto(s, fresh[:, c], where=stop)
        count += state != base[:, None]  # the phrase still open at the end
        for k in range(n_lang):
            out[k] += np.bincount(owner[lane], weights=count[k], minlength=len(size)).astype(np.int64)
    return out


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Does the text hold a letter? ASCII by array, other scripts text by text."""
    low = data | 32
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128), dtype=np.int32)])
    has = total[ends] > total[starts]
    for i in np.flatnonzero(~has & (ends > starts)):
        has[i] = any(ch.isalpha() for ch in data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace"))
    return has


def classify(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) per text; score is how far the best entropy is below the second
    best, as a share of the second (1 when only one language was learned)."""
    n = len(texts)
    texts = texts.cast(pa.large_binary())
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    langs, scores, at = [], np.zeros(n), 0
    while at < n:  # whole texts, about RUN_BYTES at a time
        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + RUN_BYTES, side="right")) - 1))
        starts = off[at:end] - off[at]
        ends = np.where(valid[at:end], off[at + 1:end + 1] - off[at], starts)
        found, scores[at:end] = _classify_run(raw[off[at]:off[end]], starts, ends, model)
        langs += found
        at = end
    return langs, scores


def _classify_run(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    n = len(starts)
    if not model.langs:
        return [UND] * n, np.zeros(n)
    has = _letters(raw, starts, ends)
    bits = phrases(model.classes[raw], starts, ends, model) * model.weight[:, None]
    best = bits.argmin(axis=0)
    ranked = np.sort(bits, axis=0)
    score = np.ones(n)
    if len(model.langs) > 1:
        score = np.where(ranked[1] > 0, 1 - ranked[0] / np.maximum(ranked[1], 1e-300), 0.0)
    return [model.langs[k] if h else UND for k, h in zip(best, has)], np.where(has, score, 0.0)


def detect(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred",
           score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score added."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, conf = classify(b.column(at), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(conf, pa.float64())], names=[*names])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    names = schema.names
    return docs.mapInArrow(run, schema)


def learned_from(docs: DataFrame) -> Model:
    """Model of the labelled rows that are not held out (crc32 of the id, modulo 5)."""
    return train(docs.filter(~held_out(F.col("doc_id"), 5)), "lang", "text")


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` without rows whose language can't be told (``und``) or scores too low."""
    hit = detect(docs, learned_from(docs), "text", "_li_pred", "_li_score")
    return hit.filter((F.col("_li_pred") != UND) & (F.col("_li_score") >= min_score)).drop("_li_pred", "_li_score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    return detect(rows, learned_from(docs)).drop("text")


QUERIES = {"op7_langid": op7_langid}
