"""Brown class-based bigram model: P(w | g) = P(class | g) * P(w | class), g the class before.

1. Documents are encoded in blocks: local word numbers, word hashes, training counts.
2. Blocks send their words, by hash, to parts that add up the counts of all words.
3. The SEED_WORDS most frequent words are clustered by the exchange algorithm on their
   bigram counts: each word in turn moves to the class that raises the class-bigram
   likelihood most, until none moves (a table of fixed size, on the driver).
4. Every other word makes one exchange step against those classes: blocks send the
   classes around each occurrence (a table of them for a word with many) to the word's
   part, which picks the best class and sends class and count back to the blocks that use
   the word. Parts are sized by the bytes they receive.
5. Blocks become class sequences; class bigrams of all training tokens are added up, and
   a last pass scores every document.

Emission uses absolute discounting, transitions are smoothed towards class frequencies.
A word not seen in training is one symbol; its chance after class g is the share of words
seen once among what follows g (Good-Turing), and words seen once stand in for it as
context. So P sums to one over the training words and that symbol.

Counts cover all tokens of all training documents; SEED_WORDS and CLASSES are the model's
size. Words are told apart by a 64-bit hash.

Defined cases: null or empty text is the end token alone; null ids count as the empty
text for the split; repeated rows are scored and counted each; without training tokens
every word is unseen; an empty table gives no rows; a document is never cut, so a very
long one is a block of its own; other columns are not carried.
"""

from __future__ import annotations

import itertools
import secrets
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.llm.common import held_out, written
from remedy.sources.tables import table

CLASSES = 64
SEED_WORDS = 1000
SWEEPS = 12
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20  # of all blocks' words and contexts that meet in one task
BACKOFF = 5.0
BASE = 0.1
SLICE, SLICE_TOKENS = 1 << 12, 1 << 18  # words, and occurrences, whose context counts are made at a time
UNK, END = CLASSES, CLASSES + 1  # classes of the unseen symbol and of the end
K = CLASSES + 2
MANY = 4 * K  # occurrences in a block beyond which a table of 2K counts is shorter than the contexts
_BLOCK = "block long, doc_id array<long>, held array<boolean>, n array<int>, ids binary, hashes binary, counts binary, " \
         "sends long"


def _bin(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _np(scalar: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype=kind)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out) -> one row per block of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a method of the dict itself as its factory would be a cycle: every block's words would stay in memory
        doc, held, n, ids, size, known = [], [], [], array("i"), 0, defaultdict(itertools.count().__next__)

        def block() -> pa.RecordBatch:
            train = np.repeat(~np.array(held, dtype=bool), n)
            codes = np.frombuffer(ids, dtype=np.int32)
            digest = xxhash.xxh3_64_intdigest
            hashes = np.array([digest(w) for w in known], dtype=np.uint64)
            counts = np.bincount(codes[train], minlength=len(known)).astype(np.int32)
            sends = 12 * len(known) + 2 * int(np.minimum(counts, MANY).sum())  # bytes to all parts at most
            return pa.RecordBatch.from_arrays([
                pa.array([secrets.randbits(62)]), pa.array([doc], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int32())),
                _bin(codes), _bin(hashes), _bin(counts), pa.array([sends])],
                names=["block", "doc_id", "held", "n", "ids", "hashes", "counts", "sends"])

        for b in batches:
            for i in range(b.num_rows):
                t = b.column(1)[i]
                words = t.as_buffer().to_pybytes().lower().split() if t.is_valid else []
                ids.extend(map(known.__getitem__, words))
                doc.append(b.column(0)[i].as_py())
                held.append(b.column(2)[i].as_py())
                n.append(len(words))
                size += len(t.as_buffer()) if t.is_valid else 0
                if size >= BLOCK_BYTES or len(doc) >= 200_000:
                    yield block()
                    doc, held, n, ids, size, known = [], [], [], array("i"), 0, defaultdict(itertools.count().__next__)
        if doc:
            yield block()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(run, _BLOCK)


def _part_order(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers ordered by part, and where each part starts."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def count_words(blocks: DataFrame, parts: int, top: int) -> DataFrame:
    """Per part: tokens n, words v, words seen once n1 and twice n2, and its ``top`` words."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes, counts = _np(b.column(0)[i], np.uint64), _np(b.column(1)[i], np.int32)
                seen = np.flatnonzero(counts)
                order, at = _part_order(hashes[seen], parts)
                order = seen[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(parts)),
                    pa.array([hashes[order[at[p]:at[p + 1]]].tobytes() for p in range(parts)], pa.binary()),
                    pa.array([counts[order[at[p]:at[p + 1]]].tobytes() for p in range(parts)], pa.binary()),
                ], names=["part", "h", "c"])

    def add(t: pa.Table) -> pa.Table:
        h = np.concatenate([_np(x, np.uint64) for x in t.column("h")])
        c = np.concatenate([_np(x, np.int32) for x in t.column("c")])
        words, inv = np.unique(h, return_inverse=True)
        tot = np.bincount(inv, weights=c, minlength=len(words)).astype(np.int64)
        best = np.lexsort((words, -tot))[:top]
        return pa.table({"n": [int(tot.sum())], "v": [len(words)], "n1": [int((tot == 1).sum())],
                         "n2": [int((tot == 2).sum())],
                         "top": pa.array([list(zip(words[best].view(np.int64).tolist(), tot[best].tolist()))],
                                         pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))})

    sent = blocks.select("hashes", "counts").mapInArrow(send, "part long, h binary, c binary")
    return sent.groupBy("part").applyInArrow(add, "n long, v long, n1 long, n2 long, top array<struct<h:long,c:long>>")


def _places(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seed number of each word (seeds sorted by hash), len(seeds) for other words."""
    if not len(seeds):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
    return np.where(seeds[at] == hashes, at, len(seeds))


def _with_ends(values: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Token values with ``end`` after each document; positions of the ends."""
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(values) + len(n), end, dtype=values.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = values
    return out, ends


def _train_tokens(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens per document) of the training documents of a block row."""
    n = np.array(b.column("n")[i].as_py(), dtype=np.int64)
    train = ~np.array(b.column("held")[i].as_py(), dtype=bool)
    return _np(b.column("ids")[i], np.int32)[np.repeat(train, n)], n[train]


def seed_bigrams(blocks: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Bigram counts of the seed words; one symbol for all others, one for the end."""
    size = len(seeds) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                ids, n = _train_tokens(b, i)
                if not len(n):
                    continue
                x, _ = _with_ends(_places(_np(b.column("hashes")[i], np.uint64), seeds)[ids], n, size - 1)
                total += np.bincount(np.append(size - 1, x[:-1]) * size + x, minlength=size * size)
        for r in range(size):
            row = total[r * size:(r + 1) * size]
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([r]), _bin(row)], names=["r", "c"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"r": t.column("r").slice(0, 1), "c": _bin(sum(_np(x, np.int64) for x in t.column("c")))})

    out = np.zeros((size, size))
    for x in blocks.select("held", "n", "ids", "hashes").mapInArrow(count, "r long, c binary").groupBy(
            "r").applyInArrow(add, "r long, c binary").toLocalIterator():
        out[x["r"]] = np.frombuffer(x["c"], np.int64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, freq: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering. ``bigrams`` is over words, then the other-words symbol, then the
    end; those two keep classes of their own. Returns word classes and class bigrams."""
    words = len(bigrams) - 2
    by_freq = np.argsort(-freq, kind="stable")
    cls = np.empty(words + 2, dtype=np.int64)
    cls[by_freq] = np.arange(words) % classes
    cls[words], cls[words + 1] = classes, classes + 1
    k = classes + 2
    fold = np.zeros((words + 2, k))
    fold[np.arange(words + 2), cls] = 1
    g = fold.T @ bigrams @ fold
    for _ in range(sweeps):
        moved = 0
        for w in by_freq:
            a, own = cls[w], bigrams[w, w]
            out = np.bincount(cls, weights=bigrams[w], minlength=k)
            inn = np.bincount(cls, weights=bigrams[:, w], minlength=k)
            out[a] -= own
            inn[a] -= own
            g[a] -= out
            g[:, a] -= inn
            g[a, a] -= own
            row, col = g.sum(axis=1)[:classes], g.sum(axis=0)[:classes]
            part = g[:classes]
            gain = (_xlogx(part + out) - _xlogx(part)).sum(axis=1)
            part = g[:, :classes]
            gain += (_xlogx(part + inn[:, None]) - _xlogx(part)).sum(axis=0)
            d = g[np.arange(classes), np.arange(classes)]
            both = out[:classes] + inn[:classes] + own
            gain += _xlogx(d + both) - _xlogx(d + out[:classes]) - _xlogx(d + inn[:classes]) + _xlogx(d)
            gain -= _xlogx(row + out.sum() + own) - _xlogx(row) + _xlogx(col + inn.sum() + own) - _xlogx(col)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            g[b] += out
            g[:, b] += inn
            g[b, b] += own
            moved += b != a
            cls[w] = b
        if not moved:
            break
    return cls[:words], g


def _around(owner: np.ndarray, around: np.ndarray, words: int) -> np.ndarray:
    """Per word, how often each class stands before, then after it."""
    return np.hstack([np.bincount(owner * K + around[:, j], minlength=words * K).reshape(words, K) for j in (0, 1)])


def word_contexts(blocks: DataFrame, parts: int, seeds: np.ndarray, seed_class: np.ndarray) -> DataFrame:
    """(part, block, h, c, around, tables): the block's words of the part with their counts; for
    words that are no seeds, in this order, the classes before and after each occurrence, or
    where there are over MANY, a table of 2K counts."""
    code = np.append(seed_class, CLASSES).astype(np.uint8)  # CLASSES: some other word, CLASSES + 1: end

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes, counts = _np(b.column("hashes")[i], np.uint64), _np(b.column("counts")[i], np.int32)
                place = _places(hashes, seeds)
                order, at = _part_order(hashes, parts)
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                hashes, counts = hashes[order], counts[order]
                many = (place[order] == len(seeds)) & (counts > MANY)
                ids, n = _train_tokens(b, i)
                x, ends = _with_ends(code[place][ids], n, CLASSES + 1)
                around = np.stack([np.append(np.uint8(CLASSES + 1), x[:-1]), np.append(x[1:], np.uint8(CLASSES + 1))], axis=1)
                around = np.delete(around, ends, axis=0)
                rare = place[ids] == len(seeds)
                where = rank[ids[rare]]
                by_word = np.argsort(where, kind="stable")
                around, where = around[rare][by_word], where[by_word]
                often = many[where]
                tables = _around((np.cumsum(many) - 1)[where[often]], around[often], int(many.sum())).astype(np.int32)
                around = around[~often]
                cut, row = np.searchsorted(where[~often], at), np.append(0, np.cumsum(many))[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(parts)), pa.array([b.column("block")[i].as_py()] * parts),
                    pa.array([hashes[at[p]:at[p + 1]].tobytes() for p in range(parts)], pa.binary()),
                    pa.array([counts[at[p]:at[p + 1]].tobytes() for p in range(parts)], pa.binary()),
                    pa.array([around[cut[p]:cut[p + 1]].tobytes() for p in range(parts)], pa.binary()),
                    pa.array([tables[row[p]:row[p + 1]].tobytes() for p in range(parts)], pa.binary()),
                ], names=["part", "block", "h", "c", "around", "tables"])

    return blocks.select("block", "held", "n", "ids", "hashes", "counts").mapInArrow(
        send, "part long, block long, h binary, c binary, around binary, tables binary")


def place_words(blocks: DataFrame, parts: int, seeds: np.ndarray, seed_class: np.ndarray, g: np.ndarray) -> DataFrame:
    """(block, part, counts, classes) of the block's words in part order; and per part a
    row without block whose counts are the tokens and whose classes the words per class."""
    log = np.log(g + 0.5)
    fit = np.vstack([log[:, :CLASSES], log[:CLASSES].T])  # gain by class before, by class after
    share = 2 * np.log(g.sum(axis=1)[:CLASSES] + 0.5)

    def choose(key: tuple, t: pa.Table) -> pa.Table:
        sizes = [len(x.as_buffer()) // 8 for x in t.column("h")]
        words, inv = np.unique(np.concatenate([_np(x, np.uint64) for x in t.column("h")]), return_inverse=True)
        c = np.concatenate([_np(x, np.int32) for x in t.column("c")])
        tot = np.bincount(inv, weights=c, minlength=len(words)).astype(np.int64)
        place = _places(words, seeds)
        rare = place == len(seeds)
        around = np.concatenate([_np(x, np.uint8).reshape(-1, 2) for x in t.column("around")])
        tables = np.concatenate([_np(x, np.int32).reshape(-1, 2 * K) for x in t.column("tables")])
        many = rare[inv] & (c > MANY)  # of a block's word
        few = np.where(rare[inv] & ~many, c, 0).astype(np.int64)
        start, row = np.cumsum(few) - few, np.cumsum(many) - 1
        by_word = np.argsort(inv, kind="stable")
        owner = inv[by_word]
        upto = np.cumsum(np.bincount(inv, weights=np.where(many, MANY, few), minlength=len(words)))
        cls = np.append(seed_class, 0)[place]
        lo = 0
        while lo < len(words):
            full = np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_TOKENS, side="right")
            hi = min(lo + SLICE, len(words), max(lo + 1, int(full)))
            a, z = np.searchsorted(owner, [lo, hi])
            own = by_word[a:z]
            n = few[own]
            s = around[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            seen = _around(np.repeat(owner[a:z] - lo, n), s, hi - lo)
            own, o = own[many[own]], owner[a:z][many[own]] - lo
            if len(o):
                first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                seen[o[first]] += np.add.reduceat(tables[row[own]], first, axis=0, dtype=np.int64)
            best = (seen @ fit - seen[:, :K].sum(axis=1)[:, None] * share).argmax(axis=1)
            cls[lo:hi] = np.where(rare[lo:hi], best, cls[lo:hi])
            lo = hi
        cls = np.where(tot > 0, cls, UNK)
        at = 0
        out_c, out_k = [], []
        for n in sizes:
            out_c.append(tot[inv[at:at + n]].tobytes())
            out_k.append(cls[inv[at:at + n]].astype(np.uint8).tobytes())
            at += n
        out_c.append(np.bincount(cls, weights=tot, minlength=K).astype(np.int64).tobytes())
        out_k.append(np.bincount(cls[tot > 0], minlength=K).astype(np.int64).tobytes())
        return pa.table({"block": pa.array(t.column("block").to_pylist() + [None], pa.int64()),
                         "part": pa.array([key[0].as_py()] * (len(sizes) + 1), pa.int64()),
                         "counts": pa.array(out_c, pa.binary()), "classes": pa.array(out_k, pa.binary())})

    return word_contexts(blocks, parts, seeds, seed_class).groupBy("part").applyInArrow(
        choose, "block long, part long, counts binary, classes binary")


_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, " \
         "classes binary, bigrams binary"


def class_sequences(blocks: DataFrame, placed: DataFrame, parts: int, stats: dict) -> DataFrame:
    """One row per document with its class sequence and the parts of its score that need no
    transitions; and per block a row of class-bigram counts of its training tokens."""
    n_all, v_all, n_end = stats["n"], stats["v"], stats["ends"]
    per_class = stats["tokens"] - stats["discount"] * stats["words"]

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        b = left.combine_chunks().to_batches()[0]
        hashes, ids = _np(b.column("hashes")[0], np.uint64), _np(b.column("ids")[0], np.int32)
        n = np.array(b.column("n")[0].as_py(), dtype=np.int64)
        held = np.array(b.column("held")[0].as_py(), dtype=bool)
        order, at = _part_order(hashes, parts)
        count, cls = np.zeros(len(hashes), np.int64), np.full(len(hashes), UNK, np.uint8)
        for p, c, k in zip(right.column("part").to_pylist(), right.column("counts"), right.column("classes")):
            own = order[at[p]:at[p + 1]]
            count[own], cls[own] = _np(c, np.int64), _np(k, np.uint8)
        base = np.log10(count + BASE) - np.log10(n_all + BASE * (v_all + 1))
        known = count > 0
        emit = np.zeros(len(hashes))
        emit[known] = np.log10((count[known] - stats["discount"]) / per_class[cls[known]])
        doc = np.repeat(np.arange(len(n)), n)
        total = lambda x: np.bincount(doc, weights=x[ids], minlength=len(n))
        seq, ends = _with_ends(cls[ids], n, END)
        once, _ = _with_ends((count == 1)[ids], n, False)
        before = np.append(np.uint8(END), seq[:-1])
        train = np.repeat(~held, n + 1)
        pair = before.astype(np.int64) * (2 * K) + seq
        grams = np.bincount(pair[train], minlength=K * 2 * K)  # columns K..: the word after was seen once
        grams += np.bincount((pair + K)[train & once], minlength=K * 2 * K)
        lone = train & np.append(False, once[:-1])  # after a word seen once, as after an unseen one
        as_unseen = UNK * 2 * K + seq.astype(np.int64)
        grams += np.bincount(as_unseen[lone], minlength=K * 2 * K)
        grams += np.bincount((as_unseen + K)[lone & once], minlength=K * 2 * K)
        start = np.append(0, ends[:-1] + 1)
        rows = len(n)
        end_base = np.log10(n_end + BASE) - np.log10(n_all + BASE * (v_all + 1))
        return pa.table({
            "doc_id": pa.array(b.column("doc_id")[0].as_py() + [None], pa.int64()),
            "held_out": pa.array(held.tolist() + [None], pa.bool_()),
            "n_tokens": pa.array(np.append(n + 1, 0)),
            "n_known": pa.array(np.append(total(known.astype(float)).astype(np.int64) + (n_end > 0), 0)),
            "base_score": pa.array(np.append(total(base) + end_base, 0.0)),
            "emission": pa.array(np.append(total(emit), 0.0)),
            "classes": pa.array([seq[start[i]:ends[i] + 1].tobytes() for i in range(rows)] + [None], pa.binary()),
            "bigrams": pa.array([None] * rows + [grams.astype(np.int64).tobytes()], pa.binary())})

    return blocks.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(code, _CODED)


def transitions(grams: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from counts (K x 2K: all, and of words seen once)."""
    n, once = grams[:, :K].astype(float), grams[:, K:].sum(axis=1)
    total = n.sum(axis=1)
    unseen = (once + 0.5) / (total + 1.0)
    prior = n[np.arange(K) != UNK].sum(axis=0) + 0.5
    prior[UNK] = 0
    p = (n + BACKOFF * prior / prior.sum()) / (total + BACKOFF)[:, None]
    p *= (1 - unseen)[:, None]
    p[:, UNK] = unseen
    return np.log10(p)


def brown_scores(docs: DataFrame, classes_of: int = SEED_WORDS) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Learns from the rows that are not held out."""
    blocks = written(encode(docs), "brown-blocks", wide=True)
    size = blocks.agg(F.sum("sends").alias("sends"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("ends")).first()
    parts, ends = (size["sends"] or 0) // PART_BYTES + 1, int(size["ends"] or 0)
    counted = written(count_words(blocks, parts, classes_of), "brown-counts")
    s = counted.agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    top = counted.select(F.explode("top").alias("t")).select("t.h", "t.c").orderBy(
        F.desc("c"), F.col("h") < 0, "h").limit(classes_of).collect()  # equal counts: unsigned, as within a part
    seeds = np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(seeds)
    seeds, freq = seeds[by_hash], np.array([r["c"] for r in top], dtype=np.int64)[by_hash]
    seed_class, g = exchange(seed_bigrams(blocks, seeds), freq)
    placed = written(place_words(blocks, parts, seeds, seed_class, g), "brown-classes")
    tokens, words = np.zeros(K, np.int64), np.zeros(K, np.int64)
    for r in placed.filter("block IS NULL").select("counts", "classes").toLocalIterator():  # two short rows a part
        tokens += np.frombuffer(r["counts"], np.int64)
        words += np.frombuffer(r["classes"], np.int64)
    n1, n2 = s["n1"] or 0, s["n2"] or 0
    stats = {"n": (s["n"] or 0) + ends, "v": (s["v"] or 0) + (ends > 0), "ends": ends, "tokens": tokens, "words": words,
             "discount": n1 / (n1 + 2 * n2) if n2 else 0.5}
    coded = written(class_sequences(blocks, placed.filter("block IS NOT NULL"), parts, stats), "brown-sequences")

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"g": _bin(sum(_np(x, np.int64) for x in t.column("bigrams")))})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_np(x, np.int64) for b in batches for x in b.column(0)), np.zeros(K * 2 * K, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([0]), _bin(total)], names=["k", "bigrams"])

    summed = coded.filter("bigrams IS NOT NULL").select("bigrams").mapInArrow(partial, "k long, bigrams binary").groupBy(
        "k").applyInArrow(add, "g binary").collect()  # one row: a K x 2K table from each task, summed
    grams = np.frombuffer(summed[0]["g"], np.int64).reshape(K, 2 * K) if summed else np.zeros((K, 2 * K), np.int64)
    log_t = transitions(grams).ravel()
    n_all = stats["n"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(6).cast(pa.large_binary())
            _, offsets, data = col.buffers()
            off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
            out = b.column(5).to_numpy(zero_copy_only=False).copy()
            raw = np.frombuffer(data, np.uint8)
            for at in range(0, len(out), 2000):
                end = min(at + 2000, len(out))
                seq = raw[off[at]:off[end]].astype(np.int64)
                before = np.append(END, seq[:-1])  # every document ends with END, the context of the next one's start
                out[at:end] += np.add.reduceat(log_t[before * K + seq], off[at:end] - off[at])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(np.full(b.num_rows, n_all, np.int64)), b.column(4), pa.array(out)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = coded.filter("bigrams IS NULL").select(
        "doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, tokens, base, model): perplexity per token of either split."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("base_score").alias("base"), per("score").alias("model"))


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return brown_scores(docs.select("doc_id", "text", held_out(F.col("doc_id"), 10).alias("held_out")))


QUERIES = {"op1_brown": op1_brown}
