"""Sum-of-squares online packing of documents into fixed windows of tokens.

A level array counts the open windows at every fill level. A document (its tokens and an
end token) goes to the level h where the sum of squared counts grows least when one window
moves from h to h + s: a window left full or empty counts for nothing, ties take the fullest
level. That keeps all levels about equally rare, so a fitting gap is nearly always at hand.
Documents above the capacity first fill windows of their own; their rest is placed so.

Every task packs what it reads, in order, without a shuffle: only open windows are kept.
When more than ``OPEN`` are open, and at the end, they land: those at a power of two close as
they are (no padding), the others are strung together, cut at the capacity, and what remains
is cut into powers of two. So nothing is padded, and only documents in windows still open at a
landing can be cut.

Texts are encoded word by word (the tokenizer drops white space and no word depends on its
neighbours) from a bounded table per worker; words of Latin letters are encoded in runs,
which the word-end mark of a word's last piece cuts apart.

Defined cases: a null or empty text is its end token alone; equal rows are packed each; rows
without id are packed with a null id; a text of any length is read in slices; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.sources.tables import table

FILE = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
OPEN = 4096
#: words used of late that a worker keeps encoded (and as many from before), the longest one
#: kept, and bytes of a text read at a time
KEPT, KEPT_BYTES, SLICE = 250_000, 48, 1 << 20
# Latin letters that have no other normal form
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# a mark beside what the tokenizer might take together with it: any punctuation, and any
# other character but a Latin letter of two bytes before it
RUN = re.compile(rb"[.,;:!?](?:(?=[!-/:-@\[-`{-~\x80-\xff])|(?<=[!-/:-@\[-`{-~].)"
                 rb"|(?<=[\x80-\xff].)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
BLANK = re.compile(rb"[ \t\n\r]")


def words_of(text: bytes) -> list[bytes]:
    """A text as parts that the tokenizer encodes one by one: words, in lower case as it makes
    them, and single punctuation marks. Where a mark stands beside others, or what might be
    a special token is there, words are cut at white space alone."""
    if b"<|" in text or RUN.search(text):
        return text.split()
    for mark in (b".", b",", b";", b":", b"!", b"?"):
        text = text.replace(mark, b" " + mark)
    return text.lower().split()


def _by_rank(file: str):
    """The merges of the file for words of letters, in tiktoken: several times as fast as the
    library that the file is made for. Words end in "/", which stands for the word-end mark
    (no word of letters holds one). None where merges are not numbered in their order behind
    the bytes and the bytes that end a word."""
    import tiktoken

    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, vocab = model["end_of_word_suffix"], model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if not mark or [vocab.get(m) for m in merged] != list(range(512, 512 + len(merged))):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for t, i in vocab.items():
        if i < 512 + len(merged):
            raw, end = t.removesuffix(mark), b"/" if t.endswith(mark) and t != mark else b""
            if "/" not in raw or len(raw) == 1 and not end:
                ranks[bytes(byte[c] for c in raw) + end] = i
    if len(ranks) < 511 or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str="[^/]+/", mergeable_ranks=ranks, special_tokens={})


class Words:
    """Words -> their ids as little-endian 32-bit bytes."""

    loaded: dict = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        place = file if os.path.isabs(file) else public_tokenizers.path(file)
        self.tok, self.fast = Tokenizer.from_file(place), _by_rank(place)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}  # what was used of late, and before that
        self.before: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, file: str) -> Words:
        if file not in cls.loaded:
            cls.loaded[file] = cls(file)
        return cls.loaded[file]

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _run(self, words: list[str]) -> list[bytes]:
        """Words of letters, encoded as one text and cut at the mark of a word's last piece."""
        if self.fast:
            found = self.fast.encode_ordinary("/".join(words).lower() + "/")
        else:
            found = self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cut) != len(words):
            return self._whole(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cut], cut)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        plain, other = [], []
        for w in new:
            (plain if w.isalpha() or PLAIN.fullmatch(w.decode(errors="replace")) else other).append(w)
        got = {}
        for i in range(0, len(plain), 500):
            run = plain[i:i + 500]
            got.update(zip(run, self._run([w.decode() for w in run])))
        got.update(zip(other, self._whole([w.decode(errors="replace") for w in other])))
        return got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts -> their ids as little-endian 32-bit bytes."""
        if len(self.kept) > KEPT:
            self.kept, self.before = {}, self.kept
        parts = [words_of(t) for t in texts]
        known, need = self.kept, [w for w in set().union(*parts) if w not in self.kept]
        known.update((w, self.before[w]) for w in need if w in self.before)
        new = self._learn([w for w in need if w not in self.before])
        known.update(new)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > KEPT_BYTES:
                del known[w]
        return out


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in runs of about ``size`` bytes that end at a blank."""
    at = 0
    while at < len(text):
        m = BLANK.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


class Packer:
    """Open windows by fill level. A piece is (document, start, ids as bytes); ``close`` takes
    the pieces of a finished window."""

    def __init__(self, capacity: int, close):
        self.capacity, self.close = capacity, close
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # 0 for empty and full, always
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, s: int) -> int:
        """The fill level (0: a new window) where the sum of squared counts grows least."""
        levels = np.flatnonzero(self.count[:self.capacity - s + 1])
        if not len(levels):
            return 0
        grows = 2 * (self.count[levels + s] - self.count[levels]) + 2
        if levels[-1] + s == self.capacity:
            grows[-1] -= 1
        least = grows.min()
        if 2 * self.count[s] + 1 < least:
            return 0
        return int(levels[np.flatnonzero(grows == least)[-1]])

    def place(self, piece: tuple) -> None:
        s = len(piece[2]) // 4
        h = self.level_for(s) if s < self.capacity else 0
        window = self.windows[h].pop() if h else []
        self.count[h] -= h > 0
        self.open -= h > 0
        window.append(piece)
        if h + s == self.capacity:
            self.close(window)
            return
        self.windows[h + s].append(window)
        self.count[h + s] += 1
        self.open += 1

    def land(self) -> None:
        """Closes all open windows without padding."""
        rest, size = [], 0
        for h in range(self.capacity - 1, 0, -1):
            for window in self.windows[h]:
                if h & (h - 1) == 0:
                    self.close(window)
                    continue
                for doc, start, ids in window:
                    while size + len(ids) // 4 >= self.capacity:
                        room = 4 * (self.capacity - size)
                        self.close([*rest, (doc, start, ids[:room])])
                        start, ids, rest, size = start + room // 4, ids[room:], [], 0
                    if ids:
                        rest.append((doc, start, ids))
                        size += len(ids) // 4
            self.windows[h] = []
        part = 1 << max(0, size.bit_length() - 1)
        window, room = [], part
        for doc, start, ids in rest:
            while ids:
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[:4 * take]))
                start, ids, room = start + take, ids[4 * take:], room - take
                if not room:
                    self.close(window)
                    size -= part
                    part = 1 << max(0, size.bit_length() - 1)
                    window, room = [], part
        self.count[:] = 0
        self.open = 0


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", file: str = FILE, capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece of a document: where it stands in the document (start, length of
    doc_tokens) and in its sequence (sequence_id, offset), the CRC-32 of its ids, and the ids
    (null unless ``with_ids``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = Words.load(file), TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        out: list[tuple] = []
        done = 0

        def close(window: list) -> None:
            nonlocal done
            at = 0
            for (i, total), start, ids in window:
                out.append((i, start, len(ids) // 4, zlib.crc32(ids), total, first + done, at, ids))
                at += len(ids) // 4
            done += 1

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(7)]
            if with_ids:
                flat = np.frombuffer(b"".join(r[7] for r in out), dtype="<i4")
                at = np.cumsum([0] + [r[2] for r in out]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            else:
                ids = pa.nulls(len(out), pa.list_(pa.int32()))
            out.clear()
            return pa.RecordBatch.from_arrays([*cols, ids], names=[c.split()[0] for c in PIECES.split(", ")])

        packer, width = Packer(capacity, close), 4 * capacity

        def add(i: int | None, ids: bytes) -> None:
            doc = (i, len(ids) // 4)
            full = len(ids) - len(ids) % width
            for at in range(0, full, width):
                close([(doc, at // 4, ids[at:at + width])])
            if full < len(ids):
                packer.place((doc, full // 4, ids[full:]))
            if packer.open > OPEN:
                packer.land()

        for batch in batches:
            ids_, texts, held, size = batch.column(0).to_pylist(), batch.column(1), [], 0
            for n, (i, t) in enumerate(zip(ids_, texts)):
                t = t.as_py() or b""
                if len(t) > SLICE:
                    held.append((i, b"".join(words.encode([s])[0] for s in slices(t))))
                else:
                    held.append((i, t))
                    size += len(t)
                if size >= SLICE or len(t) > SLICE or n == len(ids_) - 1:
                    plain = [k for k, (_, x) in enumerate(held) if not (k == len(held) - 1 and len(t) > SLICE)]
                    for k, x in zip(plain, words.encode([held[k][1] for k in plain])):
                        held[k] = (held[k][0], x)
                    for i2, x in held:
                        add(i2, x + end)
                    held, size = [], 0
                    if len(out) >= 5000:
                        yield flush()
        packer.land()
        yield flush()

    return rows.mapInArrow(run, PIECES)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("ids")


QUERIES = {"op12_packing": op12_packing}
