"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes, a blank and the text, into tokens. Offsets where a
token of both ends (cuts) divide the document into groups; A and B tokens whose byte
ranges overlap are linked, so every stretch between two neighbouring ends is one link.

A byte range of a document is a fragment: the open prefix up to its first cut, the closed
groups between its cuts, and the open suffix behind its last one. ``compose`` puts two
neighbouring fragments together: the suffix of the left meets the prefix of the right,
which closes the groups that lie across. It is associative, with the empty fragment as
identity, so a document may be folded in any tree. A document of one range is closed in
its own task. Longer ones are cut into ranges of ``RANGE`` bytes that spread over tasks;
closed groups leave their task at once, and only prefixes and suffixes travel up a tree of
fan-in ``FAN``, so no task ever holds a whole long document's groups.

Ranges end where both tokenizers end a token whatever stands around: before one blank or
line break between two characters that are no white space. (A's pre-tokenizer stops there;
no piece of B holds a blank or line break after another character.) A stretch without such
a place is encoded in one task, and its tokens are then dealt to ranges by their start.
Encodings of such short stretches (words) are kept in a bounded table per worker.

How many documents link an id pair is counted over the whole corpus: distinct pairs are
taken per document, summed per block of documents before the shuffle, and only a block's
distinct pairs travel, once there and back.

Defined cases: a null or empty text, and one whose joined token bytes are not the blank and
the text (say, U+2581 in it), has no tokens: zeros and an empty digest. Equal rows count as
documents of their own and all stay, also without an id. An empty table gives an empty
result. Columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.llm.common import written
from remedy.sources.tables import table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of a range; of texts aligned in step; of texts per counted block; of a digest slice
RANGE = 1 << 16
STEP = 1 << 20
BLOCK = 1 << 24
SLICE = 1 << 13
FAN = 64
#: stretches used of late that a worker keeps encoded (and as many from before), and the
#: longest one kept
KEPT, KEPT_BYTES = 250_000, 48
SAFE = re.compile(r"(?<=[^\s▁])(?=[ \n][^\s▁])")


# ---- tokens ------------------------------------------------------------------------------

def _place(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_rank(file: str, token_bytes: list[bytes]):
    """The merges of a byte-level BPE file in tiktoken, several times as fast as the library
    that the file is made for, or None where they might differ: merges must be numbered in
    their order, and nothing may stand before or behind them but the known pre-tokenizer."""
    import tiktoken

    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    own = {t["id"] for t in spec["added_tokens"]}
    in_order = [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if spec["normalizer"] or not plain or not in_order or model.get("ignore_merges") or len(token_bytes) != 256 + len(merged) + len(own):
        return None
    ranks = {b: i for i, b in enumerate(token_bytes) if i not in own}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; encodes stretches of text."""

    loaded: dict = {}

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_place(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_place(b_file))
        byte = _byte_chars()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        n, b = self.b.get_piece_size(), self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                        else b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.fast = _by_rank(_place(a_file), self.a_bytes)
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them in a digest: "," within a side, "|" and ";" behind it
        self.a_text, self.b_text = (
            np.array([[b"%d%s" % (i, s) for i in range(len(x))] for s in seps], dtype=object)
            for x, seps in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))))
        # what was used of late, and before that
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}

    @classmethod
    def load(cls, a_file: str, b_file: str) -> Tokenizers:
        if (a_file, b_file) not in cls.loaded:
            cls.loaded[a_file, b_file] = cls(a_file, b_file)
        return cls.loaded[a_file, b_file]

    def _joined(self, stretches: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Stretches that begin at safe places, encoded as one text behind a word of its own
        and cut apart by their bytes; one by one where the bytes don't match."""
        text = " a" + "".join(stretches)
        raw = text.encode()
        of_a = self.fast.encode_ordinary(text) if self.fast else self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = (np.array(of_a, dtype=np.int32),
               np.array(self.b.encode(text[1:]), dtype=np.int32))
        if any(b"".join([t[i] for i in x.tolist()]) != raw for x, t in zip(ids, (self.a_bytes, self.b_bytes))):
            if len(stretches) == 1:
                return [None]
            return [r for s in stretches for r in self._joined([s])]
        at = np.cumsum([2] + [len(s.encode()) for s in stretches])
        sides = []
        for x, lens in zip(ids, (self.a_len, self.b_len)):
            cut = (4 * np.searchsorted(np.cumsum(lens[x]), at, "right")).tolist()
            side = x.tobytes()
            sides.append([side[i:j] for i, j in zip(cut, cut[1:])])
        return list(zip(*sides))

    def _learn(self, new: list[str]) -> dict:
        runs, size = [[]], 0
        for s in new:
            # the ends of a text may be white space, which a neighbour would change
            if s[1:2].isspace() or s[-1].isspace() or "▁" in s:
                runs.insert(0, [s])
                continue
            runs[-1].append(s)
            size += len(s)
            if size > 8192:
                runs.append([])
                size = 0
        return {s: r for run in runs if run for s, r in zip(run, self._joined(run))}

    def encode(self, parts: list[list[str]]) -> list[tuple[bytes, bytes] | None]:
        """Each list of stretches -> its ids as int32 bytes (A, B), None if a byte differs."""
        if len(self.kept) > KEPT:
            self.kept, self.before = {}, self.kept
        need = [s for s in set().union(*parts) if s not in self.kept]
        known = self.kept
        known.update((s, self.before[s]) for s in need if s in self.before)
        new = self._learn([s for s in need if s not in self.before])
        known.update(new)
        out = []
        for p in parts:
            got = list(map(known.__getitem__, p))
            out.append(None if None in got else (b"".join(map(itemgetter(0), got)), b"".join(map(itemgetter(1), got))))
        for s in new:
            if len(s) > KEPT_BYTES:
                del known[s]
        return out


def stretches(text: str) -> list[str]:
    """A blank and the text, cut at every safe place."""
    if "\0" not in text and "▁" not in text and len(text.split()) == text.count(" ") + text.count("\n") + 1:
        # every white space is one blank or line break between words: all are safe
        return ("\0 " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")[1:]
    return SAFE.split(" " + text)


# ---- fragments ---------------------------------------------------------------------------

Side = list  # of (id, byte offset of its end)


@dataclass
class Fragment:
    """``cut`` False: all tokens are in ``head``. Else ``head`` ends at the first cut and
    ``tail`` begins behind the last one; the groups between have left."""
    cut: bool = False
    head: tuple[Side, Side] = field(default_factory=lambda: ([], []))
    tail: tuple[Side, Side] = field(default_factory=lambda: ([], []))


Group = tuple[Side, Side]


def _closed(a: Side, b: Side) -> tuple[list[Group], Group]:
    """Tokens from one offset on -> groups that end at common ends, and the rest."""
    common = {e for _, e in a} & {e for _, e in b}
    groups, i, j = [], 0, 0
    for cut in sorted(common):
        ni, nj = i, j
        while a[ni][1] != cut:
            ni += 1
        while b[nj][1] != cut:
            nj += 1
        groups.append((a[i:ni + 1], b[j:nj + 1]))
        i, j = ni + 1, nj + 1
    return groups, (a[i:], b[j:])


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, list[Group]]:
    """The fragment of both ranges, and the groups that their meeting closed, in order."""
    open_ = left.tail if left.cut else left.head
    groups, rest = _closed(open_[0] + right.head[0], open_[1] + right.head[1])
    if left.cut:
        return Fragment(True, left.head, right.tail if right.cut else rest), groups
    if not groups:
        return Fragment(False, rest), []
    return Fragment(True, groups[0], right.tail if right.cut else rest), groups[1:]


def group_links(g: Group) -> list[tuple[int, int]]:
    """Id pairs of overlapping tokens of a closed group: one a stretch between ends."""
    a, b, i, j, out = g[0], g[1], 0, 0, []
    while i < len(a):
        out.append((a[i][0], b[j][0]))
        ea, eb = a[i][1], b[j][1]
        i, j = i + (ea <= eb), j + (eb <= ea)
    return out


def group_text(g: Group) -> bytes:
    return b"%s|%s;" % (b",".join(b"%d" % i for i, _ in g[0]), b",".join(b"%d" % i for i, _ in g[1]))


@dataclass
class Closed:
    """Closed groups of neighbouring tokens, as arrays: ends of groups, digest parts (A and
    B tokens in group order), and links (end, id pair)."""
    cuts: np.ndarray
    parts: np.ndarray
    link_end: np.ndarray
    link: np.ndarray


def close(tok: Tokenizers, a: np.ndarray, ae: np.ndarray, b: np.ndarray, be: np.ndarray) -> Closed:
    """Tokens of both sides over one stretch of bytes that begins and ends with a cut."""
    lo, size = ae[0] - len(tok.a_bytes[a[0]]), ae[-1] - ae[0] + len(tok.a_bytes[a[0]])
    ae, be = ae - lo, be - lo
    # marks by byte offset: token ends of both sides, and their running counts
    in_a, in_b = np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=bool)
    in_a[ae], in_b[be] = True, True
    cut = in_a & in_b
    cuts, ends = np.flatnonzero(cut), np.flatnonzero(in_a | in_b)
    a_upto, b_upto, cut_upto = (np.cumsum(x, dtype=np.int32) for x in (in_a, in_b, cut))
    ga, gb = cut_upto[ae] - cut[ae], cut_upto[be] - cut[be]
    # A tokens of a group stand behind the B tokens of the groups before, B tokens behind its A tokens
    b_before = np.concatenate([[0], b_upto[cuts]])
    parts = np.empty(len(a) + len(b), dtype=object)
    parts[np.arange(len(a)) + b_before[ga]] = tok.a_text[cut[ae].view(np.int8), a]
    parts[np.arange(len(b)) + a_upto[cuts][gb]] = tok.b_text[cut[be].view(np.int8), b]
    pair = a[a_upto[ends] - in_a[ends]].astype(np.int64) << 32 | b[b_upto[ends] - in_b[ends]]
    return Closed(cuts + lo, parts, ends + lo, pair)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return x[at], np.diff(at, append=len(x))


# ---- documents of one range, block by block ----------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack(x: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


@dataclass
class Aligned:
    """Documents aligned in step: counts per document, digests, distinct id pairs, and per
    document how many, which and how often."""
    counts: np.ndarray
    sha: list[str]
    pairs: np.ndarray
    deg: np.ndarray
    idx: np.ndarray
    mult: np.ndarray


def align_texts(tok: Tokenizers, texts: list[str | None]) -> Aligned:
    enc = tok.encode([stretches(t) if t else [] for t in texts])
    enc = [e if t and e else (b"", b"") for t, e in zip(texts, enc)]
    a, b = (np.frombuffer(b"".join(e[s] for e in enc), dtype=np.int32) for s in (0, 1))
    na, nb = (np.array([len(e[s]) // 4 for e in enc], dtype=np.int64) for s in (0, 1))
    n = len(texts)
    if not len(a):
        none = np.zeros(0, dtype=np.int64)
        return Aligned(np.zeros((4, n), dtype=np.int64), [""] * n, none, np.zeros(n, dtype=np.int64), none, none)
    ae, be = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    c = close(tok, a, ae, b, be)
    # a document's bytes end where its last token does; documents without tokens end nowhere else
    end = np.concatenate([[0], ae])[np.cumsum(na)]
    groups = np.diff(np.searchsorted(c.cuts, end, "right"), prepend=0)
    links = np.diff(np.searchsorted(c.link_end, end, "right"), prepend=0)
    at = np.concatenate([[0], np.cumsum(na + nb)])
    sha = [hashlib.sha256(b"".join(c.parts[i:j].tolist())[:-1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:])]
    pairs = counted(c.link)[0]
    both, mult = counted(np.repeat(np.arange(n) * len(pairs), links) + np.searchsorted(pairs, c.link))
    deg = np.bincount(both // len(pairs), minlength=n)
    return Aligned(np.stack([na, nb, groups, links]), sha, pairs, deg, both % len(pairs), mult)


BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "sha array<string>, deg array<int>, idx binary, mult binary, pairs binary")


def _block_row(no: int, ids: list, done: list[Aligned]) -> pa.RecordBatch:
    pairs = counted(np.concatenate([d.pairs for d in done]))[0]
    idx = np.concatenate([np.searchsorted(pairs, d.pairs)[d.idx] for d in done]).astype(np.uint32)
    counts = np.concatenate([d.counts for d in done], axis=1)
    cols = [pa.array([no], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
            *(pa.array([c], pa.list_(pa.int64())) for c in counts),
            pa.array([[s for d in done for s in d.sha]], pa.list_(pa.string())),
            pa.array([np.concatenate([d.deg for d in done]).astype(np.int32)], pa.list_(pa.int32())),
            *(pa.array([_pack(x)], pa.binary()) for x in (
                idx, np.concatenate([d.mult for d in done]).astype(np.uint32), pairs))]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCKS.split(", ")])


def _blocks(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, t) -> a row per about ``BLOCK`` bytes of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, first = Tokenizers.load(a_file, b_file), TaskContext.get().partitionId() << 32
        ids, done, texts, step, size, no = [], [], [], 0, 0, 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                step += len(t or "") + 16
                if step >= STEP:
                    done.append(align_texts(tok, texts))
                    size, texts, step = size + step, [], 0
                if size >= BLOCK:
                    yield _block_row(first + no, ids, done)
                    ids, done, size, no = [], [], 0, no + 1
        if texts:
            done.append(align_texts(tok, texts))
        if done:
            yield _block_row(first + no, ids, done)

    return docs.mapInArrow(run, BLOCKS)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, idx, pair, docs): a block's distinct id pairs and how many of its documents
    hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, idx, pairs in zip(*(b.column(i).to_pylist() for i in range(3))):
                pairs = _unpack(pairs, np.int64)
                docs = np.bincount(_unpack(idx, np.uint32), minlength=len(pairs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), no)), pa.array(np.arange(len(pairs), dtype=np.int32)),
                     pa.array(pairs), pa.array(docs.astype(np.int64))], names=["block", "idx", "pair", "docs"])

    return blocks.select("block", "idx", "pairs").mapInArrow(run, "block long, idx int, pair long, docs long")


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def _score_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's row with the corpus counts of its pairs -> a row per document."""
    idx, mult = (_unpack(left.column(c)[0].as_py(), np.uint32).astype(np.int64) for c in ("idx", "mult"))
    deg = left.column("deg").combine_chunks().flatten().to_numpy()
    docs, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=np.int64)
    at = right.column("idx").to_numpy()
    docs[at], best[at] = right.column("docs").to_numpy(), right.column("best").to_numpy()
    doc = np.repeat(np.arange(len(deg)), deg)
    sums = []
    for w in (best, docs):  # exact: running sums of integers, cut at documents
        run = np.concatenate([[0], np.cumsum(mult * w[idx])])
        ends = np.cumsum(deg)
        sums.append(pa.array(run[ends] - run[ends - deg]) if len(doc) else pa.array(np.zeros(len(deg), dtype=np.int64)))
    flat = lambda c: left.column(c).combine_chunks().flatten()
    return pa.table([flat("doc_id"), flat("n_a"), flat("n_b"), flat("n_groups"), flat("n_links"), *sums, flat("sha")],
                    names=[x.split()[0] for x in RESULT.split(", ")])


# ---- documents of several ranges -----------------------------------------------------------

def _ranges(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, t) -> (key, doc_id, at, t): stretches joined to ranges of about
    ``width`` bytes; at is the byte offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at, part, size = 0, [], 0
                for s in [*stretches(t.as_py()), None]:
                    if size >= width or s is None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key], pa.int64()), pa.array([i], pa.int64()), pa.array([at], pa.int64()),
                             pa.array(["".join(part)], pa.string())], names=["key", "doc_id", "at", "t"])
                        at, part, size = at + size, [], 0
                    if s is not None:
                        part.append(s)
                        size += len(s.encode())

    return docs.mapInArrow(run, "key long, doc_id long, at long, t string")


_OPEN = ["head_a", "head_ae", "head_b", "head_be", "tail_a", "tail_ae", "tail_b", "tail_be"]
FRAGMENTS = ("key long, at long, ok boolean, n_a long, n_b long, n_groups long, n_links long, cut boolean, "
             + ", ".join(f"{c} array<{'long' if c.endswith('e') else 'int'}>" for c in _OPEN)
             + ", pair array<long>, mult array<int>, text array<struct<at: long, no: int, t: binary>>")
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32())}
_TEXT = pa.list_(pa.struct([("at", pa.int64()), ("no", pa.int32()), ("t", pa.binary())]))


def _fragment_rows(rows: list[dict]) -> pa.Table:
    names = [x.split()[0] for x in FRAGMENTS.split(", text ")[0].split(", ")]
    kinds = [_TYPES[x.split()[1]] for x in FRAGMENTS.split(", text ")[0].split(", ")]
    return pa.table([*(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)),
                     pa.array([r["text"] for r in rows], _TEXT)], names=[*names, "text"])


def _opened(f: Fragment) -> dict:
    out = {"cut": f.cut}
    for name, (a, b) in (("head", f.head), ("tail", f.tail)):
        out |= {f"{name}_a": [i for i, _ in a], f"{name}_ae": [e for _, e in a],
                f"{name}_b": [i for i, _ in b], f"{name}_be": [e for _, e in b]}
    return out


def _of_row(r: dict) -> Fragment:
    side = lambda n: (list(zip(r[f"{n}_a"], r[f"{n}_ae"])), list(zip(r[f"{n}_b"], r[f"{n}_be"])))
    return Fragment(r["cut"], side("head"), side("tail"))


def _sliced(at: int, text: bytes) -> list[dict]:
    return [{"at": at, "no": i, "t": text[s:s + SLICE]} for i, s in enumerate(range(0, len(text), SLICE))]


def fragment_row(tok: Tokenizers, key: int, at: int, ok: bool, a: np.ndarray, ae: np.ndarray, b: np.ndarray,
                 be: np.ndarray) -> dict:
    """The fragment of the tokens dealt to one range, its closed groups as digest slices,
    distinct links and counts."""
    side = lambda x, e: list(zip(x.tolist(), e.tolist()))
    cuts = np.intersect1d(ae, be, assume_unique=True)
    row = {"key": key, "at": at, "ok": ok, "n_a": len(a), "n_b": len(b), "n_groups": 0, "n_links": 0,
           "pair": [], "mult": [], "text": []}
    if not len(cuts):
        return row | _opened(Fragment(False, (side(a, ae), side(b, be))))
    lo, hi = cuts[0], cuts[-1]
    ia, ja, ib, jb = (np.searchsorted(x, c, "right") for x in (ae, be) for c in (lo, hi))
    f = Fragment(True, (side(a[:ia], ae[:ia]), side(b[:ib], be[:ib])), (side(a[ja:], ae[ja:]), side(b[jb:], be[jb:])))
    if len(cuts) > 1:
        c = close(tok, a[ia:ja], ae[ia:ja], b[ib:jb], be[ib:jb])
        pair, mult = counted(c.link)
        row |= {"n_groups": len(c.cuts), "n_links": len(c.link), "pair": pair.tolist(), "mult": mult.tolist(),
                "text": _sliced(int(lo), b"".join(c.parts.tolist()))}
    return row | _opened(f)


def _fragments(ranges: DataFrame, a_file: str, b_file: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, none = Tokenizers.load(a_file, b_file), np.zeros(0, dtype=np.int32)
        for batch in batches:
            for key, at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py()
                enc = tok.encode([SAFE.split(t)])[0]
                if enc is None:
                    yield from _fragment_rows([fragment_row(tok, key, at, False, none, none, none, none)]).to_batches()
                    continue
                a, b = (np.frombuffer(x, dtype=np.int32) for x in enc)
                ae, be = at + np.cumsum(tok.a_len[a]), at + np.cumsum(tok.b_len[b])
                # a range much longer than width: tokens go where they start
                for s in range(at, int(ae[-1]), width):
                    e = s + width if s + 2 * width <= ae[-1] else int(ae[-1])
                    i, j = (slice(*np.searchsorted(x - n[y], (s, e))) for x, n, y in ((ae, tok.a_len, a), (be, tok.b_len, b)))
                    yield from _fragment_rows([fragment_row(tok, key, s, True, a[i], ae[i], b[j], be[j])]).to_batches()
                    if e == ae[-1]:
                        break

    return ranges.select("key", "at", "t").mapInArrow(run, FRAGMENTS)


def _fold(t: pa.Table) -> pa.Table:
    """Neighbouring fragments -> one, with what their meetings closed."""
    rows = sorted(t.to_pylist(), key=lambda r: r["at"])
    f, out = Fragment(), {"key": rows[0]["key"], "at": rows[0]["at"], "n_groups": 0, "n_links": 0, "text": []}
    links: dict[int, int] = {}
    for r in rows:
        f, groups = compose(f, _of_row(r))
        for g in groups:
            found = group_links(g)
            out["n_groups"] += 1
            out["n_links"] += len(found)
            # in the order of the ends, like the digests of ranges
            out["text"] += _sliced(min(g[0][0][1], g[1][0][1]) - 1, group_text(g))
            for a, b in found:
                links[a << 32 | b] = links.get(a << 32 | b, 0) + 1
    out |= {"ok": all(r["ok"] for r in rows), "n_a": sum(r["n_a"] for r in rows), "n_b": sum(r["n_b"] for r in rows),
            "pair": list(links), "mult": list(links.values())}
    return _fragment_rows([out | _opened(f)])


def _last(t: pa.Table) -> pa.Table:
    """The fragment of a whole document: its prefix is the first group."""
    row = t.to_pylist()[0]
    f, links = _of_row(row), {}
    row |= _opened(Fragment()) | {"n_groups": 0, "n_links": 0, "n_a": 0, "n_b": 0, "pair": [], "mult": [], "text": []}
    if f.cut:
        found = group_links(f.head)
        for a, b in found:
            links[a << 32 | b] = links.get(a << 32 | b, 0) + 1
        row |= {"n_groups": 1, "n_links": len(found), "pair": list(links), "mult": list(links.values()),
                "text": _sliced(-1, group_text(f.head))}
    return _fragment_rows([row])


def _folded(ranges: DataFrame, a_file: str, b_file: str, width: int) -> DataFrame:
    """All rows with closed groups: ranges, every level of the tree, and the last group.
    n_a, n_b and ok count on the rows of ranges alone (leaf true)."""
    level = written(_fragments(ranges, a_file, b_file, width), "fragments")
    parts = level.withColumn("leaf", F.lit(True))
    end = ranges.agg(F.max("at")).first()[0] or 0
    while True:
        width *= FAN
        part = (F.col("at") / width).cast("long")
        open_ = level.withColumns({c: F.array().cast(t) for c, t in level.dtypes if c in ("pair", "mult", "text")})
        level = written(open_.groupBy("key", part).applyInArrow(_fold, FRAGMENTS), "fragments")
        parts = parts.unionByName(level.withColumn("leaf", F.lit(False)))
        if width > end:
            break
    last = level.groupBy("key").applyInArrow(_last, FRAGMENTS)
    return parts.unionByName(last.withColumn("leaf", F.lit(False)))


def _digests(parts: DataFrame) -> DataFrame:
    """(key, sha): digest slices of a document in order, streamed through one hash."""
    rows = parts.select("key", F.explode("text").alias("x")).select("key", "x.at", "x.no", "x.t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, last, out = None, None, b"", []

        def done() -> pa.RecordBatch:
            h.update(last[:-1])
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "sha"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if h:
                        yield done()
                    key, h, last = k, hashlib.sha256(), b""
                h.update(last)
                last = t
        if h:
            yield done()

    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "key").sortWithinPartitions("key", "at", "no").select("key", "t").mapInArrow(
        run, "key long, sha string")


# ---- the operator --------------------------------------------------------------------------

def _counted(pair_docs: DataFrame) -> DataFrame:
    """(pair, docs) partial counts -> (pair, docs, best): best marks the pairs whose count is
    the highest of their A id."""
    total = pair_docs.groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(W.partitionBy(F.shiftright("pair", 32)))
    return total.withColumn("best", (F.col("docs") == most).cast("long"))


def _aligned(docs: DataFrame, doc_id: str, text: str, a_file: str, b_file: str,
             width: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    one: Column = F.coalesce(F.octet_length("t"), F.lit(0)) < width
    blocks = written(_blocks(rows.filter(one), a_file, b_file), "blocks")
    short = written(_block_pairs(blocks), "block-pairs")

    # one number a row, kept in a table: equal rows and rows without id stay apart
    long = rows.filter(~one).withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "t")
    ranges = written(_ranges(long, width), "ranges")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = written(_folded(ranges.repartition(n, "key", "at"), a_file, b_file, width), "parts")
    per = parts.groupBy("key").agg(
        F.bool_and("ok").alias("ok"), *(F.sum(F.when(F.col("leaf"), F.col(c)).otherwise(0)).alias(c) for c in ("n_a", "n_b")),
        F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"))
    per = written(per.join(ranges.filter("at = 0").select("key", "doc_id"), "key"), "long")
    held = parts.join(per.filter("ok").select("key"), "key", "left_semi").select(
        "key", F.explode(F.arrays_zip("pair", "mult")).alias("x")).groupBy("key", F.col("x.pair").alias("pair")).agg(
        F.sum("x.mult").alias("mult"))
    held = written(held, "long-pairs")

    counts = written(_counted(short.select("pair", "docs").unionAll(held.select("pair", F.lit(1).cast("long")))), "pair-counts")
    back = short.select("block", "idx", "pair").join(counts, "pair").select("block", "idx", "docs", "best")
    of_blocks = blocks.drop("pairs").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        lambda left, right: _score_block(left, right), RESULT)
    sums = held.join(counts, "pair").groupBy("key").agg(
        F.sum(F.col("mult") * F.col("best")).alias("n_best"), F.sum(F.col("mult") * F.col("docs")).alias("count_sum"))
    own = per.join(sums, "key", "left").join(_digests(parts), "key", "left")
    zero = lambda c: F.when(F.col("ok"), F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long").alias(c)
    of_long = own.select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                         F.when(F.col("ok"), F.coalesce("sha", F.lit(""))).otherwise("").alias("groups_sha256"))
    return of_blocks.unionByName(of_long), counts


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE,
          b_file: str = B_FILE, width: int = RANGE) -> DataFrame:
    """A row per row of ``docs``: token, group and link counts, links that are the commonest
    of their A id, summed document counts, and the SHA-256 of all groups. Tokenizer files
    are paths, or names of public files."""
    return _aligned(docs, doc_id, text, a_file, b_file, width)[0]


def pair_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE,
                b_file: str = B_FILE, width: int = RANGE) -> DataFrame:
    """The corpus-wide table of linked ids: (a_id, b_id, docs, best)."""
    counts = _aligned(docs, doc_id, text, a_file, b_file, width)[1]
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"),
                         F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "docs",
                         (F.col("best") == 1).alias("best"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_align": op11_align}
