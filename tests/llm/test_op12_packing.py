import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from remedy.llm import op12_packing as O


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(O.FILE))


def check(rows, want, capacity):
    """Pieces rebuild every document, sequences are gapless and within the capacity; returns
    the sequences' lengths."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert sorted(docs) == sorted(want)
    for i, ids in want.items():
        got = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == ids
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
        for r in got:
            assert r.length == len(r.ids) > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    sizes = []
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
        sizes.append(sum(r.length for r in s))
    assert max(sizes) <= capacity
    return sizes


TEXTS = [None, "", " ", "Hello, World! It's 12 o'clock...\n\nnew  line", "<|endoftext|> and <|startoftext|>x<|endoftext|>",
         "naïve CAFÉ über STRASSE ẞ ΑΣ ΌΔΟΣ ﬁne é é. İstanbul", "日本語のテキスト 。空白", "🙂🙂👩‍👩‍👧 emoji\xa0here　there x",
         "\x1c\x1d control \x0b\x0c \x85 x", "a" * 500, "word " * 3000, "x-y_z/(a)[b]{c}", "don't we'LL 've", "ÿ×÷ß.,;:!?!? a.b", "same", "same"]


def test_exact_tokens_and_sequences(spark, docs_of, tok):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéèüß") for _ in range(rng.randrange(1, 12))) + rng.choice(["", ".", ",", "!?", "'s"]) for _ in range(400)]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(300)]
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    df = docs_of(list(enumerate(texts))).coalesce(2)
    for capacity in (2048, 64, 1):
        sizes = check(O.pack(df, capacity=capacity).collect(), want, capacity)
        assert all(s == capacity or s & (s - 1) == 0 for s in sizes)


def test_long_text_in_slices(spark, docs_of, tok):
    text = "Ein längerer Satz, der sich wiederholt. " * 40_000 + "x" * 2000
    assert len(text) > O.SLICE and b"".join(O.slices(text.encode())) == text.encode()
    rows = O.pack(docs_of([(1, text), (2, "short"), (3, text)])).collect()
    ids = tok.encode(text, add_special_tokens=False).ids + [1]
    check(rows, {1: ids, 2: tok.encode("short", add_special_tokens=False).ids + [1], 3: ids}, 2048)


def test_level_minimises_squared_counts():
    rng = random.Random(9)
    closed = []
    p = O.Packer(40, closed.append)
    squares = lambda c: int((c[1:40] ** 2).sum())
    for _ in range(3000):
        s = rng.choice([3, 7, 11, 13, 19, 20, 26, 33, 39, 40])
        before, h = p.count.copy(), p.level_for(s) if s < 40 else 0
        least = None
        for k in range(0, 40 - s + 1):
            if k == 0 or before[k]:
                c = before.copy()
                c[k] -= k > 0
                c[k + s] += 1
                grow = squares(c) - squares(before)
                least = grow if least is None else min(least, grow)
        p.place((0, 0, b"\0" * 4 * s))
        assert squares(p.count) - squares(before) == least, h
    assert all(sum(len(x[2]) // 4 for x in w) == 40 for w in closed)


def test_most_documents_stay_whole(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = O.pack(docs).collect()
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.doc_id] += 1
    cut = sum(n > (next(r for r in [r0 for r0 in rows if r0.doc_id == i]).doc_tokens - 1) // 2048 + 1 for i, n in list(pieces.items())[:200])
    assert cut <= 60
    assert sum(r.length for r in rows) == sum(len(e.ids) + 1 for e in tok.encode_batch([r.text or "" for r in docs.collect()], add_special_tokens=False))


def test_many_open_windows_land(monkeypatch):
    closed = []
    p = O.Packer(100, closed.append)
    for i in range(5000):
        p.place((i, 0, np.full(51, i, dtype="<u4").tobytes()))
    p.land()
    assert p.open == 0 and sum(len(x[2]) for w in closed for x in w) == 5000 * 51 * 4
    sizes = [sum(len(x[2]) // 4 for x in w) for w in closed]
    assert all(s == 100 or s & (s - 1) == 0 for s in sizes) and sizes.count(100) >= 2549


def test_empty_null_ids_and_clashing_columns(spark, docs_of):
    assert O.pack(docs_of([]).select("doc_id", "text")).count() == 0
    rows = O.pack(spark.createDataFrame([(None, "a b", 5, "x"), (None, "a b", 6, "y")], "doc_id long, text string, start long, ids string")).collect()
    assert len(rows) >= 2 and all(r.doc_id is None and r.doc_tokens == 3 for r in rows)
