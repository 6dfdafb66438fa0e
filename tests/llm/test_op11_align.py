import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from remedy.llm import op11_align as O


@pytest.fixture(scope="module")
def files():
    a = Tokenizer.from_file(public_tokenizers.path(O.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(O.B_FILE))


def gpt_bytes():
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, n = {}, 0
    for b in range(256):
        if b in keep:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return table


def tokens(files, text):
    """Whole text at once: [(id, start, end)] of A and of B, or none."""
    a, b = files
    if not text:
        return [], []
    byte = gpt_bytes()
    out = []
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ib = b.encode(text)
    for ids, raw in ((ia, [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]),
                     (ib, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib])):
        if b"".join(raw) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i, r in zip(ids, raw):
            side.append((i, at, at + len(r)))
            at += len(r)
        out.append(side)
    return out[0], out[1]


def brute(files, texts):
    docs, held = [], Counter()
    for t in texts:
        a, b = tokens(files, t)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        for c in cuts:
            ga = [str(i) for i, s, e in a if lo <= s and e <= c]
            gb = [str(i) for i, s, e in b if lo <= s and e <= c]
            groups.append(",".join(ga) + "|" + ",".join(gb))
            lo = c
        links, j0 = [], 0
        for i, s, e in a:
            while j0 < len(b) and b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        held.update(set(links))
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(ln), sum(held[x] == best[x[0]] for x in ln), sum(held[x] for x in ln),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, ln, g in docs]


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

TEXTS = [
    "The quick brown fox, jumping over dogs.\nIt's 12,345 o'clock — naïve café über Straße.",
    "The quick brown fox, jumping over dogs.\nIt's 12,345 o'clock — naïve café über Straße.",
    None, "", " ", "\n", "   leading and  double   blanks \t tab\r\nline\n\n\nend  ", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b has the blank mark", "日本語のテキスト。空白がない文章です" * 3, "é" * 50, "x" * 300, "\x00\x01 control \x1c here", "🙂🙂 👩‍👩‍👧 emoji",
    " ideographic　blank  line sep", "no-break \xa0 space\xa0there", "'s 've don't we'LL", "0123456789" * 20, "word",
]


def rows_of(df):
    return sorted((r.doc_id, *(r[c] for c in COLS)) for r in df.collect())


@pytest.mark.parametrize("width", [O.RANGE, 40])
def test_brute_force(spark, docs_of, files, width):
    rng = random.Random(width)
    texts = TEXTS + ["".join(rng.choice(["ab", "the", " ", " ", "  ", "\n", ".", "é", "7", "ß ", "ing", "'s", "—", "日"]) for _ in range(rng.randrange(400)))
                     for _ in range(40)]
    got = rows_of(O.align(docs_of([(i, t) for i, t in enumerate(texts)]), width=width))
    assert got == [(i, *b) for i, b in enumerate(brute(files, texts))]


def test_long_document_over_a_tree_and_one_digest(spark, docs_of, files):
    """More ranges than one level of the tree folds, digests of many slices, a stretch of
    several ranges without a safe place; the document is there twice."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(1500)) + " " + "Zürich-" * 120 + " " + " ".join(words)
    texts = [long, "short one", long, long + "▁", "日本" * 400]
    got = rows_of(O.align(docs_of([(i, t) for i, t in enumerate(texts)]), width=48))
    assert got == [(i, *b) for i, b in enumerate(brute(files, texts))]
    assert got[3][1:] == (0, 0, 0, 0, 0, 0, "")


def test_compose_is_associative(files):
    """Every way to bracket the fragments of a text gives the same open ends and groups."""
    text = "Straße naïve über 12,345 tokens—日本語 xyzzyqwert"
    a, b = tokens(files, text)
    rng = random.Random(1)
    size = len((" " + text).encode())
    for _ in range(200):
        at = [0, *sorted(rng.sample(range(1, size), 6)), size]
        parts = []
        for lo, hi in zip(at, at[1:]):
            f, closed = O.Fragment(), []
            head = tuple([(i, e) for i, s, e in side if lo <= s < hi] for side in (a, b))
            groups, rest = O._closed(*head)
            f = O.Fragment(True, groups[0], rest) if groups else O.Fragment(False, rest)
            parts.append((f, [(g[0][0][1], g) for g in groups[1:]] if groups else closed))
        left = parts[:]
        while len(left) > 1:
            k = rng.randrange(len(left) - 1)
            f, closed = O.compose(left[k][0], left[k + 1][0])
            left[k:k + 2] = [(f, left[k][1] + [(g[0][0][1], g) for g in closed] + left[k + 1][1])]
        f, closed = left[0]
        whole = [f.head] + [g for _, g in sorted(closed, key=lambda x: x[0])]
        assert whole == O._closed([(i, e) for i, _, e in a], [(i, e) for i, _, e in b])[0]
        assert f.tail == ([], [])
        assert O.compose(O.Fragment(), parts[0][0])[0] == parts[0][0] == O.compose(parts[0][0], O.Fragment())[0]


def test_empty_table_clashing_columns_and_null_ids(spark, docs_of, files):
    assert O.align(docs_of([]).select("doc_id", "text")).count() == 0
    rows = spark.createDataFrame([(None, "one two", 5, "x"), (None, "one two", 6, "y"), (3, "two", 7, "z")],
                                 "doc_id long, text string, key long, pair string")
    got = sorted(((r.doc_id or -1, *(r[c] for c in COLS)) for r in O.align(rows).collect()))
    want = brute(files, ["one two", "one two", "two"])
    assert got == [(-1, *want[0]), (-1, *want[1]), (3, *want[2])]


def test_pair_counts(spark, docs_of, files):
    texts = ["one two three", "two one", "three three three"]
    held = Counter()
    for t in texts:
        a, b = tokens(files, t)
        held.update({(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e})
    got = {(r.a_id, r.b_id): r.docs for r in O.pair_counts(docs_of([(i, t) for i, t in enumerate(texts)])).collect()}
    assert got == dict(held)
