import numpy as np
import xxhash
from pyspark.sql import functions as F

from remedy.llm import op9_simhash as o


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, k=2):
    par = list(range(len(prints)))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= k:
                par[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def near(rng, base, n):
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_links_of_planted_clusters(spark):
    rng = np.random.default_rng(11)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)] + [0, (1 << 64) - 1]
    for base in [0, (1 << 64) - 1, 123456789123456789, 1 << 63, int(rng.integers(0, 2**63))]:
        prints += near(rng, base, 60)
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = {(r.a, r.b) for r in o.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i)
            if bin(prints[i] ^ prints[j]).count("1") <= 2}
    assert got == want and len(want) > 200


def test_every_fingerprint_has_one_home_and_replicas_reach():
    fp = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.int64)
    i, anchor, home = o.replicas(fp)
    assert sorted(i[home]) == list(range(500))
    pairs = set(zip(i.tolist(), anchor.tolist()))
    homes = dict(zip(i[home].tolist(), anchor[home].tolist()))
    for k in range(500):  # flip two bits: the original must be among the replicas at the new home
        other = fp[k:k + 1] ^ np.int64((1 << (k % 60)) | (1 << ((k * 7 + 3) % 62)))
        _, a, h = o.replicas(other)
        assert (k, int(a[h][0])) in pairs
    assert len(homes) == 500


def test_documents_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, 60)) for _ in range(25)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:12]):
        w = t.split()
        w[3] = "changed"
        rows += [(10 + i, " ".join(w)), (300 + i, t.upper()), (300 + i, t.upper())]
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (None, texts[0]), (None, "lonely text without id here"),
             (8, "a\x85b c d"), (9, " ".join(rng.choice(vocab, 70_000)))]
    prints = [brute_print(t) for _, t in rows]
    want = brute_components(prints, [i for i, _ in rows])
    df = docs_of(rows).withColumn("fp", F.lit(1)).withColumn("label", F.lit(2))
    got = o.near_duplicates(df).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got], key=key) == sorted(
        [(d, p, c) for (d, _), p, c in zip(rows, prints, want)], key=key)
    kept = o.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == sorted({c for c in want if c is not None}) + [None] * sum(
        1 for t in {t for (d, t), c in zip(rows, want) if c is None})


def test_empty_table_and_hex(spark, docs_of):
    assert o.near_duplicates(docs_of([])).count() == 0 and o.keep_one(docs_of([])).count() == 0
    x = spark.createDataFrame([(5,), (-1,), (0,)], "fp long").select(o.hex16(F.col("fp")).alias("h")).collect()
    assert [r.h for r in x] == ["0" * 15 + "5", "f" * 16, "0" * 16]


def test_keep_one_of_each_component_where_ids_repeat_or_are_missing(spark, docs_of):
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10_000, 120)) for _ in range(4))
    # id 5 names three texts; that of component 1 is not kept, and the other two both are
    rows = [(1, a), (5, a + "\n"), (5, b), (5, c), (7, c), (None, d), (None, d + "\n"), (None, d)]
    near = {(r.doc_id, r.th): r.root for r in o.near_duplicates(docs_of(rows)).collect()}
    assert len(set(near.values())) == 4 and len(near) == 7
    got = sorted(((r.doc_id, r.text.strip()) for r in o.keep_one(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (5, c), (None, d)], key=str)
