import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from remedy.llm import op13_trie as O

CONV = "conv_id long, turn long, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(seqs):
    """{id: [(role, text)]} -> rows of the trie."""
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        kids = children[k]
        leaves[k] = sum(leaves[x] for x in kids) if kids else 1
        saved[k] = sum(saved[x] for x in kids) + ((len(members[k]) - 1) * words(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(s)] for c, s in turns.items()}
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + s[h:]
    return brute_trie(seqs) if seqs else []


def run(spark, rows):
    df = O.prefix_trie(O.rebuilt(O.written(O.turns(spark.createDataFrame(rows, CONV)), "turns"))).drop("name")
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def test_brute_force_small(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "a", None]), rng.choice(["x y", "x  z w", "", None, "x"])) for c in list(range(0, 70)) + [400, 401, 1999]
            for t in range(rng.randrange(1, 7)) if rng.random() < 0.9 or t == 0]
    rows = [r for r in rows if r[0] not in (20, 40)]  # heads that are absent
    rows += [(60, None, "system", "null turn first"), (None, 1, "user", "no conversation"), (7, 3, "user", "same"), (7, 3, "user", "same"),
             (8, 9, "a", "very long " * 5000)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    lone = [c for c in range(21, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "only") for c in lone]  # their head is absent, and their own turn is replaced
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 5 and got[0][5] == 1


def test_recursion_over_long_sequences(spark):
    """Sequences of up to 200 letters share prefixes of every length: blocks, cuts at half
    depth and grafts over several levels."""
    rng = random.Random(11)
    trunk = [("r", f"w{i} " * rng.randrange(4)) for i in range(200)]
    seqs = {}
    for c in range(60):
        k = rng.choice([0, 1, 15, 16, 17, 31, 32, 33, 48, 64, 65, 100, 128, 199])
        seqs[c] = trunk[:k] + [("r", f"own {c % 7} {i % 3}") for i in range(rng.choice([0, 0, 1, 16, 20, 70]))]
    for c in range(60, 70):
        seqs[c] = trunk
    rows = [(c, len(s), d + 1, r + x, words(x)) for c, s in seqs.items() for d, (r, x) in enumerate(s)]
    rows += [(c, 0, None, None, None) for c, s in seqs.items() if not s]
    df = spark.createDataFrame(rows, "c long, n long, d long, x string, w long")
    from pyspark.sql import functions as F
    trie = O.prefix_trie(df.withColumn("x", F.unhex(F.md5("x")))).drop("name")
    assert sorted(map(tuple, trie.collect()), key=lambda r: (r[1], r[0])) == brute_trie(seqs)


def test_one_conversation_holds_most_turns(spark):
    rows = [(5, t, "user", f"turn {t % 50}") for t in range(700)] + [(c, t, "a", "hi") for c in range(6, 30) for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "a b", 9, 9), (1, 1, "user", "c", 9, 9)]
    df = spark.createDataFrame(rows, CONV + ", c long, p long")
    assert O.turns(df).orderBy("p").select("c", "w").collect() == [(1, 2), (1, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_and_brute_force_on_the_given_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = sorted(con.sql(O.ORACLE["op13_trie"]).fetchall(), key=lambda r: (r[1], r[0]))
    got = O.op13_trie(spark, folder)
    assert got.columns == con.sql(O.ORACLE["op13_trie"]).columns
    got = sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[0]))
    assert got == want
    assert got == brute(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
