import hashlib
import re

import pytest
from pyspark.sql import functions as F

from remedy.llm import op8_decontaminate as o

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n=13):
    win = {}
    for item, t in items:
        w = WORDS.findall(lower(t))
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            win.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, named = WORDS.findall(lower(t)), set(), set()
        for k in {len(g) for g in win}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in win:
                    hit |= set(range(a, a + k))
                    named |= win[tuple(w[a:a + k])]
        ids = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def spark_rows(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rep = o.decontaminate(d, b).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return sorted((tuple(r) for r in rep.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


LONG = " ".join(f"w{i}x" for i in range(20)).replace("0", "a")
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi"), (2, "One two, THREE!"), (3, "solo"),
         (4, None), (5, "..."), (None, "null item words here"), (6, "One two, THREE!"), (6, "One two, THREE!"), (10, "the the the")]
DOCS = [(1, ITEMS[0][1].upper()), (2, "x " + ITEMS[0][1] + " y " * 300), (3, "one; two--three one two three"), (4, None), (5, ""), (6, "a b c"),
        (7, "solo Solo SOLO"), (8, "null item words here"), (9, "the the the the the"), (9, "the the the the the"), (None, "solo"),
        (11, "Émile one two"), (12, "beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi"), (12, "alpha beta"),
        (13, "z " * 100 + "solo " + "z " * 50), (14, "é" * 50_000 + " solo"), (15, ("the " * 20_000))]


def test_against_brute_force(spark):
    assert spark_rows(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_joined_where_windows_may_not_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(o, "BROADCAST_BYTES", -1)
    assert spark_rows(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert spark_rows(spark, DOCS[:4], []) == brute(DOCS[:4], [])


def test_joined_form_survives_a_crowded_bitmap(spark, monkeypatch):
    monkeypatch.setattr(o, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(o, "BITMAP_BITS", 64)
    assert spark_rows(spark, DOCS[:13], ITEMS) == brute(DOCS[:13], ITEMS)


def test_joined_form_shuffles_less_than_the_text(spark, monkeypatch):
    """Rows of the scan that leave for the join: those that the bitmap can't rule out."""
    monkeypatch.setattr(o, "BROADCAST_BYTES", -1)
    docs = [(i, " ".join(f"t{(i * 7919 + j * 31) % 50021}x" for j in range(1000))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + [(99, " ".join(docs[3][1].split()[100:120]))], "item_id long, text string")
    hits, _ = o.occurrences(d, items)
    rows = hits.filter("len > 0").collect()
    assert {r.doc_id for r in rows} == {3} and len(rows) == 8
    df = o.windows(items).count()
    assert df < 40
    plan = hits._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    exchanged = sum(len(r) for _, t in docs for r in [t])  # bytes of the texts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = hits.filter("len > 0").count() * 200  # 13 words and six numbers a row
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 2 * exchanged


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS[:6], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert spark_rows(spark, docs, items) == brute(docs, items)


def test_filters_keep_clean_rows_and_columns(spark, docs_of):
    df = docs_of([(i, t) for i, t in DOCS]).withColumn("pos", F.lit(1)).withColumn("h", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {(r[0], r[1]) for r in brute(DOCS, ITEMS) if r[5]}
    clean = o.clean_documents(df, items)
    assert clean.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None) == sorted(
        (i, t) for i, t in DOCS if i is not None and (i, len(WORDS.findall(lower(t)))) not in bad)
    cut = {(r.doc_id, r.text) for r in o.cut_spans(df, items).collect()}
    assert (6, "a b c") in cut and (7, "") in cut and (11, "Émile one two") in cut and (13, " ".join(["z"] * 150)) in cut


def test_plan_has_no_python(spark):
    d = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    plan = o.decontaminate(d, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
