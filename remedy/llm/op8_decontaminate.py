"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are runs outside ASCII punctuation, digits kept, A-Z lower-cased. Each run of 13
consecutive words of a benchmark item is a window; an item of fewer words is one window.
Windows are deduplicated into a table of 64-bit hashes that is broadcast while its bytes are
within a bound. One scan of the documents hashes every token window, probes the table, and
verifies each hit word by word. Beyond the bound a bitmap of the hashes, of bounded size, is
broadcast instead; only token windows that it can't rule out are shuffled, with their words,
and joined by hash. Covered words are the union of the verified occurrences. DataFrame
functions only.

Defined cases: null or word-less text has no words and no hits; rows equal in id and text
are looked up once and all returned; null ids are ordinary values; a null item_id never
names an item but its windows still count as hits; repeated items count once per id; an
empty benchmark leaves every document clean; other columns pass through the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.llm.common import ascii_lower, written
from remedy.sources.tables import table

N = 13
# A document counts as contaminated from this share of its words: 1 in 20.
SHARE = 20
# Fixed value: what separates the words of the decontamination contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of windows that are broadcast, and bits of the bitmap beyond that (2^20 rows of 64).
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 1 << 26


def words(text: Column) -> Column:
    """Splitting at separators is about twice as fast as extracting the words."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _run_hash(w: str, at: Column, length: int) -> Column:
    """Hash of the ``length`` words of array column ``w`` from 0-based ``at``."""
    return F.xxhash64(*[F.get(F.col(w), at + F.lit(j)) for j in range(length)])


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, text) -> distinct (item_id, w array of words, len)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    return w.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("w")
    ).distinct().withColumn("len", F.size("w"))


def occurrences(docs: DataFrame, items: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits has one row per verified occurrence (doc_id, th, n_words,
    at, len, win), and one row with win null per document row. th: hash of the text."""
    spark = docs.sparkSession
    per_item = written(windows(items, n), "windows")
    sets = per_item.groupBy("w", "len").agg(F.collect_set("item_id").alias("items")).select(
        "w", "len", "items", F.sha2(F.to_json("w"), 256).alias("win"))
    by_len = F.lit(None).cast("long")
    for k in range(1, n + 1):
        by_len = F.when(F.col("len") == k, _run_hash("win_w", F.lit(0), k)).otherwise(by_len)
    sets = written(sets.withColumnRenamed("w", "win_w").select("len", by_len.alias("h"), "win_w", "items", "win"), "window-set")
    lengths = sorted(r[0] for r in sets.select("len").distinct().collect())  # at most n values
    # The one-element explode makes the words a column before anything uses them twice.
    # From there exploding, hashing and probing run in one generated loop that copies the
    # word array for hits only.
    tok = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array(words(F.col("text")))).alias("_dc_w"))
    size = sets.agg(F.sum(F.octet_length(F.to_json("win_w")))).first()[0] or 0
    find = _probe_windows if size <= BROADCAST_BYTES else _join_windows
    return find(tok, sets, lengths), sets


def _window_hash(lengths: list[int], first: Column | None = None) -> Column:
    """Hash of the ``len`` words of _dc_w from ``pos``; null where too few are left."""
    h = first if first is not None else F.when(F.lit(False), F.lit(0).cast("long"))
    for k in lengths:
        h = h.when((F.col("len") == k) & (F.col("pos") + k <= F.size("_dc_w")), _run_hash("_dc_w", F.col("pos"), k))
    return h


def _of_each_length(scan: DataFrame, lengths: list[int]) -> DataFrame:
    if len(lengths) == 1:
        return scan.withColumn("len", F.lit(lengths[0]))
    return scan.withColumn("len", F.explode(F.array(*[F.lit(k) for k in lengths or [0]])))


_HIT = ["doc_id", "th", "n_words", "at", "len", "win"]


def _probe_windows(tok: DataFrame, sets: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits by a broadcast of all windows."""
    # the mark of length 0 matches once in every document, after its last word, so each keeps a row
    mark = tok.sparkSession.range(1).select(
        F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.array().cast("array<string>").alias("win_w"),
        F.lit(None).cast("string").alias("win"))
    probe = F.broadcast(sets.select("len", "h", "win_w", "win").unionByName(mark).withColumnRenamed("len", "win_len"))
    scan = tok.select("doc_id", "th", "_dc_w", F.posexplode(F.array_append("_dc_w", F.lit(""))).alias("pos", "_dc_x"))
    n_w = F.size("_dc_w")
    end = F.when(F.col("pos") == n_w, F.when(F.col("len") == F.lit((lengths or [0])[0]), F.lit(0).cast("long")))
    hits = _of_each_length(scan, lengths).withColumn("h", _window_hash(lengths, end)).join(probe, "h").filter(
        (F.col("win_len") == F.when(F.col("pos") == n_w, 0).otherwise(F.col("len")))
        & (F.slice("_dc_w", F.col("pos") + 1, F.col("win_len")) == F.col("win_w")))
    return hits.select("doc_id", "th", n_w.cast("long").alias("n_words"),
                       (F.col("pos") + 1).cast("int").alias("at"), F.col("win_len").alias("len"), "win")


def _join_windows(tok: DataFrame, sets: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits where the windows are too many to broadcast: a bitmap of their hashes rules out
    most token windows in the scan; the others travel with their words, once, and meet the
    windows by hash."""
    slot = F.pmod("h", F.lit(BITMAP_BITS))
    place, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    bitmap = F.broadcast(sets.select(place.alias("_bm_i"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP_BITS}L) % 64 AS int))").alias("b"))
                         .groupBy("_bm_i").agg(F.bit_or("b").alias("_bm_b")))  # at most BITMAP_BITS / 64 rows
    scan = tok.select("doc_id", "th", "_dc_w", F.posexplode("_dc_w").alias("pos", "_dc_x"))
    scan = _of_each_length(scan, lengths).withColumn("h", _window_hash(lengths)).filter("h is not null")
    scan = scan.join(bitmap, place == F.col("_bm_i")).filter(F.getbit("_bm_b", bit) == 1)
    some = scan.select("doc_id", "th", F.size("_dc_w").cast("long").alias("n_words"), (F.col("pos") + 1).cast("int").alias("at"),
                       "len", "h", F.slice("_dc_w", F.col("pos") + 1, F.col("len")).alias("_dc_v"))
    found = some.join(sets.select("len", "h", "win_w", "win"), ["len", "h"]).filter(F.col("_dc_v") == F.col("win_w"))
    each = tok.select("doc_id", "th", F.size("_dc_w").cast("long").alias("n_words"), (F.size("_dc_w") + 1).alias("at"),
                      F.lit(0).alias("len"), F.lit(None).cast("string").alias("win"))
    return found.select(_HIT).unionByName(each.select(_HIT))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the contamination report, plus ``th``."""
    hits, sets = occurrences(docs, items, n)
    hits = written(hits, "hits")
    key = ["doc_id", "th"]
    base = hits.filter("len = 0").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    real = hits.filter("len > 0").select(*key, "at", "len", "win").distinct()
    # union of the occurrences: what each adds beyond the furthest end before it
    w = W.partitionBy(*key).orderBy("at", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    span = real.groupBy(*key, "at").agg(F.max("len").alias("len"))
    fresh = end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(w), F.lit(0)))
    covered = span.select(*key, F.greatest(fresh, F.lit(0)).alias("f")).groupBy(*key).agg(F.sum("f").alias("n_hit"))
    named = real.select(*key, "win").distinct().join(sets.select("win", F.explode("items").alias("item")), "win").groupBy(
        *key).agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    j = _by_key(_by_key(base, covered, key), named, key)
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return j.select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(items_col)), 256).alias("items_sha256"),
        "copies").withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _by_key(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = F.lit(True)
    for k in key:
        on = on & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in key])


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    n: int = N, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated rows. Only contaminated ids are carried to the join."""
    rep = decontaminate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, n, share)
    bad = rep.filter("contaminated").select(F.col("doc_id").alias("_dc_i"), F.col("th").alias("_dc_h")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(F.col("_dc_i")) & (F.xxhash64(docs[text]) == F.col("_dc_h")), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """``docs`` with the words of every occurrence removed: text becomes the words that
    are left, lower-cased and joined by a blank; documents without a hit keep their text."""
    hits, _ = occurrences(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, n)
    spans = hits.filter("len > 0").groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("at", "len")).alias("_dc_s")).select(
        F.col("doc_id").alias("_dc_i"), F.col("th").alias("_dc_h"), F.flatten(F.transform(
            "_dc_s", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))).alias("_dc_p"))
    j = docs.join(spans, docs[doc_id].eqNullSafe(F.col("_dc_i")) & (F.xxhash64(docs[text]) == F.col("_dc_h")), "left")
    kept = F.array_join(F.array_compact(F.transform(words(F.col(text)), lambda w, i: F.when(
        ~F.array_contains("_dc_p", i + 1), w))), " ")
    cols = [F.when(F.col("_dc_p").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else docs[c]
            for c in docs.columns]
    return j.select(*cols)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rep = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return rep.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {N}) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[i:i + k - 1] AS g, k FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w[i:i + k - 1] AS g, i, k FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT pos.doc_id, pos.i, pos.k, win.item_id FROM pos JOIN win ON pos.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE = {"op8_decontaminate": SQL}
