"""The lexical index that all BM25 queries of an input share."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.functions import text as T
from remedy.operators import corpus as C
from remedy.operators import lexical as L
from remedy.operators import retrieve as R
from remedy.plans import fixtures as X
from remedy.session import scratch_path

VERSIONS = 3
LAYOUT = 2


def input_key(spark: SparkSession, sf: str, name: str, *params) -> str:
    """Digest of a table's files (path, size, time of change) and of the parameters: equal
    keys mean equal input, whatever session asks. One row per file is read."""
    m = "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    files = sorted(str(tuple(r)) for r in X.table(spark, sf, name).select(*m).distinct().collect())
    return hashlib.sha256(repr((files, params)).encode()).hexdigest()[:24]


def refresh_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """C5 input: (primary, secondary) passages (doc_id, text): English ones, and all others."""
    lang = X.table(spark, sf, "documents").select("doc_id", "lang")
    p = X.passages(spark, sf).join(lang, "doc_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return p.filter(english).select("doc_id", "text"), p.filter(~english).select("doc_id", "text")


def index_path(spark: SparkSession, sf: str) -> str:
    return scratch_path(spark, "lexical-" + input_key(
        spark, sf, "documents", R.CHUNK_SIZE, R.CHUNK_OVERLAP, T.STOP_WORDS, L.BLOCK_CHUNKS, LAYOUT))


def index_at(spark: SparkSession, sf: str, version: int = 0) -> L.Index:
    """The index of a corpus version, loaded where its deltas are there, else built and kept.
    Version 0 holds all passages. Versions 1 to 3 are the refreshed corpus: the primary
    passages, and every sample of secondary ones drawn up to then, a delta each."""
    path = index_path(spark, sf)
    if not L.has_deltas(spark, path, ["primary", "secondary"]):
        lang = X.table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").alias("_en"))
        delta = F.when(F.col("_en"), F.lit("primary")).otherwise(F.lit("secondary"))
        docs = X.passages(spark, sf).join(lang.hint("shuffle_hash"), "doc_id").select(delta.alias("delta"), "doc_id", "text")
        L.add_deltas(path, docs, {"primary": (0, None), "secondary": (0, 0)}, clustered=True)
    draws = {f"draw-{v}": (v, None) for v in range(1, VERSIONS + 1)}
    if version and not L.has_deltas(spark, path, list(draws)):
        _, sec = refresh_parts(spark, sf)
        drawn = C.refresh_draws(sec.select("doc_id"), "doc_id", VERSIONS)
        docs = drawn.join(sec, "doc_id").select(F.concat(F.lit("draw-"), F.col("draw").cast("string")).alias("delta"), "doc_id", "text")
        L.add_deltas(path, docs, draws)
    return L.open_index(spark, path, version)
