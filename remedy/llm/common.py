"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedy.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed value: words of the scoring, mixing and fingerprint contracts.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder and read back: cuts
    lineage, survives lost executors and is computed only once. ``wide``: rows of megabytes,
    each a Parquet page (else 100 rows or more are one, compressed and read at once)."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.options(**({"parquet.page.size.row.check.min": "1"} if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z only. ``lower`` is the fast path where the text is pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def held_out(doc_id: Column, mod: int) -> Column:
    """True where crc32 of the id as text leaves remainder 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == 0
