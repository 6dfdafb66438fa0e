"""Plug-in surface for model inference.

Every model is a black box called through an Arrow-batched iterator pandas UDF, so
a model loads once per Python worker (the "one model per process" singleton) and
sees whole batches. With no model configured the defaults read a column that
already holds the model output (embedding, NLI label, reply, ...).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST


@F.pandas_udf(ST.StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Unicode NFD normalisation (no built-in normalize in Spark SQL)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(ST.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC normalisation: composes what ``nfd`` decomposed."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def iterator_udf(loader: Callable[[], Callable[[pd.Series], pd.Series]], return_type) -> Callable:
    """Wrap ``loader() -> predict(series) -> series`` as an iterator pandas UDF: the
    loader runs once per task's Python worker, before the first batch (I7)."""

    @F.pandas_udf(return_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = loader()
        for b in batches:
            yield predict(b)

    return run


def iterator_udf2(loader, return_type) -> Callable:
    """Two-column variant: predict(a, b) -> series (pair scorers, NLI)."""

    @F.pandas_udf(return_type)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = loader()
        for a, b in batches:
            yield predict(a, b)

    return run


def embedder(loader=None, column: str | None = None) -> Callable[[Column], Column]:
    """Sentence embedder -> ARRAY<FLOAT>. Default: an existing vector column."""
    if loader is None:
        return lambda c: F.col(column) if column else c
    return iterator_udf(loader, ST.ArrayType(ST.FloatType()))


def nli_classifier(loader=None, column: str | None = None):
    """(premise, hypothesis) -> class id (0 entail, 1 neutral, 2 contradict)."""
    if loader is None:
        return lambda p, h: F.col(column)
    return iterator_udf2(loader, ST.IntegerType())


def triplet_extractor(loader=None, column: str | None = None):
    """Text -> linearised triplets (decoded natively by ``reply.decode_triples``)."""
    if loader is None:
        return lambda c: F.col(column)
    return iterator_udf(loader, ST.StringType())


def pair_scorer(loader=None):
    """I4: cross-encoder (query, passage) -> DOUBLE; used by ``rerank_topn``."""
    if loader is None:
        return None
    return iterator_udf2(loader, ST.DoubleType())


def generator(loader=None, column: str | None = None):
    """Rendered prompt -> reply text (answer model or judge). Default: a column."""
    if loader is None:
        return lambda c: F.col(column)
    return iterator_udf(loader, ST.StringType())
