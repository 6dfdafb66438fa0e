"""Scalar text functions (JVM-side expressions only; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------
# Bracket escapes used by the wiki dump, in the order they are decoded.
BRACKET_ESCAPES = [
    ("-LRB-", "("),
    ("-RRB-", ")"),
    ("-LSB-", "["),
    ("-RSB-", "]"),
    ("-LCB-", "{"),
    ("-RCB-", "}"),
    ("-COLON-", ":"),
]
# Reply of the answer synthesiser when no node was retrieved.
EMPTY_REPLY = "Empty Response"
SHORT_EMPTY_ANSWER = "The provided context is insufficient."
SHORT_ANSWER_PREFIX = "Response 1: "
# ---------------------------------------------------------------------------

# Letters/digits tokeniser shared by BM25, the gold prefilter and the reranker.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Word pieces that keep their trailing whitespace, so a run of them re-joins to
# an exact substring of the source text.
PIECE = r"\S+\s*"
# English articles and ASCII punctuation removed by answer normalisation
# (SQuAD-style normalisation, Rajpurkar et al. 2016).
ARTICLES = ["a", "an", "the"]
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_brackets(x) -> Column:
    """B1: seven literal rewrites."""
    out = _c(x)
    for src, dst in BRACKET_ESCAPES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def strip(x) -> Column:
    """Whitespace strip on both sides (tabs and newlines too, unlike ``trim``)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def clean_passage(x) -> Column:
    """B2: tab and newline to blank, bracket decoding, strip."""
    return strip(decode_brackets(F.translate(_c(x), "\t\n", "  ")))


def numbered_lines(x) -> Column:
    """Render text as the dump's ``lines`` field: line i becomes ``i<TAB>line``."""
    return F.array_join(
        F.transform(F.split(_c(x), "\n"), lambda s, i: F.concat(i.cast("string"), F.lit("\t"), s)),
        "\n",
    )


def split_sentences(lines) -> Column:
    """B4 (+T2): decode, strip, split on ``\\n<digits>\\t``; element 0 is always empty
    and is dropped here, so the result is indexed from 0."""
    t = strip(decode_brackets(_c(lines)))
    parts = F.split(F.concat(F.lit("\n"), t), r"\n\d+\t")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def canon_label(x) -> Column:
    """Remove blanks from a label (``NOT ENOUGH INFO`` -> ``NOTENOUGHINFO``)."""
    return F.replace(_c(x), F.lit(" "), F.lit(""))


def join_sentences(arr) -> Column:
    """Sentences joined with a blank, tabs to blanks, stripped."""
    return strip(F.translate(F.array_join(_c(arr), " "), "\t", " "))


def clean_short_answer(reply) -> Column:
    """Empty reply -> fixed sentence; remove every ``Response 1: ``."""
    r = strip(_c(reply))
    return F.when(r == F.lit(EMPTY_REPLY), F.lit(SHORT_EMPTY_ANSWER)).otherwise(
        F.replace(r, F.lit(SHORT_ANSWER_PREFIX), F.lit(""))
    )


def triple_query(s, r, o) -> Column:
    """Graph query string of one triple."""
    return F.format_string("[subject:%s] - [predicate:%s] - [object:%s]", _c(s), _c(r), _c(o))


def terms(x) -> Column:
    """Lower-cased letter/digit tokens, empties removed."""
    return F.filter(F.split(F.lower(_c(x)), TOKEN_SPLIT), lambda t: t != F.lit(""))


# English function words left out of a lexical index (the list that open-source
# search libraries share).
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with").split()


def index_terms(c) -> Column:
    """Terms of a lexical index or query: ``terms`` without stop words."""
    return F.filter(terms(c), lambda t: ~t.isin(STOP_WORDS))


def pieces(x) -> Column:
    """Whitespace-delimited pieces that keep trailing blanks (exact re-join)."""
    return F.regexp_extract_all(_c(x), F.lit(PIECE), 0)


def normalize_answer(x) -> Column:
    """Lower, drop ASCII punctuation, drop English articles, squeeze blanks."""
    s = F.regexp_replace(F.lower(_c(x)), ASCII_PUNCT, "")
    toks = F.filter(F.split(strip(s), r"\s+"),
                    lambda t: (t != F.lit("")) & ~t.isin(*ARTICLES))
    return F.array_join(toks, " ")


def exact_match(refs, cand) -> Column:
    """Any reference equals the candidate after normalisation."""
    nc = normalize_answer(cand)
    return F.coalesce(F.exists(_c(refs), lambda r: normalize_answer(r) == nc), F.lit(False))
