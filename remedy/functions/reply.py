"""Model-reply functions: JSON reply parsing (B9), prompt rendering (B11) and the
linearised-triplet decoder (B12). All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedy.functions import text as T

# ---- fixed values ----------------------------------------------------------------
EMPTY_LABEL = "NOTENOUGHINFO"
EMPTY_RESPONSE = "Context is not sufficient."
TRIPLET, SUBJ, OBJ = "<triplet>", "<subj>", "<obj>"
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>"]
# -----------------------------------------------------------------------------------

REPLY_SCHEMA = "label STRING, response STRING"


def json_escape(x: Column) -> Column:
    """Minimal JSON string escaping (backslash, quote, newline, tab, carriage return)."""
    s = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    s = F.replace(s, F.lit("\n"), F.lit("\\n"))
    s = F.replace(s, F.lit("\t"), F.lit("\\t"))
    return F.replace(s, F.lit("\r"), F.lit("\\r"))


def repair_json(js: Column) -> Column:
    """Mends what models commonly break in a JSON object: keys and values in single quotes,
    commas before a closing brace, and an end that is cut off (an open string is closed,
    then the braces). Applied to text that does not parse as it is."""
    s = F.regexp_replace(js, r"([{,]\s*)'([A-Za-z_]+)'\s*:", '$1"$2":')
    s = F.regexp_replace(s, r":\s*'([^'\"]*)'(\s*[,}])", ': "$1"$2')
    s = F.regexp_replace(s, r",\s*([}\]])", "$1")
    bare = F.regexp_replace(s, r"\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    outside = F.regexp_replace(F.concat(bare, F.when(quotes % 2 == 1, F.lit('"')).otherwise(F.lit(""))), r'"[^"]*"', "")
    missing = F.greatest(F.length(F.regexp_replace(outside, r"[^{]", "")) - F.length(F.regexp_replace(outside, r"[^}]", "")), F.lit(0))
    cut = F.when(quotes % 2 == 1, F.concat(F.regexp_replace(s, r"\\$", ""), F.lit('"'))).otherwise(
        F.regexp_replace(s, r",\s*$", ""))
    return F.concat(cut, F.repeat(F.lit("}"), missing.cast("int")))


def parse_reply(reply: Column) -> Column:
    """struct(label, response, parse_ok). The empty-reply marker maps to the
    fixed NOTENOUGHINFO answer; otherwise the outermost ``{...}`` span (fences and
    chatter around it are ignored) is parsed as JSON, after ``repair_json`` where it does
    not parse as it is. What then still does not parse keeps null fields and
    ``parse_ok = false`` (quarantine instead of failing the job)."""
    r = T.strip(reply)
    empty = r == F.lit(T.EMPTY_REPLY)
    span = F.regexp_extract(r, r"(?s)\{.*\}", 0)
    whole = (span != F.lit("")) & F.try_parse_json(span).isNotNull()
    # the end may be cut off: from the first brace on, without a closing fence
    rest = F.regexp_replace(F.regexp_extract(r, r"(?s)\{.*", 0), r"\s*```\s*$", "")
    js = F.when(whole, span).otherwise(repair_json(rest))
    ok = whole | ((rest != F.lit("")) & F.try_parse_json(js).isNotNull())
    p = F.from_json(F.when(ok, js), REPLY_SCHEMA)
    return F.struct(
        F.when(empty, F.lit(EMPTY_LABEL)).otherwise(p["label"]).alias("label"),
        F.when(empty, F.lit(EMPTY_RESPONSE)).otherwise(p["response"]).alias("response"),
        (empty | ok).alias("parse_ok"))


def render_prompt(template: Column, context: Column, query: Column) -> Column:
    """Literal placeholder substitution (templates contain literal braces)."""
    return F.replace(F.replace(template, F.lit("{context_str}"), context), F.lit("{query_str}"), query)


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^ | $", "")


def decode_triples(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Decode ``<triplet> subj <subj> obj <obj> relation`` sequences into rows
    (id, t_idx, p_idx, s, r, o). Special tokens are removed; text before the first
    ``<triplet>`` is ignored; one subject may carry several (object, relation)
    pairs; a ``<subj>`` segment without ``<obj>`` yields nothing (T23); a triple is
    kept only when subject, relation and object are all non-empty."""
    t = F.col(text_col)
    for tok in SPECIAL_TOKENS:
        t = F.replace(t, F.lit(tok), F.lit(""))
    segs = F.split(t, TRIPLET)
    x = df.select(id_col, F.posexplode(F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))).alias("t_idx", "seg"))
    parts = F.split("seg", SUBJ)
    y = x.select(id_col, "t_idx", F.element_at(parts, 1).alias("_s"),
                 F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("p_idx", "pair"))
    op = F.split("pair", OBJ)
    z = y.filter(F.size(op) >= 2).select(
        id_col, "t_idx", "p_idx",
        _squeeze(F.col("_s")).alias("s"),
        _squeeze(F.element_at(op, -1)).alias("r"),
        _squeeze(F.element_at(op, 1)).alias("o"))
    return z.filter((F.col("s") != "") & (F.col("r") != "") & (F.col("o") != ""))


def linearise(s: Column, r: Column, o: Column) -> Column:
    """Triplet-extractor output layout for one triple."""
    return F.concat(F.lit("<triplet> "), s, F.lit(" <subj> "), o, F.lit(" <obj> "), r)
