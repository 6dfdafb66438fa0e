"""English suffix stemming (the Snowball rules for English, Porter 2001) in expressions.

A word is handed from step to step as one struct: ``w``, the offsets ``p1`` and ``p2`` where
its regions R1 and R2 begin, and ``done``. Steps are lambdas over an array of that one
struct, so every intermediate is computed once. Meant for distinct terms: the index stems
each term once and joins the result back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the published algorithm ---------------------------------
V = "[aeiouy]"
C = "[^aeiouy]"
R1_PREFIXES = "gener|commun|arsen"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
DOUBLES = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
STEP_4 = ("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion").split()
# -------------------------------------------------------------------------------


def _suffix(w: Column, suffixes) -> Column:
    """The longest of the suffixes that ``w`` ends in (a leftmost match is the longest), or ''."""
    return F.regexp_extract(w, "(?:" + "|".join(suffixes) + ")$", 0)


def _cut(w: Column, suffix: Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - F.length(suffix))


def _start(word: Column) -> Column:
    """Word -> the struct: consonant y as Y, and the regions."""
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")

    def regions(w: Column) -> Column:
        head = F.regexp_extract(w, f"^(?:{R1_PREFIXES}|{C}*{V}+{C})", 0)
        p1 = F.when(head == "", F.length(w)).otherwise(F.length(head))
        return F.struct(w.alias("w"), p1.alias("p1"))

    def second(s: Column) -> Column:
        rest = F.regexp_extract(F.substring(s["w"], s["p1"] + 1, F.length(s["w"])), f"^{C}*{V}+{C}", 0)
        p2 = F.when(rest == "", F.length(s["w"])).otherwise(s["p1"] + F.length(rest))
        return F.struct(s["w"].alias("w"), s["p1"].alias("p1"), p2.alias("p2"), F.lit(False).alias("done"))

    return F.transform(F.transform(F.transform(F.array(marked), lambda w: w), regions), second)


def _to(s: Column, w: Column, done: Column | None = None) -> Column:
    """The struct with the word ``w``, unless it is done."""
    return F.struct(F.when(s["done"], s["w"]).otherwise(w).alias("w"), s["p1"].alias("p1"), s["p2"].alias("p2"),
                    (s["done"] if done is None else s["done"] | done).alias("done"))


def _step_1a(s: Column) -> Column:
    w = s["w"]
    out = (F.when(w.endswith("sses"), _cut(w, F.lit("ss")))
            .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _cut(w, F.lit("ed"))).otherwise(_cut(w, F.lit("d"))))
            .when(w.rlike("(us|ss)$"), w)
            .when(w.rlike(f"{V}.+s$"), _cut(w, F.lit("s")))
            .otherwise(w))
    return _to(s, out)


def _after_1a(s: Column) -> Column:
    return _to(s, s["w"], s["w"].isin(AFTER_1A))


def _step_1b(s: Column) -> Column:
    w = s["w"]

    def by(x: Column) -> Column:
        suf, stem = x["suf"], x["stem"]
        mended = (F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
                   .when(stem.rlike(DOUBLES), _cut(stem, F.lit("x")))
                   .when((F.length(stem) == s["p1"]) & stem.rlike(SHORT), F.concat(stem, F.lit("e")))
                   .otherwise(stem))
        return (F.when(suf == "", w)
                 .when(suf.isin("eed", "eedly"), F.when(F.length(stem) >= s["p1"], F.concat(stem, F.lit("ee"))).otherwise(w))
                 .when(stem.rlike(V), mended).otherwise(w))

    parts = F.transform(F.array(_suffix(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"])),
                        lambda suf: F.struct(suf.alias("suf"), _cut(w, suf).alias("stem")))
    return _to(s, F.get(F.transform(parts, by), 0))


def _step_1c(s: Column) -> Column:
    return _to(s, F.regexp_replace(s["w"], "(.[^aeiouy])[yY]$", "$1i"))


def _mapped(s: Column, rules: dict[str, str], allowed) -> Column:
    """The longest suffix, if it lies in R1 and ``allowed`` (suffix, stem), by the rule for it."""
    w = s["w"]
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])

    def by(x: Column) -> Column:
        suf, stem = x["suf"], x["stem"]
        ok = (suf != "") & (F.length(stem) >= s["p1"]) & allowed(suf, stem)
        return F.when(ok, F.concat(stem, F.coalesce(F.element_at(table, suf), F.lit("")))).otherwise(w)

    parts = F.transform(F.array(_suffix(w, rules)), lambda suf: F.struct(suf.alias("suf"), _cut(w, suf).alias("stem")))
    return _to(s, F.get(F.transform(parts, by), 0))


def _step_2(s: Column) -> Column:
    return _mapped(s, STEP_2, lambda suf, stem: F.when(suf == "ogi", stem.endswith("l")).when(
        suf == "li", stem.rlike("[cdeghkmnrt]$")).otherwise(True))


def _step_3(s: Column) -> Column:
    return _mapped(s, STEP_3, lambda suf, stem: (suf != "ative") | (F.length(stem) >= s["p2"]))


def _step_4(s: Column) -> Column:
    return _mapped(s, dict.fromkeys(STEP_4, ""), lambda suf, stem: (F.length(stem) >= s["p2"]) & (
        (suf != "ion") | stem.rlike("[st]$")))


def _step_5(s: Column) -> Column:
    w = s["w"]
    stem = _cut(w, F.lit("x"))
    in1, in2 = F.length(stem) >= s["p1"], F.length(stem) >= s["p2"]
    out = (F.when(w.endswith("e") & (in2 | in1 & ~stem.rlike(SHORT)), stem)
            .when(w.endswith("ll") & in2, stem).otherwise(w))
    return _to(s, F.translate(out, "Y", "y"))


def english_stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    steps = _start(word)
    for step in (_step_1a, _after_1a, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5):
        steps = F.transform(steps, step)
    special = F.element_at(F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv]), word)
    done = F.get(F.transform(steps, lambda s: F.translate(s["w"], "Y", "y")), 0)
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(special, done))


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms."""
    return terms.filter("term is not null").select("term").distinct().select("term", english_stem(F.col("term")).alias("stem"))


# ---- the same rules for one word inside a task ---------------------------------------

#: a word that ends in none of these keeps its form
ENDINGS = tuple({"s", "ed", "ing", "y", "e", "ll", *STEP_2, *STEP_3, *STEP_4})
#: distinct words a worker remembers
MEMO = 200_000
_memo: dict[str, str] = {}
_find = {k: re.compile(v).search for k, v in {
    "p1": f"^(?:{R1_PREFIXES}|{C}*{V}+{C})", "p2": f"^{C}*{V}+{C}", "v": V, "ie": "(ied|ies)$", "keep": "(us|ss)$", "plural": f"{V}.+s$",
    "1b": "(?:eedly|ingly|edly|eed|ing|ed)$", "e": "(at|bl|iz)$", "doubles": DOUBLES, "short": SHORT, "li": "[cdeghkmnrt]$", "ion": "[st]$",
    "2": "(?:" + "|".join(STEP_2) + ")$", "3": "(?:" + "|".join(STEP_3) + ")$", "4": "(?:" + "|".join(STEP_4) + ")$"}.items()}


def _steps(word: str) -> str:
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    head = _find["p1"](w)
    p1 = head.end() if head else len(w)
    rest = _find["p2"](w[p1:])
    p2 = p1 + rest.end() if rest else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif _find["ie"](w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not _find["keep"](w) and _find["plural"](w):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := _find["1b"](w):
        stem = w[:m.start()]
        if m[0] in ("eed", "eedly"):
            w = stem + "ee" if len(stem) >= p1 else w
        elif _find["v"](stem):
            if _find["e"](stem):
                w = stem + "e"
            elif _find["doubles"](stem):
                w = stem[:-1]
            else:
                w = stem + "e" if len(stem) == p1 and _find["short"](stem) else stem
    w = re.sub("(.[^aeiouy])[yY]$", r"\1i", w)
    if (m := _find["2"](w)) and m.start() >= p1:
        stem = w[:m.start()]
        if stem.endswith("l") if m[0] == "ogi" else _find["li"](stem) if m[0] == "li" else True:
            w = stem + STEP_2[m[0]]
    if (m := _find["3"](w)) and m.start() >= p1 and (m[0] != "ative" or m.start() >= p2):
        w = w[:m.start()] + STEP_3[m[0]]
    if (m := _find["4"](w)) and m.start() >= max(p1, p2) and (m[0] != "ion" or _find["ion"](w[:m.start()])):
        w = w[:m.start()]
    stem = w[:-1]
    if w.endswith("e") and (len(stem) >= p2 or len(stem) >= p1 and not _find["short"](stem)) or w.endswith("ll") and len(stem) >= p2:
        w = stem
    return w


def stem_word(word: str) -> str:
    """``english_stem`` of one word, for tasks that meet words in arrays; remembered per worker
    in a bounded table."""
    if len(word) <= 2 or not word.endswith(ENDINGS):
        return word
    out = _memo.get(word)
    if out is None:
        if len(_memo) >= MEMO:
            _memo.clear()
        out = _memo[word] = SPECIAL.get(word) or _steps(word).replace("Y", "y")
    return out
