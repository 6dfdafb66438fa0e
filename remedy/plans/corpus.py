"""Registered corpus-preparation and text-function queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.functions import prompts as PR
from remedy.functions import reply as RP
from remedy.functions import text as T
from remedy.operators import corpus as C
from remedy.operators import lexical as L
from remedy.operators import retrieve as R
from remedy.plans import fixtures as X
from remedy.plans.index import VERSIONS, index_at, refresh_parts
from remedy.session import bounded_broadcast, cut_lineage
from remedy.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def decode_brackets(spark, sf):
    return _docs(spark, sf).select("doc_id", T.decode_brackets("text").alias("text"))


def clean_passage(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_passage("text").alias("text"))


def _sentences(spark, sf):
    return C.page_sentences(X.wiki_pages(spark, sf))


def split_sentences(spark, sf):
    return _sentences(spark, sf).select("page", "sent_idx", "sentence")


def join_sentences(spark, sf):
    p = X.wiki_pages(spark, sf)
    return p.select("page_id", T.join_sentences(T.split_sentences("lines")).alias("text"))


def label_sentence_col(label):
    m = F.create_map(*[x for kv in PR.LABEL_SENTENCES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, label)


def label_sentence(spark, sf):
    from remedy.plans.diagnosis import diagnosed
    d = diagnosed(spark, sf)
    return d.select("q", "gt_label", label_sentence_col(F.col("gt_label")).alias("ground_truth"))


def _parsed(spark, sf):
    r = X.replies(spark, sf)
    return r.withColumn("p", RP.parse_reply(F.col("reply")))


def parse_reply(spark, sf):
    return _parsed(spark, sf).select("conv_id", "turn", F.col("p.label").alias("label"),
                                     F.col("p.response").alias("response"), F.col("p.parse_ok").alias("parse_ok"))


def repair_reply(spark, sf):
    """B9 on broken replies: each reply's JSON with its end cut off, a comma too many or
    single-quoted keys, by turns, parsed after repair."""
    x = X.replies(spark, sf)
    js = F.concat(F.lit('{"label": "'), F.col("gt_label"), F.lit('", "response": "'), RP.json_escape(F.col("answer")), F.lit('"}'))
    k = (F.col("conv_id") + F.col("turn")) % 3
    broken = (F.when(k == 0, F.expr("substring(js, 1, length(js) - 2)"))
               .when(k == 1, F.concat(F.expr("substring(js, 1, length(js) - 1)"), F.lit(",}")))
               .otherwise(F.replace(F.replace(F.col("js"), F.lit('"label": "'), F.lit("'label': \"")),
                                    F.lit('"response":'), F.lit("'response' :"))))
    p = x.withColumn("js", js).withColumn("p", RP.parse_reply(broken))
    return p.select("conv_id", "turn", F.col("p.label").alias("label"), F.col("p.response").alias("response"),
                    F.col("p.parse_ok").alias("parse_ok"))


def eval_projection(spark, sf):
    """The judge's input: question, answer, the sentence of the gold label and the
    texts of the retrieved contexts in rank order (empty without any)."""
    p = _parsed(spark, sf).withColumn("q_id", F.col("conv_id") * 1000 + F.col("turn"))
    ctx = _retrieved(spark, sf, p).select("q_id", F.transform("retrieved", lambda x: x["text"]).alias("contexts"))
    out = p.join(ctx, "q_id", "left").select(
        "conv_id", "turn", "question", F.col("p.response").alias("answer"),
        label_sentence_col(F.col("gt_label")).alias("ground_truth"),
        F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    return out.na.fill("", ["question", "answer", "ground_truth"])


def clean_short_answer(spark, sf):
    return X.replies(spark, sf).select("conv_id", "turn", T.clean_short_answer("reply").alias("answer"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(task, name, tpl) for (task, name), tpl in PR.TEMPLATES.items()]
    return spark.createDataFrame(rows, "task string, template string, text string")


def render_prompt(spark, sf):
    qs = X.questions(spark, sf)
    ranked, txt = R.chunk_text_for(L.topk(index_at(spark, sf), qs, 5), _docs(spark, sf))
    packs = R.pack_context(ranked, txt, 2000)
    j = packs.join(qs, "q_id").crossJoin(F.broadcast(templates(spark)))  # six templates
    return j.select("q_id", "pack", "task", "template",
                    RP.render_prompt(F.col("text"), F.col("context"), F.col("question")).alias("prompt"))


def _linearised(spark, sf):
    f = X.facts(spark, sf)
    one = f.select(F.col("fact_id").alias("text_id"),
                   F.concat(F.lit("<s>"), RP.linearise(F.col("s"), F.col("r"), F.col("o")), F.lit("</s>")).alias("text"))
    # One text per region holding the triples of its nations (5 per region, fixed dimension).
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rg = table(spark, sf, "region").select("r_regionkey", "r_name")
    nr = n.join(F.broadcast(rg), n.n_regionkey == rg.r_regionkey)
    multi = (nr.groupBy("r_regionkey")
               .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", RP.linearise(
                   F.col("n_name"), F.lit("part of"), F.col("r_name")).alias("t")))).alias("_l"))
               .select((-1 - F.col("r_regionkey")).cast("long").alias("text_id"),
                       F.concat(F.lit("<s>"), F.array_join(F.transform("_l", lambda x: x["t"]), " "), F.lit("</s>")).alias("text")))
    return one.unionByName(multi)


def decode_triples(spark, sf):
    return RP.decode_triples(_linearised(spark, sf), "text_id", "text")


def triple_query(spark, sf):
    f = X.facts(spark, sf)
    return f.select("fact_id", T.triple_query("s", "r", "o").alias("query"))


def triple_export(spark, sf):
    """A10: one line per triple: source text || SUBJECT || PREDICATE || OBJECT."""
    f = X.facts(spark, sf)
    text = F.concat_ws(" ", "s", "r", "o")
    line = F.concat(text, F.lit(" || SUBJECT: "), F.col("s"), F.lit(" || PREDICATE: "), F.col("r"),
                    F.lit(" || OBJECT: "), F.col("o"), F.lit(" "))
    return f.select("fact_id", line.alias("line"))


def cap_triples(spark, sf):
    """C4: chunks of up to 16 customer facts (same nation, 16-key range) decoded,
    at most 10 triples kept per chunk."""
    f = X.facts(spark, sf).filter(F.col("kind") == 2)
    g = (f.withColumn("chunk", F.concat_ws(":", F.col("o"), (F.col("key") / 16).cast("long").cast("string")))
          .groupBy("chunk")
          .agg(F.array_sort(F.collect_list(F.struct("key", RP.linearise(F.col("s"), F.col("r"), F.col("o")).alias("t")))).alias("_l"))
          .select("chunk", F.array_join(F.transform("_l", lambda x: x["t"]), " ").alias("text")))
    d = RP.decode_triples(g, "chunk", "text")
    return d.filter(F.col("t_idx") < 10).select("chunk", "t_idx", "s", "r", "o")


def _evidence(spark, sf):
    return C.explode_evidence(X.claims(spark, sf))


def explode_evidence(spark, sf):
    return _evidence(spark, sf)


def inverse_evidence(spark, sf):
    return C.inverse_evidence(_evidence(spark, sf))


def evidence_semi(spark, sf):
    return C.evidence_pages(X.wiki_pages(spark, sf), _evidence(spark, sf)).select("page_id")


def evidence_sentences(spark, sf):
    ev = _evidence(spark, sf)
    pages = C.evidence_pages(X.wiki_pages(spark, sf), ev)
    return C.evidence_sentences(ev, C.page_sentences(pages))


def evidence_missing(spark, sf):
    ev = _evidence(spark, sf)
    pages = C.evidence_pages(X.wiki_pages(spark, sf), ev)
    return C.evidence_missing(ev, C.page_sentences(pages))


def split_range(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("q"))
    return C.split_range(e, "q")


def corpus_cap(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.clean_passage("text").alias("text"))
    return C.corpus_cap(d, "doc_id", 100_000)


def corpus_refresh(spark, sf):
    prim, sec = refresh_parts(spark, sf)
    return C.corpus_refresh(prim.select("doc_id"), sec.select("doc_id"), "doc_id", versions=VERSIONS, n=100, p=0.5, seed=42)


def corpus_counts(spark, sf):
    """Sizes per stage (each a count; the union is a handful of rows). The claims, which
    search the documents for every item, are made once."""
    claims = cut_lineage(X.claims(spark, sf))
    ev = C.explode_evidence(claims)
    stages = [
        ("documents", _docs(spark, sf)),
        ("unique_passages", X.passages(spark, sf)),
        ("chunks", R.chunk_windows(X.passages(spark, sf))),
        ("claims", claims.select("id").distinct()),
        ("evidence_rows", ev),
        ("evidence_pages", ev.select("page").distinct()),
        ("kb_pages", C.evidence_pages(X.wiki_pages(spark, sf), ev)),
    ]
    out = None
    for name, df in stages:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def epoch_order(spark, sf):
    return C.epoch_order(X.questions(spark, sf).select("q_id"), "q_id", epochs=2, seed=42)


def sample_replace(spark, sf):
    return C.sample_with_replacement(X.questions(spark, sf).select("q_id"), "q_id", 200, 42).select("draw", "q_id")


def nli_pairs(spark, sf):
    """(retrieved chunk, question) and (chunk, answer) pairs for the NLI hook:
    conversation questions retrieve BM25 top-3 chunks; the answer is the parsed reply."""
    from remedy.operators.diagnose import nli_pairs as pairs
    p = _parsed(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"),
                                  F.col("question"), F.col("p.response").alias("response"))
    c = p.join(_retrieved(spark, sf, p), "q_id").select("q_id", F.col("question").alias("query"), "response", "retrieved")
    return pairs(c, "q_id")


def _retrieved(spark, sf, questions):
    """(q_id, retrieved): the BM25 top-3 chunks of each question, in rank order."""
    ranked, txt = R.chunk_text_for(L.topk(index_at(spark, sf), questions.select("q_id", "question"), 3), _docs(spark, sf))
    # texts that no question retrieved are not shuffled
    top = txt.join(bounded_broadcast(ranked), ["doc_id", "pos"])
    return (top.groupBy("q_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "text", F.concat_ws(":", "doc_id", "pos").alias("node_id"),
                                                        "score"))).alias("_r"))  # k = 3 per query
              .select("q_id", F.transform("_r", lambda x: F.struct(x["text"].alias("text"), x["node_id"].alias("node_id"),
                                                               x["score"].alias("score"))).alias("retrieved")))


def normalize_id(spark, sf):
    """NFD Unicode normalisation through an Arrow UDF, of page ids and of whole page
    texts. The texts are composed again (NFC) and digested, which SQL can compare."""
    from remedy.functions.hooks import nfc, nfd
    p = X.wiki_pages(spark, sf)
    return p.select("page_id", nfd(F.col("page_id")).alias("norm_id"),
                    F.sha2(nfc(nfd(F.col("text"))), 256).alias("text_digest"))
