"""Derived inputs built from the given tables (see FIXTURES.md).

Every fixture is a lazy DataFrame over the parquet tables, so its work grows with
them. The same definitions are written in DuckDB SQL in ``plans/oracle_*.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remedy.functions import text as T
from remedy.sources.tables import table

# ---- fixed values: enumerations of the diagnosis outputs --------------------
CONSISTENCY_LEVELS = ["CONSISTENT", "CONFLICT", "MISSING", "EMPTYINPUT", "NOTRIPLETS"]
ANSWER_LABELS = ["SUPPORTS", "REFUTES", "NOTENOUGHINFO"]
RAW_ANSWER_LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]
ENTAILMENT_LEVELS = ["ENTAILMENT", "CONTRADICTION", "NEUTRAL"]
FAILURE_LABELS = [
    "NO_FAILURE",
    "WRONG_PREDICATE_FAILURE",
    "INSUFFICIENT_EVIDENCE_FAILURE",
    "WRONG_RESPONSE_FAILURE",
    "LABEL_EVIDENCE_MISMATCH_FAILURE",
]
N_ARMS = 11
# ---------------------------------------------------------------------------


def _levels(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def passages(spark: SparkSession, sf: str, keep_key: bool = False) -> DataFrame:
    """C2 on documents: one row per distinct text, keeping the smallest doc_id.

    Skew-safe: the winner per text is ``min(doc_id)`` grouped by a sha-256 digest
    (only digest and id are shuffled, and the partial aggregate collapses a hot
    duplicate map-side), then documents are semi-joined to the winners on the
    unique ``doc_id`` with a shuffle hash join. The output is hash-partitioned by
    ``doc_id``, so chunking and indexing downstream group by (doc_id, ...) without
    moving the corpus again. (``keep_key`` is accepted for older callers.)
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    winners = (d.select(F.sha2(F.col("text"), 256).alias("_k"), "doc_id")
                .groupBy("_k").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    return d.join(winners.hint("shuffle_hash"), "doc_id", "left_semi")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"),
                                                F.col("text").alias("question"))


def numbered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents rendered in the wiki dump layout: (doc_id, text, lines)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.withColumn("lines", T.numbered_lines("text"))


def base_traces(spark: SparkSession, sf: str) -> DataFrame:
    """One diagnosis trace per event (deterministic functions of the event)."""
    e = table(spark, sf, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    k = eid * 7 + uid
    kg_idx = F.when(k % 10 < 6, F.lit(1)).otherwise(1 + (k % 5))
    return e.select(
        eid.alias("q"), uid.alias("u"),
        (F.col("value") / F.lit(5e1)).alias("latency"),
        ((eid % 97) / F.lit(1e1)).alias("vram"),
        (eid % N_ARMS).alias("arm"),
        F.col("ts"),
        F.element_at(_levels(CONSISTENCY_LEVELS), kg_idx.cast("int")).alias("kg_consistency"),
        F.element_at(_levels(ANSWER_LABELS), (1 + eid % 3).cast("int")).alias("label"),
        F.element_at(_levels(ANSWER_LABELS), (1 + uid % 3).cast("int")).alias("gt_label"),
        F.element_at(_levels(RAW_ANSWER_LABELS), (1 + uid % 3).cast("int")).alias("gt_label_raw"),
    )


def traces_from_events(e: DataFrame, arm: F.Column | None = None, keep=()) -> DataFrame:
    """Trace columns of each event, optionally re-asked under an arm column (the arm
    shifts consistency index, label, latency, VRAM and the vote seed). Row-local:
    usable on streaming frames."""
    eid, uid = F.col("event_id"), F.col("user_id")
    a = arm if arm is not None else F.lit(0)
    k = eid * 7 + uid + a
    kg_idx = F.when(k % 10 < 6, F.lit(1)).otherwise(1 + (k % 5))
    lat = F.col("value") / F.lit(5e1) if arm is None else F.col("value") / F.lit(5e1) + a * F.lit(5e-2)
    vram = (eid % 97) / F.lit(1e1) if arm is None else ((eid + a * 13) % 97) / F.lit(1e1)
    return e.select(
        eid.alias("q"), uid.alias("u"), lat.alias("latency"), vram.alias("vram"),
        F.element_at(_levels(CONSISTENCY_LEVELS), kg_idx.cast("int")).alias("kg_consistency"),
        F.element_at(_levels(ANSWER_LABELS), (1 + (eid + a) % 3).cast("int")).alias("label"),
        F.element_at(_levels(ANSWER_LABELS), (1 + uid % 3).cast("int")).alias("gt_label"),
        (eid + a).alias("_vq"), *keep)


def vote_arrays(df: DataFrame) -> DataFrame:
    """Per-row entailment from the row's own vote arrays (no grouping): the same
    vote rule as ``diagnose.entailment_vote`` in array form, for streams."""
    rs = F.sequence(F.lit(0), F.col("q") % 5)
    qv = F.transform(rs, lambda r: F.pmod(F.floor((F.col("_vq") * (r + 3) + F.col("u") * (r + 1)) / 5), F.lit(3)))
    rv = F.transform(rs, lambda r: F.pmod(F.floor((F.col("_vq") * (r + 5) + F.col("u")) / 7), F.lit(3)))

    def rule(v):
        return (F.when(F.forall(v, lambda x: x == 1), F.lit("NEUTRAL"))
                 .when(F.exists(v, lambda x: x == 0), F.lit("ENTAILMENT"))
                 .otherwise(F.lit("CONTRADICTION")))

    return df.withColumn("query_entailment", rule(qv)).withColumn("response_entailment", rule(rv)).drop("_vq")


def votes(spark: SparkSession, sf: str, traces: DataFrame | None = None) -> DataFrame:
    """NLI class per (query, retrieved chunk r): 0 entail, 1 neutral, 2 contradict."""
    b = traces if traces is not None else base_traces(spark, sf)
    r = F.col("r")
    q, u = F.col("q"), F.col("u")
    return (b.select("q", "u", F.explode(F.sequence(F.lit(0), q % 5)).alias("r"))
             .select("q", "r",
                     (F.expr("(q * (r + 3) + u * (r + 1)) div 5") % 3).alias("query_vote"),
                     (F.expr("(q * (r + 5) + u) div 7") % 3).alias("response_vote")))


def candidate_outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Outcome of re-asking query q under arm a (a = 0..10): trace and vote tables.

    The arm shifts every input: consistency index, votes, latency, VRAM, label.
    The arm table has a fixed size of 11 rows, so broadcasting it is bounded.
    """
    e = table(spark, sf, "events")
    arms = F.broadcast(spark.range(N_ARMS).select(F.col("id").alias("arm")))
    x = e.crossJoin(arms)
    eid, uid, arm = F.col("event_id"), F.col("user_id"), F.col("arm")
    k = eid * 7 + uid + arm
    kg_idx = F.when(k % 10 < 6, F.lit(1)).otherwise(1 + (k % 5))
    tr = x.select(
        eid.alias("q"), uid.alias("u"), arm,
        (F.col("value") / F.lit(5e1) + arm * F.lit(5e-2)).alias("latency"),
        (((eid + arm * 13) % 97) / F.lit(1e1)).alias("vram"),
        F.element_at(_levels(CONSISTENCY_LEVELS), kg_idx.cast("int")).alias("kg_consistency"),
        F.element_at(_levels(ANSWER_LABELS), (1 + (eid + arm) % 3).cast("int")).alias("label"),
        F.element_at(_levels(ANSWER_LABELS), (1 + uid % 3).cast("int")).alias("gt_label"),
    )
    vt = (tr.select("q", "u", "arm", F.explode(F.sequence(F.lit(0), F.col("q") % 5)).alias("r"))
            .select("q", "arm", "r",
                    (F.expr("((q + arm) * (r + 3) + u * (r + 1)) div 5") % 3).alias("query_vote"),
                    (F.expr("((q + arm) * (r + 5) + u) div 7") % 3).alias("response_vote")))
    return tr, vt


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies: a user turn followed by the assistant's next turn, wrapped as
    JSON text; every seventh fenced, every eleventh the empty-reply marker."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    p = u.join(a, ["conv_id", "turn"])
    key = F.col("conv_id") * 31 + F.col("turn")
    label = F.element_at(_levels(ANSWER_LABELS), (1 + (F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    gold = F.element_at(_levels(ANSWER_LABELS), (1 + F.col("conv_id") % 3).cast("int"))
    from remedy.functions.reply import json_escape
    js = F.concat(F.lit('{"label": "'), label, F.lit('", "response": "'), json_escape(F.col("answer")), F.lit('"}'))
    reply = (F.when(key % 11 == 0, F.lit(T.EMPTY_REPLY))
              .when(key % 7 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
              .otherwise(js))
    return p.select("conv_id", "turn", "question", "answer", reply.alias("reply"), gold.alias("gt_label"))


# ---- knowledge facts over the TPC-H-like dimension tables --------------------
# Element vectors: of n embedding rows the last two stand for the relations, and an
# element uses row (offset + key) mod (n - 2).
FACT_OFFSETS = {"region": 0, "nation": 10, "supplier": 50, "customer": 200}
RELATIONS = ["part of", "located in"]


def n_vectors(spark: SparkSession, sf: str) -> int:
    """Rows of the embeddings table (a one-row statistic from the file footers)."""
    return table(spark, sf, "embeddings").count()


def _rows(n: int):
    elements = max(1, n - 2)

    def element(kind: str, key: str) -> F.Column:
        return ((F.lit(FACT_OFFSETS[kind]) + F.col(key)) % F.lit(elements)).cast("long")

    def relation(name: str) -> F.Column:
        return F.lit(elements + RELATIONS.index(name)).cast("long")

    return element, relation


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge triples (s, r, o) with element-vector row ids and a stable id."""
    element, relation = _rows(n_vectors(spark, sf))
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    supplier = table(spark, sf, "supplier")
    customer = table(spark, sf, "customer")
    n_r = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
           .select(F.lit(0).alias("kind"), F.col("n_nationkey").cast("long").alias("key"),
                   F.col("n_name").alias("s"), F.lit("part of").alias("r"), F.col("r_name").alias("o"),
                   element("nation", "n_nationkey").alias("s_row"),
                   relation("part of").alias("r_row"),
                   element("region", "r_regionkey").alias("o_row")))
    # nation is a fixed 25-row dimension: broadcasting it is bounded.
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))
    s_n = (supplier.join(nat, supplier.s_nationkey == F.col("n_nationkey"))
           .select(F.lit(1).alias("kind"), F.col("s_suppkey").alias("key"),
                   F.col("s_name").alias("s"), F.lit("located in").alias("r"), F.col("n_name").alias("o"),
                   element("supplier", "s_suppkey").alias("s_row"),
                   relation("located in").alias("r_row"),
                   element("nation", "n_nationkey").alias("o_row")))
    c_n = (customer.join(nat, customer.c_nationkey == F.col("n_nationkey"))
           .select(F.lit(2).alias("kind"), F.col("c_custkey").alias("key"),
                   F.col("c_name").alias("s"), F.lit("located in").alias("r"), F.col("n_name").alias("o"),
                   element("customer", "c_custkey").alias("s_row"),
                   relation("located in").alias("r_row"),
                   element("nation", "n_nationkey").alias("o_row")))
    out = n_r.unionByName(s_n).unionByName(c_n)
    return out.withColumn("fact_id", F.col("kind").cast("long") * F.lit(10**12) + F.col("key"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to check: every customer states a nation; one in three names the
    next nation (a likely conflict); every thirteenth answer is empty."""
    element, relation = _rows(n_vectors(spark, sf))
    customer = table(spark, sf, "customer")
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))  # 25 rows
    shift = F.when(F.col("c_custkey") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    c = customer.select("c_custkey", "c_name", ((F.col("c_nationkey") + shift) % 25).alias("claimed"))
    j = c.join(nation, c.claimed == nation.n_nationkey)
    return j.select(
        F.col("c_custkey").alias("answer_id"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(
            F.concat_ws(" ", "c_name", F.lit("is located in"), "n_name")).alias("answer_text"),
        F.col("c_name").alias("s"), F.lit("located in").alias("r"), F.col("n_name").alias("o"),
        element("customer", "c_custkey").alias("s_row"),
        relation("located in").alias("r_row"),
        element("nation", "n_nationkey").alias("o_row"),
    )


def answer_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples extracted from the answers: none for empty answers, and none for
    every seventeenth answer (the extractor found no triple)."""
    a = answers(spark, sf)
    return a.filter((F.col("answer_text") != "") & (F.col("answer_id") % 17 != 0))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Element vectors as double arrays keyed by row id."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims in the fact-checking dump layout: (id, claim, label, evidence) where
    evidence is ARRAY<ARRAY<ARRAY<STRING>>> of [annotation, evidence id, page, line].

    Every document that holds a benchmark item verbatim is an evidence page, at the
    line where the item starts (a second tuple in the set points at the next line and
    is ignored downstream). A claim has one row per evidence page, so no claim gathers
    its pages. Items without a page carry a null-page set; every seventh item
    (id % 7 = 3) also has a row that cites a page that does not exist."""
    from remedy.operators.retrieve import gold_containment
    from remedy.session import bounded_broadcast, cut_lineage

    docs = table(spark, sf, "documents").select("doc_id", "text")
    qs = questions(spark, sf)
    # Pairs (item, page), materialised, then met with the documents (broadcast when
    # few, so that the corpus text is not shuffled).
    g = cut_lineage(gold_containment(docs, qs).distinct())
    gd = (docs.join(bounded_broadcast(g), "doc_id").join(qs, "q_id")
          .withColumn("_pre", F.expr("substring(text, 1, instr(text, question) - 1)"))
          .select("q_id", "doc_id",
                  (F.length("_pre") - F.length(F.replace(F.col("_pre"), F.lit("\n"), F.lit("")))).alias("line")))
    c = qs.join(gd, "q_id", "left")
    qid, page = F.col("q_id").cast("string"), F.col("doc_id").cast("string")
    gold_set = F.array(F.array(qid, qid, page, F.col("line").cast("string")),
                       F.array(qid, qid, page, (F.col("line") + 1).cast("string")))
    missing_set = F.array(F.array(qid, qid, F.concat(F.lit("missing-"), qid), F.lit("0")))
    null_set = F.array(F.array(qid, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    label = F.element_at(_levels(RAW_ANSWER_LABELS), (1 + F.col("q_id") % 3).cast("int"))
    cols = [F.col("q_id").alias("id"), F.col("question").alias("claim"), label.alias("label")]
    found = c.select(*cols, F.array(F.when(F.col("doc_id").isNotNull(), gold_set).otherwise(null_set)).alias("evidence"))
    missing = qs.filter(F.col("q_id") % 7 == 3).select(*cols, F.array(missing_set).alias("evidence"))
    return found.unionByName(missing)


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the wiki dump layout: (page_id STRING, text, lines)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), "text",
                    T.numbered_lines("text").alias("lines"))
