
from __future__ import annotations

from remedy.functions.num import sql_rnd
from remedy.plans import corpus as CQ
from remedy.plans import diagnosis as DQ
from remedy.plans import io as IQ
from remedy.plans import streams as SQ
from remedy.plans import knowledge as KQ
from remedy.plans import oracle_policy as OP
from remedy.plans import policies as PQ
from remedy.plans import oracle_corpus as OC
from remedy.plans import oracle_diagnosis as OD
from remedy.plans import oracle_retrieval as OR
from remedy.plans import retrieval as RQ

QUERIES = {
    "retrieval_eval": RQ.retrieval_eval,
    "dedupe_passages": RQ.dedupe_passages,
    "chunk_windows": RQ.chunk_windows,
    "chunk_sentences": RQ.chunk_sentences,
    "bm25_stats": RQ.bm25_stats,
    "bm25_topk": RQ.bm25_topk,
    "bm25_refreshed": RQ.bm25_refreshed,
    "config_grid": RQ.config_grid,
    "gold_containment": RQ.gold_containment,
    "gold_containment_short": RQ.gold_containment_short,
    "precision_at_k": RQ.precision_at_k,
    "context_precision": RQ.context_precision,
    "context_recall": RQ.context_recall,
    "dense_topk": RQ.dense_topk,
    "rerank_topn": RQ.rerank_topn,
    "similarity_filter": RQ.similarity_filter,
    "pack_context": RQ.pack_context,
}

for _k in ["entailment_vote", "failure_label", "verified_label", "reward", "reward_binary", "action_space",
           "variants", "reward_ablation", "action_candidates", "oracle_best_action", "apply_action",
           "repaired_traces", "fixed_policy", "explore_choice", "failed_rows", "exact_match", "canon_label",
           "diagnostic_counts", "consistency_rate", "bootstrap_ci", "pre_post_join", "action_name",
           "delta_by_action", "action_frequency", "budget_features", "one_hot", "faithfulness",
           "answer_relevancy", "context_means", "post_bootstrap_ci", "post_consistency_rate",
           "post_diagnostic_counts"]:
    QUERIES[_k] = getattr(DQ, _k)

for _k in ["decode_brackets", "clean_passage", "split_sentences", "join_sentences", "label_sentence",
           "parse_reply", "repair_reply", "eval_projection", "clean_short_answer", "render_prompt", "decode_triples",
           "triple_query", "triple_export", "cap_triples", "explode_evidence", "inverse_evidence",
           "evidence_semi", "evidence_sentences", "evidence_missing", "split_range", "corpus_cap",
           "corpus_refresh", "corpus_counts", "epoch_order", "sample_replace", "nli_pairs",
           "normalize_id"]:
    QUERIES[_k] = getattr(CQ, _k)

for _k in ["triple_topk", "triple_status", "triple_rollup", "answer_consistency", "consistency_counts",
           "answer_consistency_short"]:
    QUERIES[_k] = getattr(KQ, _k)

for _k in ["context_vector", "linucb_fit", "linucb_score", "thompson_fit", "thompson_mean", "thompson_score",
           "ucb_fit", "ucb_score", "kernelucb_score", "arm_argmax", "neural_linear_score", "epsgreedy_fit",
           "epsgreedy_choice", "tree_policy"]:
    QUERIES[_k] = getattr(PQ, _k)

for _k in ["src_claims", "src_pages", "src_slices", "src_multihop", "kb_artifact", "trace_tsv", "trace_reload", "trace_reload_rewards",
           "index_tables", "policy_io"]:
    QUERIES[_k] = getattr(IQ, _k)

for _k in ["stream_diagnose", "stream_policy", "stream_reindex", "stream_bm25_topk", "stream_epsgreedy"]:
    QUERIES[_k] = getattr(SQ, _k)

ORACLE = dict(OR.SQL)
ORACLE.update(OP.SQL)
ORACLE.update(OC.SQL)
ORACLE.update(OD.SQL)
ORACLE = {k: sql_rnd(v) for k, v in ORACLE.items()}
