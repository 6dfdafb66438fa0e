"""DuckDB oracle SQL for the trace / diagnosis / reward / repair queries."""

KG = "['CONSISTENT','CONFLICT','MISSING','EMPTYINPUT','NOTRIPLETS']"
LAB = "['SUPPORTS','REFUTES','NOTENOUGHINFO']"
RAW = "['SUPPORTS','REFUTES','NOT ENOUGH INFO']"


def _kg(k: str) -> str:
    return f"{KG}[CASE WHEN ({k}) % 10 < 6 THEN 1 ELSE 1 + (({k}) % 5)::INT END]"


VOTE = """CASE WHEN bool_and({c} = 1) THEN 'NEUTRAL' WHEN bool_or({c} = 0) THEN 'ENTAILMENT'
               ELSE 'CONTRADICTION' END"""

FAILURE = """CASE WHEN kg_consistency = 'CONFLICT' THEN 'WRONG_PREDICATE_FAILURE'
     WHEN query_entailment = 'NEUTRAL' THEN 'INSUFFICIENT_EVIDENCE_FAILURE'
     WHEN response_entailment IN ('CONTRADICTION', 'NEUTRAL') THEN 'WRONG_RESPONSE_FAILURE'
     WHEN label = 'SUPPORTS' AND query_entailment = 'CONTRADICTION' THEN 'LABEL_EVIDENCE_MISMATCH_FAILURE'
     WHEN label = 'REFUTES' AND query_entailment = 'ENTAILMENT' THEN 'LABEL_EVIDENCE_MISMATCH_FAILURE'
     ELSE 'NO_FAILURE' END"""


def reward_parts(L="3e0", V="6e0", gate="true", cost="true") -> str:
    """The 8 reward parts as SQL select items (inputs: failure_label, kg_consistency,
    response_entailment, latency, vram)."""
    base = ("((CASE WHEN failure_label = 'NO_FAILURE' THEN 1e0 ELSE 0e0 END) + "
            "(CASE WHEN kg_consistency = 'CONSISTENT' THEN 1e0 ELSE 0e0 END) + "
            "2e0 * (CASE WHEN response_entailment = 'ENTAILMENT' THEN 1e0 ELSE 0e0 END)) / 4e0")
    ls = f"(CASE WHEN latency > {L} THEN 0e0 ELSE 1e0 END)"
    vs = f"(CASE WHEN vram > {V} THEN 0e0 ELSE 1e0 END)"
    gated = f"(CASE WHEN {gate} THEN {base} * {ls} * {vs} ELSE {base} END)"
    total = f"(CASE WHEN {cost} THEN {gated} * (1e0 - latency / {L}) * (1e0 - vram / {V}) ELSE {gated} END)"
    return (f"{total} AS total_reward, "
            "CASE WHEN failure_label = 'NO_FAILURE' THEN 1e0 ELSE 0e0 END AS failure_reward, "
            "CASE WHEN kg_consistency = 'CONSISTENT' THEN 1e0 ELSE 0e0 END AS consistency_reward, "
            "CASE WHEN response_entailment = 'ENTAILMENT' THEN 1e0 ELSE 0e0 END AS factuality_reward, "
            f"{ls} AS latency_budget_strict, {vs} AS vram_budget_strict, "
            f"latency / {L} AS latency_rate, vram / {V} AS vram_rate")


def total_reward(L, V, gate, cost) -> str:
    return reward_parts(L, V, gate, cost).split(" AS total_reward")[0]


BASE = f"""base AS (
  SELECT event_id AS q, user_id AS u, value / 5e1 AS latency, (event_id % 97) / 1e1 AS vram,
         event_id % 11 AS arm, ts,
         {_kg('event_id * 7 + user_id')} AS kg_consistency,
         {LAB}[1 + (event_id % 3)::INT] AS label,
         {LAB}[1 + (user_id % 3)::INT] AS gt_label,
         {RAW}[1 + (user_id % 3)::INT] AS gt_label_raw
  FROM events),
votes AS (SELECT q, r, ((q * (r + 3) + u * (r + 1)) // 5) % 3 AS query_vote,
                 ((q * (r + 5) + u) // 7) % 3 AS response_vote
          FROM base, UNNEST(RANGE(0, 1 + q % 5)) t(r)),
ent AS (SELECT b.*, coalesce(v.qe, 'NEUTRAL') AS query_entailment, coalesce(v.re, 'NEUTRAL') AS response_entailment
        FROM base b LEFT JOIN (SELECT q, {VOTE.format(c='query_vote')} AS qe, {VOTE.format(c='response_vote')} AS re
                               FROM votes GROUP BY q) v USING (q)),
fl AS (SELECT *, {FAILURE} AS failure_label FROM ent),
diag AS (SELECT *, CASE WHEN failure_label IN ('INSUFFICIENT_EVIDENCE_FAILURE', 'LABEL_EVIDENCE_MISMATCH_FAILURE')
                        THEN 'UNVERIFIED' ELSE label END AS verified_label,
                   {reward_parts()}
         FROM fl),
diagem AS (SELECT *, lower(gt_label) = lower(verified_label) AS em FROM diag)"""

CAND = f"""arms AS (SELECT unnest(range(11))::BIGINT AS arm),
ctr AS (SELECT event_id AS q, user_id AS u, a.arm,
               value / 5e1 + a.arm * 5e-2 AS latency, ((event_id + a.arm * 13) % 97) / 1e1 AS vram,
               {_kg('event_id * 7 + user_id + a.arm')} AS kg_consistency,
               {LAB}[1 + ((event_id + a.arm) % 3)::INT] AS label
        FROM events, arms a),
cvotes AS (SELECT q, arm, r, (((q + arm) * (r + 3) + u * (r + 1)) // 5) % 3 AS query_vote,
                  (((q + arm) * (r + 5) + u) // 7) % 3 AS response_vote
           FROM ctr, UNNEST(RANGE(0, 1 + q % 5)) t(r)),
cent AS (SELECT c.*, coalesce(v.qe, 'NEUTRAL') AS query_entailment, coalesce(v.re, 'NEUTRAL') AS response_entailment
         FROM ctr c LEFT JOIN (SELECT q, arm, {VOTE.format(c='query_vote')} AS qe, {VOTE.format(c='response_vote')} AS re
                               FROM cvotes GROUP BY q, arm) v USING (q, arm)),
cfl AS (SELECT *, {FAILURE} AS failure_label FROM cent),
cand AS (SELECT *, CASE WHEN failure_label IN ('INSUFFICIENT_EVIDENCE_FAILURE', 'LABEL_EVIDENCE_MISMATCH_FAILURE')
                        THEN 'UNVERIFIED' ELSE label END AS verified_label,
                   {reward_parts()}
         FROM cfl)"""

ACTIONS = """actions AS (SELECT * FROM (VALUES
  (0, 'dense', 10, false, NULL, NULL, 0.25e0 / 8),
  (1, 'dense', 10, true, NULL, NULL, 0.25e0 / 8),
  (2, 'dense', 20, false, NULL, NULL, 0.25e0 / 8),
  (3, 'dense', 20, true, NULL, NULL, 0.25e0 / 8),
  (4, 'bm25', 10, false, NULL, NULL, 0.25e0 / 8),
  (5, 'bm25', 10, true, NULL, NULL, 0.25e0 / 8),
  (6, 'bm25', 20, false, NULL, NULL, 0.25e0 / 8),
  (7, 'bm25', 20, true, NULL, NULL, 0.25e0 / 8),
  (8, NULL, NULL, NULL, true, NULL, 0.25e0),
  (9, NULL, NULL, NULL, NULL, 'paraphrase_qa', 0.25e0),
  (10, NULL, NULL, NULL, NULL, 'simplify_qa', 0.25e0)
) t(arm, retriever, topk, reindex, reranker, prompt_edit, weight)),
actw AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY arm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS w_lo,
                sum(weight) OVER (ORDER BY arm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_hi FROM actions)"""

VARIANTS = """variants AS (SELECT * FROM (VALUES
  ('fever', 'linucb', true, true, 3e0, 6e0, 'claim'),
  ('fever_ts', 'thompsonsampling', true, true, 3e0, 6e0, 'claim'),
  ('fever_nogate', 'linucb', false, true, 3e0, 6e0, 'claim'),
  ('fever_nocost', 'linucb', true, false, 3e0, 6e0, 'claim'),
  ('fever_tb', 'linucb', true, true, 7e-1 * 3e0, 7e-1 * 6e0, 'claim'),
  ('fever_lb', 'linucb', true, true, 15e-1 * 3e0, 15e-1 * 6e0, 'claim'),
  ('hotpotqa', 'linucb', true, true, 3e0, 6e0, 'short'),
  ('hotpotqa_ts', 'thompsonsampling', true, true, 3e0, 6e0, 'short'),
  ('hotpotqa_nogate', 'linucb', false, true, 3e0, 6e0, 'short'),
  ('hotpotqa_nocost', 'linucb', true, false, 3e0, 6e0, 'short'),
  ('hotpotqa_tb', 'linucb', true, true, 7e-1 * 3e0, 7e-1 * 6e0, 'short'),
  ('hotpotqa_lb', 'linucb', true, true, 15e-1 * 3e0, 15e-1 * 6e0, 'short')
) t(variant, method, with_gating, with_cost, latency_budget, vram_budget, task))"""

CHOICE = """choice AS (SELECT *, CASE WHEN verified_label = 'UNVERIFIED' THEN arm % 8 ELSE arm END AS chosen_arm FROM diagem)"""

PARAMS_JSON = """CASE WHEN {a} IS NULL OR {a} < 0 THEN NULL
     WHEN x.retriever IS NOT NULL THEN '{{"retriever": "' || x.retriever || '", "topk": ' || x.topk::VARCHAR ||
          ', "reindex": ' || CASE WHEN x.reindex THEN 'true' ELSE 'false' END || '}}'
     WHEN x.reranker IS NOT NULL THEN '{{"reranker": ' || CASE WHEN x.reranker THEN 'true' ELSE 'false' END || '}}'
     ELSE '{{"prompt_edit": "' || x.prompt_edit || '"}}' END"""

REPAIRED = f"""rep0 AS (
  SELECT c.q, ch.chosen_arm AS action, c.failure_label, c.verified_label, c.kg_consistency, c.query_entailment,
         c.response_entailment, c.latency, c.vram, c.total_reward
  FROM choice ch JOIN cand c ON c.q = ch.q AND c.arm = ch.chosen_arm WHERE ch.failure_label <> 'NO_FAILURE'
  UNION ALL
  SELECT q, -1 AS action, failure_label, verified_label, kg_consistency, query_entailment, response_entailment,
         latency, vram, total_reward FROM choice WHERE failure_label = 'NO_FAILURE'),
rep AS (SELECT r.*, {PARAMS_JSON.format(a='r.action')} AS params_json
        FROM rep0 r LEFT JOIN actions x ON x.arm = r.action),
pp AS (SELECT d.q, d.failure_label AS pre_failure, r.failure_label AS post_failure, r.action, r.params_json,
              r.latency - d.latency AS delta_latency, r.vram - d.vram AS delta_vram
       FROM diagem d JOIN rep r USING (q))"""

ACTION_NAME = """CASE WHEN {p} IS NULL THEN 'Default Action'
     WHEN coalesce(json_extract({p}, '$.reranker')::BOOLEAN, false) THEN 'Reranker activation'
     WHEN json_extract_string({p}, '$.prompt_edit') = 'paraphrase_qa' THEN 'Paraphrase query'
     WHEN json_extract_string({p}, '$.prompt_edit') = 'simplify_qa' THEN 'Simplify query'
     WHEN json_extract_string({p}, '$.retriever') IS NOT NULL THEN
          json_extract_string({p}, '$.retriever') || ', top-' || json_extract_string({p}, '$.topk') ||
          ', reindex=' || CASE WHEN json_extract({p}, '$.reindex')::BOOLEAN THEN 'True' ELSE 'False' END
     ELSE 'Default Action' END"""

W = f"WITH {BASE}"
WC = f"WITH {BASE}, {CAND}, {ACTIONS}"

SQL = {
    "entailment_vote": W + " SELECT q, query_entailment, response_entailment FROM diag",
    "failure_label": W + " SELECT q, failure_label FROM diag",
    "verified_label": W + """ SELECT q, label, verified_label,
        CASE WHEN verified_label = 'UNVERIFIED' THEN 'retriever' ELSE 'all' END AS patchset FROM diag""",
    "reward": W + """ SELECT q, round(total_reward, 6) AS total_reward, round(failure_reward, 6) AS failure_reward,
        round(consistency_reward, 6) AS consistency_reward, round(factuality_reward, 6) AS factuality_reward,
        round(latency_budget_strict, 6) AS latency_budget_strict, round(vram_budget_strict, 6) AS vram_budget_strict,
        round(latency_rate, 6) AS latency_rate, round(vram_rate, 6) AS vram_rate FROM diag""",
    "reward_binary": W + " SELECT q, CASE WHEN total_reward < 4e-1 THEN 0e0 ELSE 1e0 END AS reward_binary FROM diag",
    "action_space": f"""WITH {BASE}, {ACTIONS}
        SELECT a.arm::BIGINT AS arm, retriever, topk::INT AS topk, reindex, reranker, prompt_edit, round(weight, 6) AS weight,
               coalesce(n.n, 0)::BIGINT AS n_logged
        FROM actions a LEFT JOIN (SELECT arm, count(*) AS n FROM base GROUP BY arm) n ON n.arm = a.arm""",
    "variants": f"""WITH {BASE}, {VARIANTS}
        SELECT variant, method, with_gating, with_cost, round(latency_budget, 6) AS latency_budget,
               round(vram_budget, 6) AS vram_budget, task,
               sum((latency <= latency_budget)::BIGINT)::BIGINT AS n_latency_ok,
               sum((vram <= vram_budget)::BIGINT)::BIGINT AS n_vram_ok, count(*) AS n
        FROM base CROSS JOIN variants GROUP BY ALL""",
    "reward_ablation": f"""WITH {BASE}, {VARIANTS},
        rr AS (SELECT variant, CASE WHEN method = 'thompsonsampling'
                 THEN (CASE WHEN {total_reward('latency_budget', 'vram_budget', 'with_gating', 'with_cost')} < 4e-1 THEN 0e0 ELSE 1e0 END)
                 ELSE {total_reward('latency_budget', 'vram_budget', 'with_gating', 'with_cost')} END AS r
               FROM diag CROSS JOIN variants)
        SELECT variant, round(avg(r), 6) AS avg_reward, sum((r = 0)::BIGINT)::BIGINT AS n_zero, count(*) AS n
        FROM rr GROUP BY variant""",
    "action_candidates": f"""{WC}
        SELECT d.q, a.arm::BIGINT AS arm FROM diag d JOIN actions a
        ON d.verified_label <> 'UNVERIFIED' OR a.arm < 8 WHERE d.failure_label <> 'NO_FAILURE'""",
    "oracle_best_action": f"""{WC},
        pairs AS (SELECT d.q, a.arm FROM diag d JOIN actions a ON d.verified_label <> 'UNVERIFIED' OR a.arm < 8
                  WHERE d.failure_label <> 'NO_FAILURE'),
        best AS (SELECT c.q, c.arm, c.failure_label, c.total_reward FROM pairs p JOIN cand c ON c.q = p.q AND c.arm = p.arm
                 QUALIFY row_number() OVER (PARTITION BY c.q ORDER BY c.total_reward DESC, c.arm) = 1)
        SELECT q, arm::BIGINT AS arm, failure_label, round(total_reward, 6) AS total_reward FROM best
        UNION ALL SELECT q, -1::BIGINT, failure_label, round(total_reward, 6) FROM diag WHERE failure_label = 'NO_FAILURE'""",
    "apply_action": f"""{WC}, {CHOICE}
        SELECT c.q, coalesce(x.retriever, 'dense') AS retriever, coalesce(x.topk, 5)::INT AS topk,
               coalesce(x.reranker, false) AS reranker, coalesce(x.prompt_edit, 'simple_qa') AS prompt_edit,
               coalesce(x.reindex, false) AS reindex
        FROM choice c LEFT JOIN actions x ON c.failure_label <> 'NO_FAILURE' AND x.arm = c.chosen_arm""",
    "repaired_traces": f"""{WC}, {CHOICE}, {REPAIRED}
        SELECT q, action::BIGINT AS action, failure_label, verified_label, kg_consistency, query_entailment,
               response_entailment, round(latency, 6) AS latency, round(vram, 6) AS vram,
               round(total_reward, 6) AS total_reward FROM rep""",
    "fixed_policy": f"""{WC},
        fc AS (SELECT c.q, c.arm, c.failure_label, c.total_reward AS r FROM diag d JOIN cand c USING (q)
               WHERE d.failure_label <> 'NO_FAILURE'),
        best AS (SELECT 'best_arm' AS policy, arg_max(arm, (m, -arm)) AS arm
                 FROM (SELECT arm, avg(r) AS m FROM fc GROUP BY arm)),
        pol AS (SELECT 'paraphrase' AS policy, 9::BIGINT AS arm UNION ALL SELECT 'top20', 2 UNION ALL SELECT policy, arm FROM best),
        allr AS (SELECT p.policy, p.arm, fc.failure_label, fc.r FROM fc JOIN pol p USING (arm)
                 UNION ALL SELECT p.policy, p.arm, d.failure_label, d.total_reward FROM diag d CROSS JOIN pol p
                 WHERE d.failure_label = 'NO_FAILURE')
        SELECT policy, arm::BIGINT AS arm, count(*) AS n, round(avg(r), 6) AS avg_reward,
               sum((failure_label = 'NO_FAILURE')::BIGINT)::BIGINT AS n_no_failure
        FROM allr GROUP BY policy, arm""",
    "explore_choice": f"""{WC}, {CHOICE},
        u AS (SELECT q, chosen_arm,
                ('0x' || substr(md5('42:explore|' || q::VARCHAR), 1, 8))::BIGINT / 4294967296e0 AS u1,
                ('0x' || substr(md5('42:arm|' || q::VARCHAR), 1, 8))::BIGINT / 4294967296e0 AS u2 FROM choice)
        SELECT u.q, u.u1 <= 2e-1 AS explored, (CASE WHEN u.u1 <= 2e-1 THEN a.arm ELSE u.chosen_arm END)::BIGINT AS chosen_arm
        FROM u LEFT JOIN actw a ON u.u2 >= a.w_lo AND u.u2 < a.w_hi""",
    "failed_rows": W + " SELECT q, failure_label FROM diag WHERE failure_label <> 'NO_FAILURE'",
    "exact_match": W + " SELECT q, gt_label_raw, verified_label, em FROM diagem",
    "canon_label": W + " SELECT q, replace(gt_label_raw, ' ', '') AS gt_label FROM base",
    "diagnostic_counts": W + """ SELECT em, "column", value, count(*) AS n FROM (
        UNPIVOT (SELECT em, kg_consistency, query_entailment, response_entailment, failure_label, gt_label, verified_label FROM diagem)
        ON kg_consistency, query_entailment, response_entailment, failure_label, gt_label, verified_label
        INTO NAME "column" VALUE value) GROUP BY ALL""",
    "consistency_rate": W + """ SELECT failure_label, round(avg((kg_consistency = 'CONSISTENT')::INT::DOUBLE), 6) AS consistency_rate,
        count(*) AS n FROM diag GROUP BY ROLLUP (failure_label)""",
    "pre_post_join": f"""{WC}, {CHOICE}, {REPAIRED}
        SELECT q, pre_failure, post_failure, action::BIGINT AS action, round(delta_latency, 6) AS delta_latency,
               round(delta_vram, 6) AS delta_vram FROM pp""",
    "action_name": f"""{WC}, {CHOICE}, {REPAIRED}
        SELECT q, {ACTION_NAME.format(p='params_json')} AS action_name FROM rep""",
    "delta_by_action": f"""{WC}, {CHOICE}, {REPAIRED}
        SELECT coalesce(params_json, 'None') AS params, round(avg(delta_latency), 6) AS delta_latency,
               round(avg(delta_vram), 6) AS delta_vram, count(*) AS n FROM pp GROUP BY params_json""",
    "action_frequency": f"""{WC}, {CHOICE}, {REPAIRED}
        SELECT pre_failure, {ACTION_NAME.format(p='params_json')} AS action_name, count(*) AS n
        FROM pp WHERE pre_failure <> 'NO_FAILURE' GROUP BY ALL""",
    "budget_features": W + """ SELECT q, round(greatest(0e0, (6e0 - vram) / 1e5), 10) AS vram_headroom,
        round(greatest(0e0, (3e0 - latency) / 1e4), 10) AS latency_headroom FROM diag""",
    "one_hot": W + """ SELECT q,
        list_transform(['NO_FAILURE','WRONG_PREDICATE_FAILURE','INSUFFICIENT_EVIDENCE_FAILURE','WRONG_RESPONSE_FAILURE','LABEL_EVIDENCE_MISMATCH_FAILURE'], lambda v: (v = failure_label)::INT) AS failure_onehot,
        list_transform(['CONSISTENT','CONFLICT','MISSING','EMPTYINPUT','NOTRIPLETS'], lambda v: (v = kg_consistency)::INT) AS consistency_onehot,
        list_transform(['ENTAILMENT','CONTRADICTION','NEUTRAL'], lambda v: (v = query_entailment)::INT) AS query_onehot,
        list_transform(['ENTAILMENT','CONTRADICTION','NEUTRAL'], lambda v: (v = response_entailment)::INT) AS response_onehot
        FROM diag""",
    "faithfulness": W + """ SELECT d.failure_label, round(avg(f.faith), 6) AS faithfulness, count(*) AS n
        FROM diag d JOIN (SELECT q, avg((response_vote = 0)::INT::DOUBLE) AS faith FROM votes GROUP BY q) f USING (q)
        GROUP BY d.failure_label""",
    "answer_relevancy": W + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        g AS (SELECT q, failure_label, j, q % (SELECT count(*) FROM embeddings) AS qrow, (q * 3 + j + 1) % (SELECT count(*) FROM embeddings) AS grow FROM diag, (SELECT unnest([0, 1, 2]) AS j)),
        c AS (SELECT g.q, g.failure_label,
                 list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) /
                 (sqrt(list_sum(list_transform(a.v, lambda z: z * z))) * sqrt(list_sum(list_transform(b.v, lambda z: z * z)))) AS cos
              FROM g JOIN v a ON a.vec_id = g.qrow JOIN v b ON b.vec_id = g.grow),
        per AS (SELECT q, failure_label, avg(cos) AS rel FROM c GROUP BY q, failure_label)
        SELECT failure_label, round(avg(rel), 6) AS answer_relevancy, count(*) AS n FROM per GROUP BY failure_label""",
}


def _poisson_sql(u: str) -> str:
    from remedy.operators.metrics import POISSON_CDF
    parts = " ".join(f"WHEN {u} < {repr(c)} THEN {k}" for k, c in enumerate(POISSON_CDF))
    return f"CASE {parts} ELSE {len(POISSON_CDF)} END"


from remedy.plans.oracle_retrieval import EVAL as _EVAL  # noqa: E402

SQL["context_means"] = _EVAL + """, """ + W.removeprefix("WITH ") + """
    SELECT em, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall,
           count(*) AS n FROM diagem JOIN ev ON ev.q_id = diagem.q % (SELECT count(*) FROM benchmark) GROUP BY em"""

_BOOT = f""",
    u AS (SELECT q, failure_label, 'latency' AS metric, latency AS x FROM TRACES
          UNION ALL SELECT q, failure_label, 'vram', vram FROM TRACES
          UNION ALL SELECT q, failure_label, 'consistency', (kg_consistency = 'CONSISTENT')::INT::DOUBLE FROM TRACES),
    xw AS (SELECT metric, failure_label, q, x, b,
             {_poisson_sql("('0x' || substr(md5('42|' || b::VARCHAR || '|' || q::VARCHAR), 1, 8))::BIGINT / 4294967296e0")} AS w
           FROM u, (SELECT unnest(range(10)) AS b)),
    per AS (SELECT metric, failure_label, b, sum(w * x) / nullif(sum(w), 0) AS m FROM xw GROUP BY metric, failure_label, b
            UNION ALL SELECT metric, NULL, b, sum(w * x) / nullif(sum(w), 0) FROM xw GROUP BY metric, b),
    st AS (SELECT metric, failure_label, avg(m) AS mean, list(m ORDER BY m) AS r, count(m) AS k
           FROM per WHERE m IS NOT NULL GROUP BY metric, failure_label),
    sz AS (SELECT metric, failure_label, count(*) AS n, first(x) AS x1, avg(x) AS e1, var_pop(x) AS m2, min(x) = max(x) AS flat FROM u GROUP BY metric, failure_label
           UNION ALL SELECT metric, NULL, count(*), first(x), avg(x), var_pop(x), min(x) = max(x) FROM u GROUP BY metric),
    jk AS (SELECT sz.metric, sz.failure_label, avg((u.x - sz.e1) ** 3) AS m3 FROM sz JOIN u
             ON u.metric = sz.metric AND (sz.failure_label IS NULL OR u.failure_label = sz.failure_label) GROUP BY sz.metric, sz.failure_label),
    al AS (SELECT sz.*, st.mean, st.r, st.k, jk.m3 / (6 * sz.m2 ** 15e-1 * sqrt(sz.n)) AS acc,
             list_sum(list_transform(st.r, lambda v: (round(v * 1e9) < round(sz.e1 * 1e9))::INT + (round(v * 1e9) <= round(sz.e1 * 1e9))::INT))::INT AS below
           FROM sz LEFT JOIN st ON sz.metric = st.metric AND sz.failure_label IS NOT DISTINCT FROM st.failure_label
           LEFT JOIN jk ON sz.metric = jk.metric AND sz.failure_label IS NOT DISTINCT FROM jk.failure_label),
    zz AS (SELECT *, CASE WHEN n > 1 AND NOT flat AND below > 0 AND below < 2 * k THEN Z0TABLE END AS z0 FROM al),
    zs AS (SELECT *, z0 + (z0 - ZTAIL) / (1 - acc * (z0 - ZTAIL)) AS zl, z0 + (z0 + ZTAIL) / (1 - acc * (z0 + ZTAIL)) AS zh FROM zz),
    ps AS (SELECT *, (k - 1) * (PHI_zl) AS al, (k - 1) * (PHI_zh) AS ah FROM zs)
    SELECT metric, failure_label, n, round(CASE WHEN n = 1 THEN x1 ELSE mean END, 8) AS mean,
      CASE WHEN z0 IS NULL THEN 'NaN'::DOUBLE ELSE round(r[floor(al)::INT + 1] + (r[least(floor(al)::INT + 2, k)] - r[floor(al)::INT + 1]) * (al - floor(al)), 8) END AS ci_low,
      CASE WHEN z0 IS NULL THEN 'NaN'::DOUBLE ELSE round(r[floor(ah)::INT + 1] + (r[least(floor(ah)::INT + 2, k)] - r[floor(ah)::INT + 1]) * (ah - floor(ah)), 8) END AS ci_high
    FROM ps"""


def _phi(z: str) -> str:
    """Normal distribution: the published rational form, for |z| below 7."""
    top = f"((((((3.52624965998911e-2 * abs({z}) + 0.700383064443688e0) * abs({z}) + 6.37396220353165e0) * abs({z}) + 33.912866078383e0) * abs({z}) + 112.079291497871e0) * abs({z}) + 221.213596169931e0) * abs({z}) + 220.206867912376e0)"
    low = f"(((((((8.83883476483184e-2 * abs({z}) + 1.75566716318264e0) * abs({z}) + 16.064177579207e0) * abs({z}) + 86.7807322029461e0) * abs({z}) + 296.564248779674e0) * abs({z}) + 637.333633378831e0) * abs({z}) + 793.826512519948e0) * abs({z}) + 440.413735824752e0)"
    return f"CASE WHEN {z} > 7 THEN 1e0 WHEN {z} < -7 THEN 0e0 WHEN {z} > 0 THEN 1e0 - exp(-5e-1 * {z} * {z}) * {top} / {low} ELSE exp(-5e-1 * {z} * {z}) * {top} / {low} END"


# Normal quantiles of i / 20 for the 10 resamples (fixed values, 15 places), and of 0.975.
_Z = [1.644853626951472, 1.281551565544600, 1.036433389493790, 0.841621233572914, 0.674489750196082,
      0.524400512708041, 0.385320466407568, 0.253347103135800, 0.125661346855074]
_Z0 = "list_value(" + ", ".join(f"{v!r}e0" for v in [-z for z in _Z] + [0.0] + _Z[::-1]) + ")[below]"
_BOOT = (_BOOT.replace("Z0TABLE", _Z0).replace("ZTAIL", "1.959963984540054e0")
         .replace("PHI_zl", _phi("zl")).replace("PHI_zh", _phi("zh")))

SQL["trace_tsv"] = f"""{WC}, {CHOICE}, {REPAIRED}
    SELECT q, action::BIGINT AS action, failure_label, verified_label, kg_consistency, query_entailment, response_entailment,
           round(latency, 6) AS latency, round(vram, 6) AS vram FROM rep"""
SQL["trace_reload_rewards"] = f"""{WC}, {CHOICE}, {REPAIRED}
    SELECT q, action::BIGINT AS action, failure_label, params_json, round(total_reward, 6) AS total_reward FROM rep"""

SQL["bootstrap_ci"] = W + _BOOT.replace("TRACES", "diag")
SQL["post_bootstrap_ci"] = f"{WC}, {CHOICE}, {REPAIRED}" + _BOOT.replace("TRACES", "rep")
_POST = f"""{WC}, {CHOICE}, {REPAIRED},
    post AS (SELECT r.*, d.gt_label, lower(d.gt_label) = lower(r.verified_label) AS em FROM rep r JOIN diagem d USING (q))"""
SQL["post_consistency_rate"] = _POST + """ SELECT failure_label,
    round(avg((kg_consistency = 'CONSISTENT')::INT::DOUBLE), 6) AS consistency_rate,
    round(avg(em::INT::DOUBLE), 6) AS em_rate, count(*) AS n FROM post GROUP BY ROLLUP (failure_label)"""
SQL["post_diagnostic_counts"] = _POST + """ SELECT em, "column", value, count(*) AS n FROM (
    UNPIVOT (SELECT em, kg_consistency, query_entailment, response_entailment, failure_label, gt_label, verified_label FROM post)
    ON kg_consistency, query_entailment, response_entailment, failure_label, gt_label, verified_label
    INTO NAME "column" VALUE value) GROUP BY ALL"""
