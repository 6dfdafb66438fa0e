"""DuckDB oracle SQL for the knowledge-triple and policy queries."""

from remedy.plans.oracle_diagnosis import ACTIONS, BASE, CAND, CHOICE

VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


KFACTS = VEC + """,
nvec AS (SELECT count(*) AS nv FROM embeddings),
kf AS (
  SELECT 0 * 1000000000000 + n.n_nationkey::BIGINT AS fact_id, (10 + n.n_nationkey) % (nv - 2) AS s_row, nv - 2 AS r_row,
         (0 + rg.r_regionkey) % (nv - 2) AS o_row
  FROM nation n JOIN region rg ON n.n_regionkey = rg.r_regionkey, nvec
  UNION ALL
  SELECT 1 * 1000000000000 + s.s_suppkey, (50 + s.s_suppkey) % (nv - 2), nv - 1, (10 + n.n_nationkey) % (nv - 2)
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey, nvec
  UNION ALL
  SELECT 2 * 1000000000000 + c.c_custkey, (200 + c.c_custkey) % (nv - 2), nv - 1, (10 + n.n_nationkey) % (nv - 2)
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey, nvec),
fv AS (SELECT f.fact_id, s.v AS s_v, r.v AS r_v, o.v AS o_v, list_concat(list_concat(s.v, r.v), o.v) AS v
       FROM kf f JOIN v s ON s.vec_id = f.s_row JOIN v r ON r.vec_id = f.r_row JOIN v o ON o.vec_id = f.o_row),
answers AS (SELECT c.c_custkey AS answer_id,
                   CASE WHEN c.c_custkey % 13 = 0 THEN '' ELSE c.c_name || ' is located in ' || n.n_name END AS answer_text,
                   (200 + c.c_custkey) % (nv - 2) AS s_row, nv - 1 AS r_row, (10 + n.n_nationkey) % (nv - 2) AS o_row
            FROM customer c JOIN nation n ON n.n_nationkey = (c.c_nationkey + CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 25, nvec),
av AS (SELECT a.answer_id, s.v AS s_v, r.v AS r_v, o.v AS o_v, list_concat(list_concat(s.v, r.v), o.v) AS v
       FROM answers a JOIN v s ON s.vec_id = a.s_row JOIN v r ON r.vec_id = a.r_row JOIN v o ON o.vec_id = a.o_row
       WHERE a.answer_text <> '' AND a.answer_id % 17 <> 0),
kc AS (SELECT a.answer_id, f.fact_id, round(""" + sqdist("a.v", "f.v") + """, 6) AS score FROM av a, fv f
       QUALIFY row_number() OVER (PARTITION BY a.answer_id ORDER BY score, f.fact_id) <= 3),
kcr AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY score, fact_id)::INT AS rank FROM kc),
ks AS (SELECT k.answer_id, k.fact_id,
              CASE WHEN """ + dot("a.s_v", "f.s_v") + """ < 9e-1 THEN 'MISSING'
                   WHEN """ + dot("a.r_v", "f.r_v") + """ < 9e-1 THEN 'MISSING'
                   WHEN """ + dot("a.o_v", "f.o_v") + """ < 1e-1 THEN 'CONFLICT' ELSE 'CONSISTENT' END AS status
       FROM kc k JOIN av a USING (answer_id) JOIN fv f USING (fact_id)),
kr AS (SELECT a.answer_id, CASE min(CASE s.status WHEN 'CONSISTENT' THEN 1 WHEN 'CONFLICT' THEN 2 WHEN 'MISSING' THEN 3 END)
                              WHEN 1 THEN 'CONSISTENT' WHEN 2 THEN 'CONFLICT' ELSE 'MISSING' END AS status
       FROM av a LEFT JOIN ks s USING (answer_id) GROUP BY a.answer_id),
ka AS (SELECT a.answer_id,
              CASE WHEN coalesce(bool_or(r.status = 'CONFLICT'), false) THEN 'CONFLICT'
                   WHEN coalesce(bool_or(r.status = 'MISSING'), false) THEN 'MISSING'
                   WHEN length(a.answer_text) = 0 THEN 'EMPTYINPUT'
                   WHEN count(r.answer_id) = 0 THEN 'NOTRIPLETS' ELSE 'CONSISTENT' END AS consistency
       FROM answers a LEFT JOIN kr r USING (answer_id) GROUP BY a.answer_id, a.answer_text)"""

ONEHOTS = """list_transform(['NO_FAILURE','WRONG_PREDICATE_FAILURE','INSUFFICIENT_EVIDENCE_FAILURE','WRONG_RESPONSE_FAILURE','LABEL_EVIDENCE_MISMATCH_FAILURE'], lambda l: (l = ch.failure_label)::DOUBLE),
 list_transform(['CONSISTENT','CONFLICT','MISSING','EMPTYINPUT','NOTRIPLETS'], lambda l: (l = ch.kg_consistency)::DOUBLE)),
 list_transform(['ENTAILMENT','CONTRADICTION','NEUTRAL'], lambda l: (l = ch.query_entailment)::DOUBLE)),
 list_transform(['ENTAILMENT','CONTRADICTION','NEUTRAL'], lambda l: (l = ch.response_entailment)::DOUBLE)),
 [greatest(0e0, (6e0 - ch.vram) / 1e5), greatest(0e0, (3e0 - ch.latency) / 1e4)])"""

DIAGX = "list_concat(list_concat(list_concat(list_concat(" + ONEHOTS
FULLX = "list_concat(e.v, " + DIAGX + ")"

POL = f"""WITH {BASE}, {CAND}, {ACTIONS}, {CHOICE}, {VEC},
ctx AS (SELECT ch.q, ch.chosen_arm, ch.verified_label = 'UNVERIFIED' AS retriever_only, {FULLX} AS x
        FROM choice ch JOIN v e ON e.vec_id = ch.q % (SELECT count(*) FROM embeddings) WHERE ch.failure_label <> 'NO_FAILURE'),
ctx18 AS (SELECT ch.q, ch.chosen_arm, ch.verified_label = 'UNVERIFIED' AS retriever_only, {DIAGX} AS x
          FROM choice ch WHERE ch.failure_label <> 'NO_FAILURE'),
lg AS (SELECT c.q AS step, c.chosen_arm AS arm, c.x, cd.total_reward AS r FROM ctx c JOIN cand cd ON cd.q = c.q AND cd.arm = c.chosen_arm),
lg18 AS (SELECT c.q AS step, c.chosen_arm AS arm, c.x, cd.total_reward AS r FROM ctx18 c JOIN cand cd ON cd.q = c.q AND cd.arm = c.chosen_arm),
tsf AS (SELECT a.arm::BIGINT AS arm, 1 + coalesce(s.s, 0e0) AS alpha, 1 + coalesce(s.n - s.s, 0e0) AS beta
        FROM actions a LEFT JOIN (SELECT arm, sum(CASE WHEN r < 4e-1 THEN 0e0 ELSE 1e0 END) AS s, count(*) AS n
                                  FROM lg18 GROUP BY arm) s ON s.arm = a.arm),
uf AS (SELECT a.arm::BIGINT AS arm, coalesce(s.n, 0)::BIGINT AS pulls, coalesce(s.m, 0e0) AS mean_reward
       FROM actions a LEFT JOIN (SELECT arm, count(*) AS n, avg(r) AS m FROM lg18 GROUP BY arm) s ON s.arm = a.arm),
uft AS (SELECT *, (sum(pulls) OVER ())::BIGINT AS total_pulls FROM uf),
mb AS (SELECT arm, i, sum(r * x[i]) AS b FROM lg18, range(1, 19) t(i) GROUP BY arm, i),
mg AS (SELECT arm, i, j, sum(x[i] * x[j]) AS g FROM lg18, range(1, 19) t(i), range(1, 19) u(j) GROUP BY arm, i, j),
ks1 AS (SELECT c.q, b.arm, sum(c.x[b.i] * b.b) AS s1 FROM ctx18 c, mb b GROUP BY c.q, b.arm),
ks2 AS (SELECT c.q, g.arm, sum(c.x[g.i] * c.x[g.j] * g.g) AS s2 FROM ctx18 c, mg g GROUP BY c.q, g.arm),
kx AS (SELECT q, retriever_only, {dot('x', 'x')} AS kxx FROM ctx18),
kus AS (SELECT kx.q, a.arm::BIGINT AS arm, kx.retriever_only,
               CASE WHEN s1.s1 IS NULL THEN 1e0 * sqrt(kx.kxx)
                    ELSE s1.s1 / (1e-5 + s2.s2) + 1e0 * sqrt(greatest(0e0, kx.kxx - s2.s2 / (1e-5 + s2.s2))) END AS score
        FROM kx CROSS JOIN actions a LEFT JOIN ks1 s1 ON s1.q = kx.q AND s1.arm = a.arm
        LEFT JOIN ks2 s2 ON s2.q = kx.q AND s2.arm = a.arm),
nlw AS (SELECT a.arm::BIGINT AS arm, t.i, coalesce(mb.b / greatest(n.n, 1), 0e0) AS w
        FROM actions a CROSS JOIN range(1, 19) t(i) LEFT JOIN mb ON mb.arm = a.arm AND mb.i = t.i
        LEFT JOIN (SELECT arm, count(*) AS n FROM lg18 GROUP BY arm) n ON n.arm = a.arm),
nls AS (SELECT c.q, w.arm, any_value(c.retriever_only) AS retriever_only,
               round(sum(c.x[w.i] * w.w) + 1e0 * sqrt(any_value(kx.kxx)), 6) AS score
        FROM ctx18 c JOIN kx USING (q) CROSS JOIN nlw w GROUP BY c.q, w.arm)"""

SQL = {
    "triple_topk": f"WITH {KFACTS} SELECT answer_id, fact_id, rank, score FROM kcr",
    "triple_status": f"WITH {KFACTS} SELECT answer_id, fact_id, status FROM ks",
    "triple_rollup": f"WITH {KFACTS} SELECT answer_id, status FROM kr",
    "answer_consistency": f"WITH {KFACTS} SELECT answer_id, consistency FROM ka",
    "consistency_counts": f"WITH {KFACTS} SELECT consistency, count(*) AS n FROM ka GROUP BY consistency",
    "context_vector": POL + """ SELECT q, len(x)::INT AS dims, round(list_sum(x), 6) AS vec_sum,
        round(list_sum(list_transform(x, lambda z: z * z)), 6) AS vec_sumsq,
        round(list_sum(list_transform(x, lambda z, i: z * i)), 6) AS vec_wsum FROM ctx""",
    "linucb_fit": POL + """ SELECT arm, (i - 1)::INT AS i, (j - 1)::INT AS j,
          round(sum(x[i] * x[j]) + CASE WHEN i = j THEN 1e0 ELSE 0e0 END, 9) AS value
        FROM lg, range(1, 83) t(i), range(1, 83) u(j) GROUP BY arm, i, j
        UNION ALL SELECT arm, (i - 1)::INT, -1, round(sum(r * x[i]), 9) FROM lg, range(1, 83) t(i) GROUP BY arm, i""",
    "thompson_fit": POL + " SELECT arm, alpha, beta FROM tsf",
    "thompson_mean": POL + """ SELECT c.q, t.arm FROM ctx18 c, tsf t WHERE NOT c.retriever_only OR t.arm < 8
        QUALIFY row_number() OVER (PARTITION BY c.q ORDER BY t.alpha / (t.alpha + t.beta) DESC, t.arm) = 1""",
    "ucb_fit": POL + " SELECT arm, pulls, round(mean_reward, 6) AS mean_reward, total_pulls FROM uft",
    "ucb_score": POL + """, us AS (SELECT *, CASE WHEN pulls = 0 THEN NULL ELSE mean_reward + sqrt(2 * ln(total_pulls::DOUBLE) / pulls) END AS ucb FROM uft),
        ch AS (SELECT arm AS c FROM us ORDER BY (pulls = 0) DESC, coalesce(ucb, 0e0) DESC, arm LIMIT 1)
        SELECT arm, pulls, round(ucb, 6) AS ucb, arm = (SELECT c FROM ch) AS is_choice FROM us""",
    "kernelucb_score": POL + " SELECT q, arm, round(score, 6) AS score FROM kus",
    "arm_argmax": POL + """ SELECT q, arm FROM kus WHERE NOT retriever_only OR arm < 8
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, arm) = 1""",
    "neural_linear_score": POL + """ SELECT q, arm, score FROM nls WHERE NOT retriever_only OR arm < 8
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, arm) = 1""",
}

SQL["stream_policy"] = POL + """ SELECT arm, count(*) AS pulls, round(sum(r), 9) AS sum_reward,
    1 + sum(CASE WHEN r < 4e-1 THEN 0e0 ELSE 1e0 END) AS alpha, 1 + sum(1e0 - CASE WHEN r < 4e-1 THEN 0e0 ELSE 1e0 END) AS beta
    FROM lg18 GROUP BY arm"""
SQL["stream_diagnose"] = "WITH " + BASE + """ SELECT q, failure_label, verified_label, round(total_reward, 6) AS total_reward FROM diag"""

SQL["policy_io"] = POL + " SELECT arm, alpha, beta, 'thompsonsampling' AS method, 'fever' AS variant FROM tsf"

# The SGD fold: per arm the logged rows in step order, w := w + lr * (r - w.x) * x.
_EPS = POL + """,
seq AS (SELECT arm, list({'x': x, 'r': r} ORDER BY step) AS l FROM lg18 GROUP BY arm),
eps AS (SELECT a.arm::BIGINT AS arm, CASE WHEN s.l IS NULL THEN list_transform(range(18), lambda i: 0e0) ELSE
          list_reduce(list_concat([{'x': list_transform(range(18), lambda i: 0e0), 'r': 0e0}], s.l),
            lambda w, e: {'x': list_transform(list_zip(w.x, e.x), lambda z: z[1] + 1e-2 * (e.r - list_sum(list_transform(list_zip(w.x, e.x), lambda y: y[1] * y[2]))) * z[2]),
                          'r': 0e0}).x END AS w
        FROM actions a LEFT JOIN seq s ON s.arm = a.arm)"""
SQL["epsgreedy_fit"] = _EPS + """ SELECT arm, 18 AS dims, round(sqrt(list_sum(list_transform(w, lambda z: z * z))), 6) AS w_norm,
    list_transform(w, lambda z: round(z, 8)) AS w FROM eps"""

SQL["answer_consistency_short"] = "WITH " + KFACTS.replace("< 1e-1 THEN 'CONFLICT'", "< 5e-1 THEN 'CONFLICT'") + " SELECT answer_id, consistency FROM ka"

SQL["stream_epsgreedy"] = _EPS + """ SELECT e.arm, p.pulls, list_transform(e.w, lambda z: round(z, 8)) AS w
    FROM eps e JOIN (SELECT arm, count(*) AS pulls FROM lg18 GROUP BY arm) p USING (arm)"""
SQL["epsgreedy_choice"] = _EPS + f""",
    sc AS (SELECT c.q, e.arm, {dot('c.x', 'e.w')} AS s FROM ctx18 c, eps e),
    best AS (SELECT q, arm FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, arm) = 1),
    u AS (SELECT q, arm, ('0x' || substr(md5('42:eps|' || q::VARCHAR), 1, 8))::BIGINT / 4294967296e0 AS u1,
            ('0x' || substr(md5('42:eps-arm|' || q::VARCHAR), 1, 8))::BIGINT / 4294967296e0 AS u2 FROM best)
    SELECT q, CASE WHEN u1 < 1.e-01 THEN floor(u2 * 11)::BIGINT ELSE arm END AS arm, u1 < 1.e-01 AS explored FROM u"""
