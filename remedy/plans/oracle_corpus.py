"""DuckDB oracle SQL for the corpus / text queries."""

from remedy.functions.prompts import LABEL_SENTENCES, TEMPLATES
from remedy.plans.oracle_diagnosis import BASE
from remedy.plans.oracle_retrieval import BM25, CHUNKS, PASSAGES, QUESTIONS, ranked


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DECODE = ("replace(replace(replace(replace(replace(replace(replace({x}, '-LRB-', '('), '-RRB-', ')'), "
          "'-LSB-', '['), '-RSB-', ']'), '-LCB-', '{{'), '-RCB-', '}}'), '-COLON-', ':')")


def decode(x: str) -> str:
    return DECODE.format(x=x)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    return strip(decode(f"translate({x}, chr(9) || chr(10), '  ')"))


LINES = ("array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (i - 1)::VARCHAR || chr(9) || x), chr(10))")

PAGES = f"wpages AS (SELECT doc_id::VARCHAR AS page_id, text, {LINES} AS lines FROM documents)"


def split_sents(x: str) -> str:
    return (f"list_slice(string_split_regex(chr(10) || {strip(decode(x))}, '\\n\\d+\\t'), 2, "
            f"len(string_split_regex(chr(10) || {strip(decode(x))}, '\\n\\d+\\t')))")


SENTS = PAGES + f""",
sents AS (SELECT page_id AS page, (i - 1)::INT AS sent_idx, s AS sentence
          FROM (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1) AS i
                FROM (SELECT page_id, {split_sents('lines')} AS l FROM wpages)))"""

LABELMAP = "CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LABEL_SENTENCES.items()) + " END"

ESC = ("replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
       "chr(9), '\\t'), chr(13), '\\r')")

REPLIES = f"""u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
pr AS (SELECT u.conv_id, u.turn, u.question, a.answer,
              ['SUPPORTS','REFUTES','NOTENOUGHINFO'][1 + ((u.conv_id + u.turn) % 3)::INT] AS lab
       FROM u JOIN a USING (conv_id, turn)),
js AS (SELECT *, '{{"label": "' || lab || '", "response": "' || {ESC.format(x='answer')} || '"}}' AS j FROM pr),
replies AS (SELECT conv_id, turn, question, answer,
               CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN 'Empty Response'
                    WHEN (conv_id * 31 + turn) % 7 = 0 THEN '```json' || chr(10) || j || chr(10) || '```'
                    ELSE j END AS reply FROM js),
rs AS (SELECT *, {strip('reply')} AS r FROM replies),
rx AS (SELECT *, r = 'Empty Response' AS empty, regexp_extract(r, '(?s)\\{{.*\\}}', 0) AS jx FROM rs),
parsed AS (SELECT conv_id, turn, question, reply,
             CASE WHEN empty THEN 'NOTENOUGHINFO' WHEN jx <> '' AND json_valid(jx) THEN json_extract_string(jx, '$.label') END AS label,
             CASE WHEN empty THEN 'Context is not sufficient.' WHEN jx <> '' AND json_valid(jx) THEN json_extract_string(jx, '$.response') END AS response,
             empty OR (jx <> '' AND json_valid(jx)) AS parse_ok FROM rx)"""

TEMPLATES_SQL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(n)}, {q(x)})" for (t, n), x in TEMPLATES.items()) + ") v(task, template, text))"

FACTS = """facts AS (
  SELECT 0 AS kind, n.n_nationkey::BIGINT AS key, n.n_name AS s, 'part of' AS r, rg.r_name AS o,
         0 * 1000000000000 + n.n_nationkey::BIGINT AS fact_id
  FROM nation n JOIN region rg ON n.n_regionkey = rg.r_regionkey
  UNION ALL
  SELECT 1, s.s_suppkey, s.s_name, 'located in', n.n_name, 1 * 1000000000000 + s.s_suppkey
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  UNION ALL
  SELECT 2, c.c_custkey, c.c_name, 'located in', n.n_name, 2 * 1000000000000 + c.c_custkey
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def lin(s, r, o):
    return f"'<triplet> ' || {s} || ' <subj> ' || {o} || ' <obj> ' || {r}"


def squeeze(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def decode_triples_sql(src: str, idc: str, textc: str) -> str:
    return f"""dt0 AS (SELECT {idc} AS tid, replace(replace(replace({textc}, '<s>', ''), '<pad>', ''), '</s>', '') AS t FROM {src}),
dt1 AS (SELECT tid, (i - 2)::INT AS t_idx, seg FROM (SELECT tid, unnest(string_split(t, '<triplet>')) AS seg,
           generate_subscripts(string_split(t, '<triplet>'), 1) AS i FROM dt0) WHERE i >= 2),
dt2 AS (SELECT tid, t_idx, parts[1] AS subj, (j - 2)::INT AS p_idx, pair FROM
          (SELECT tid, t_idx, string_split(seg, '<subj>') AS parts, unnest(string_split(seg, '<subj>')) AS pair,
                  generate_subscripts(string_split(seg, '<subj>'), 1) AS j FROM dt1) WHERE j >= 2),
dt3 AS (SELECT tid, t_idx, p_idx, {squeeze('subj')} AS s, {squeeze("string_split(pair, '<obj>')[-1]")} AS r,
               {squeeze("string_split(pair, '<obj>')[1]")} AS o
        FROM dt2 WHERE len(string_split(pair, '<obj>')) >= 2),
dt AS (SELECT * FROM dt3 WHERE s <> '' AND r <> '' AND o <> '')"""


LINEARISED = FACTS + f""",
one AS (SELECT fact_id AS text_id, '<s>' || {lin('s', 'r', 'o')} || '</s>' AS text FROM facts),
multi AS (SELECT (-1 - rg.r_regionkey)::BIGINT AS text_id,
                 '<s>' || string_agg({lin('n.n_name', "'part of'", 'rg.r_name')}, ' ' ORDER BY n.n_nationkey) || '</s>' AS text
          FROM nation n JOIN region rg ON n.n_regionkey = rg.r_regionkey GROUP BY rg.r_regionkey),
lin AS (SELECT * FROM one UNION ALL SELECT * FROM multi)"""

CLAIMS = QUESTIONS + """,
gp AS (SELECT DISTINCT b.item_id AS q_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gl AS (SELECT gp.q_id, gp.doc_id,
              length(left(d.text, instr(d.text, qs.question) - 1)) - length(replace(left(d.text, instr(d.text, qs.question) - 1), chr(10), '')) AS line
       FROM gp JOIN documents d USING (doc_id) JOIN questions qs USING (q_id)),
ev AS (SELECT q_id AS claim_id, 0 AS set_idx, doc_id::VARCHAR AS page, line::INT AS sent_idx FROM gl
       UNION ALL
       SELECT q_id, 0, 'missing-' || q_id::VARCHAR, 0
       FROM questions WHERE q_id % 7 = 3)"""

SQL = {
    "decode_brackets": f"SELECT doc_id, {decode('text')} AS text FROM documents",
    "clean_passage": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "split_sentences": f"WITH {SENTS} SELECT page, sent_idx, sentence FROM sents",
    "join_sentences": f"""WITH {PAGES} SELECT page_id,
        {strip("translate(array_to_string(" + split_sents('lines') + ", ' '), chr(9), ' ')")} AS text FROM wpages""",
    "label_sentence": f"WITH {BASE} SELECT q, gt_label, {LABELMAP.format(x='gt_label')} AS ground_truth FROM diag",
    "parse_reply": f"WITH {REPLIES} SELECT conv_id, turn, label, response, parse_ok FROM parsed",
    "clean_short_answer": f"""WITH {REPLIES} SELECT conv_id, turn,
        CASE WHEN r = 'Empty Response' THEN 'The provided context is insufficient.' ELSE replace(r, 'Response 1: ', '') END AS answer
        FROM rs""",
    "render_prompt": f"""WITH {BM25}, {ranked(5)}, {TEMPLATES_SQL},
        rt AS (SELECT r.q_id, r.rank, c.text FROM ranked r JOIN chunks c USING (doc_id, pos)),
        b AS (SELECT q_id, rank, text, (coalesce(sum(length(text)) OVER (PARTITION BY q_id ORDER BY rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000)::BIGINT AS pack FROM rt),
        packs AS (SELECT q_id, pack, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY q_id, pack)
        SELECT p.q_id, p.pack, t.task, t.template,
               replace(replace(t.text, '{{context_str}}', p.context), '{{query_str}}', qs.question) AS prompt
        FROM packs p JOIN questions qs USING (q_id) CROSS JOIN tpl t""",
    "decode_triples": f"WITH {LINEARISED}, {decode_triples_sql('lin', 'text_id', 'text')} SELECT tid AS text_id, t_idx, p_idx, s, r, o FROM dt",
    "triple_query": f"WITH {FACTS} SELECT fact_id, '[subject:' || s || '] - [predicate:' || r || '] - [object:' || o || ']' AS query FROM facts",
    "triple_export": f"""WITH {FACTS} SELECT fact_id, s || ' ' || r || ' ' || o || ' || SUBJECT: ' || s || ' || PREDICATE: ' || r
        || ' || OBJECT: ' || o || ' ' AS line FROM facts""",
    "cap_triples": f"""WITH {FACTS},
        ch AS (SELECT o || ':' || (key // 16)::VARCHAR AS chunk, string_agg({lin('s', 'r', 'o')}, ' ' ORDER BY key) AS text
               FROM facts WHERE kind = 2 GROUP BY 1),
        {decode_triples_sql('ch', 'chunk', 'text')}
        SELECT tid AS chunk, t_idx, s, r, o FROM dt WHERE t_idx < 10""",
    "explode_evidence": f"WITH {CLAIMS} SELECT claim_id, set_idx::INT AS set_idx, page, sent_idx FROM ev",
    "inverse_evidence": f"WITH {CLAIMS} SELECT page, claim_id, count(*) AS n_refs FROM ev GROUP BY page, claim_id",
    "evidence_semi": f"WITH {CLAIMS}, {PAGES} SELECT page_id FROM wpages WHERE page_id IN (SELECT page FROM ev)",
    "evidence_sentences": f"""WITH {CLAIMS}, {SENTS}
        SELECT DISTINCT ev.claim_id, translate(s.sentence, chr(9), ' ') AS sentence
        FROM ev JOIN sents s ON s.page = ev.page AND s.sent_idx = ev.sent_idx""",
    "evidence_missing": f"""WITH {CLAIMS}, {SENTS}
        SELECT claim_id, set_idx::INT AS set_idx, page, sent_idx FROM ev
        WHERE NOT EXISTS (SELECT 1 FROM sents s WHERE s.page = ev.page AND s.sent_idx = ev.sent_idx)""",
    "split_range": """SELECT event_id AS q, CASE WHEN rn <= 1000 THEN 'train' ELSE 'validation' END AS split
        FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) WHERE rn <= 2000""",
    "corpus_cap": f"SELECT doc_id, {clean('text')} AS text FROM documents ORDER BY doc_id LIMIT 100000",
    "corpus_refresh": f"""WITH {PASSAGES},
        p AS (SELECT ps.doc_id, d.lang FROM passages ps JOIN documents d USING (doc_id)),
        vs AS (SELECT unnest(range(1, 4))::INT AS v),
        smp AS (SELECT v, doc_id FROM vs, p WHERE p.lang <> 'en'
                QUALIFY row_number() OVER (PARTITION BY v ORDER BY md5('42|' || v::VARCHAR || '|' || doc_id::VARCHAR), doc_id) <= 100)
        SELECT v AS kb_version, 'primary' AS origin, doc_id FROM vs, p WHERE p.lang = 'en'
        UNION ALL
        SELECT w.v, 'secondary', doc_id FROM smp JOIN (SELECT v FROM vs) w ON w.v >= smp.v
        WHERE ('0x' || substr(md5('42|' || smp.v::VARCHAR), 1, 8))::BIGINT / 4294967296e0 <= 5e-1""",
    "corpus_counts": f"""WITH {CHUNKS}, {CLAIMS}, {PAGES}
        SELECT 'documents' AS stage, count(*) AS n FROM documents
        UNION ALL SELECT 'unique_passages', count(*) FROM passages
        UNION ALL SELECT 'chunks', count(*) FROM chunks
        UNION ALL SELECT 'claims', count(*) FROM questions
        UNION ALL SELECT 'evidence_rows', count(*) FROM ev
        UNION ALL SELECT 'evidence_pages', count(DISTINCT page) FROM ev
        UNION ALL SELECT 'kb_pages', count(*) FROM wpages WHERE page_id IN (SELECT page FROM ev)""",
    "epoch_order": """SELECT epoch, item_id AS q_id,
        (row_number() OVER (PARTITION BY epoch ORDER BY md5('42|' || epoch::VARCHAR || '|' || item_id::VARCHAR), item_id) - 1)::BIGINT AS step
        FROM benchmark, (SELECT unnest(range(1, 3))::BIGINT AS epoch)""",
    "sample_replace": """WITH r AS (SELECT item_id AS q_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark),
        n AS (SELECT count(*) AS n FROM benchmark),
        d AS (SELECT draw, floor(('0x' || substr(md5('42|' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296e0 * n)::BIGINT AS pos
              FROM (SELECT unnest(range(200))::BIGINT AS draw), n)
        SELECT d.draw, r.q_id FROM d JOIN r USING (pos)""",
}

# nli_pairs: BM25 over conversation questions (q_id = conv_id * 1000 + turn).
_NLI_BM25 = BM25.replace(QUESTIONS, "questions AS (SELECT conv_id * 1000 + turn AS q_id, question FROM parsed)")
SQL["nli_pairs"] = f"""WITH {REPLIES}, {_NLI_BM25}, {ranked(3)},
    rt AS (SELECT r.q_id, r.rank, c.text FROM ranked r JOIN chunks c USING (doc_id, pos)),
    pq AS (SELECT conv_id * 1000 + turn AS q_id, question, response FROM parsed)
    SELECT rt.q_id, (rt.rank - 1)::INT AS r, 'query' AS side, rt.text AS premise, pq.question AS hypothesis FROM rt JOIN pq USING (q_id)
    UNION ALL
    SELECT rt.q_id, (rt.rank - 1)::INT, 'response', rt.text, pq.response FROM rt JOIN pq USING (q_id)"""

SQL["eval_projection"] = f"""WITH {REPLIES}, {_NLI_BM25}, {ranked(3)},
    cx AS (SELECT r.q_id, list(c.text ORDER BY r.rank) AS contexts FROM ranked r JOIN chunks c USING (doc_id, pos) GROUP BY r.q_id),
    gl AS (SELECT *, ['SUPPORTS','REFUTES','NOTENOUGHINFO'][1 + (conv_id % 3)::INT] AS gold FROM parsed)
    SELECT conv_id, turn, coalesce(question, '') AS question, coalesce(response, '') AS answer,
      coalesce({LABELMAP.format(x='gold')}, '') AS ground_truth, coalesce(contexts, []::VARCHAR[]) AS contexts
    FROM gl LEFT JOIN cx ON cx.q_id = gl.conv_id * 1000 + gl.turn"""

SQL["stream_reindex"] = "WITH " + BM25.replace(
    "FROM pieces WHERE len(p) > 0))", "FROM pieces WHERE len(p) > 0))").replace(
    "pieces AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM passages)",
    "pieces AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM documents)") + """
    SELECT doc_id, pos, term, tf, dl::INT AS dl FROM post"""

SQL["stream_bm25_topk"] = "WITH " + BM25.replace(
    "pieces AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM passages)",
    "pieces AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM documents)") + f""", {ranked(5)}
    SELECT q_id, doc_id, pos, score, rank FROM ranked"""
SQL["repair_reply"] = f"""WITH {REPLIES} SELECT conv_id, turn, ['SUPPORTS','REFUTES','NOTENOUGHINFO'][1 + (conv_id % 3)::INT] AS label,
    answer AS response, true AS parse_ok FROM pr"""
SQL["normalize_id"] = "SELECT doc_id::VARCHAR AS page_id, doc_id::VARCHAR AS norm_id, sha256(nfc_normalize(text)) AS text_digest FROM documents"

SQL["src_pages"] = f"WITH {PAGES} SELECT page_id AS id, text, lines FROM wpages"
SQL["src_multihop"] = """SELECT DISTINCT replace(d.text, chr(10), '') AS passage
    FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""
SQL["kb_artifact"] = f"""WITH {CLAIMS}, {PAGES}
    SELECT page_id AS doc_id, {clean('text')} AS text, {split_sents('lines')} AS sentences
    FROM wpages WHERE page_id IN (SELECT page FROM ev)"""
SQL["src_claims"] = f"""WITH {CLAIMS},
    ids AS (SELECT q_id, question, ['SUPPORTS','REFUTES','NOT ENOUGH INFO'][1 + (q_id % 3)::INT] AS label, q_id::VARCHAR AS i FROM questions),
    found AS (SELECT ids.*, [[[i, i, gl.doc_id::VARCHAR, gl.line::VARCHAR], [i, i, gl.doc_id::VARCHAR, (gl.line + 1)::VARCHAR]]] AS evidence
              FROM ids JOIN gl USING (q_id)),
    bare AS (SELECT ids.*, [[[i, NULL, NULL, NULL]]] AS evidence FROM ids WHERE q_id NOT IN (SELECT q_id FROM gl)),
    miss AS (SELECT ids.*, [[[i, i, 'missing-' || i, '0']]] AS evidence FROM ids WHERE q_id % 7 = 3)
    SELECT q_id AS id, question AS claim, label, evidence
    FROM (SELECT * FROM found UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM miss)"""
SQL["index_tables"] = f"WITH {BM25} SELECT doc_id, pos, term, tf, dl::INT AS dl FROM post"
SQL["src_slices"] = f"""WITH {PAGES} SELECT page_id AS id, text, lines FROM wpages
    WHERE page_id::BIGINT // 50 IN (SELECT DISTINCT doc_id // 50 AS part FROM documents ORDER BY part LIMIT 2)"""
