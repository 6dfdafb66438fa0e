"""DuckDB oracle SQL for the retrieval queries (independent re-statement)."""

TERMS = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def terms(x: str) -> str:
    return TERMS.format(x=x)


# The stop words of the index.
STOP = ("('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such',"
        "'that','the','their','then','there','these','they','this','to','was','will','with')")


def index_terms(x: str) -> str:
    return f"list_filter({terms(x)}, lambda t: t NOT IN {STOP})"


PASSAGES = "passages AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"

CHUNKS = PASSAGES + """,
pieces AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM passages),
chunks AS (
  SELECT doc_id, (s // 112)::INT AS pos,
         regexp_replace(array_to_string(list_slice(p, s + 1, s + 128), ''), '\\s+$', '') AS text
  FROM (SELECT doc_id, p, unnest(range(0, greatest(len(p) - 16, 1), 112)) AS s
        FROM pieces WHERE len(p) > 0))"""

QUESTIONS = "questions AS (SELECT item_id AS q_id, text AS question FROM benchmark)"

# English stemming of the distinct terms, step by step (w: word, p1 and p2: where the regions begin).
_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _longest(*suffixes: str) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$')"


def _rules(pairs: str) -> str:
    """'enci:ence ...' -> CASE arms on x, the suffix found; ':' alone takes it away."""
    return " ".join(f"WHEN x = '{a}' THEN b || '{c}'" for a, c in (r.split(":") for r in pairs.split()))


_TWO = ("ational:ate ization:ize fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate "
        "alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble")
_THREE = "ational:ate tional:tion alize:al icate:ic iciti:ic ical:ic ful: ness:"
_FOUR = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def stems(tokens: str, name: str = "stems") -> str:
    """CTEs that end in ``name`` (tok, term) for the distinct ``tok`` of a table."""
    return f"""
s0 AS (SELECT DISTINCT tok FROM {tokens}),
s1 AS (SELECT tok, regexp_replace(regexp_replace(tok, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_extract(w, '^(gener|commun|arsen|{_C}*{_V}+{_C})') = '' THEN length(w)
         ELSE length(regexp_extract(w, '^(gener|commun|arsen|{_C}*{_V}+{_C})')) END AS p1 FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_extract(substr(w, p1 + 1), '^{_C}*{_V}+{_C}') = '' THEN length(w)
         ELSE p1 + length(regexp_extract(substr(w, p1 + 1), '^{_C}*{_V}+{_C}')) END AS p2 FROM s2),
a1 AS (SELECT tok, p1, p2, CASE WHEN suffix(w, 'sses') THEN w[:-3] WHEN regexp_matches(w, '(ied|ies)$')
           THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
         WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN w[:-2] ELSE w END AS w FROM s3),
a2 AS (SELECT *, w IN ('inning','outing','canning','herring','earring','proceed','exceed','succeed') AS done,
         {_longest('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed')} AS x FROM a1),
a3 AS (SELECT *, substr(w, 1, length(w) - length(x)) AS b FROM a2),
a4 AS (SELECT tok, p1, p2, done, w AS before, CASE WHEN done OR x = '' THEN w
         WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(b) >= p1 THEN b || 'ee' ELSE w END
         WHEN NOT regexp_matches(b, '{_V}') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
         WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[:-2]
         WHEN length(b) = p1 AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END AS w FROM a3),
a5 AS (SELECT tok, p1, p2, done, before, regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i') AS w FROM a4),
b1 AS (SELECT *, {_longest(*[r.split(':')[0] for r in _TWO.split()], 'ogi', 'li')} AS x FROM a5),
b2 AS (SELECT *, substr(w, 1, length(w) - length(x)) AS b FROM b1),
b3 AS (SELECT tok, p1, p2, done, before, CASE WHEN x = '' OR length(b) < p1 THEN w {_rules(_TWO)}
         WHEN x = 'ogi' AND suffix(b, 'l') THEN b || 'og' WHEN x = 'li' AND regexp_matches(b, '[cdeghkmnrt]$') THEN b ELSE w END AS w FROM b2),
c1 AS (SELECT *, {_longest(*[r.split(':')[0] for r in _THREE.split()], 'ative')} AS x FROM b3),
c2 AS (SELECT *, substr(w, 1, length(w) - length(x)) AS b FROM c1),
c3 AS (SELECT tok, p1, p2, done, before, CASE WHEN x = '' OR length(b) < p1 THEN w {_rules(_THREE)}
         WHEN x = 'ative' AND length(b) >= p2 THEN b ELSE w END AS w FROM c2),
d1 AS (SELECT *, {_longest(*_FOUR, 'ion')} AS x FROM c3),
d2 AS (SELECT *, substr(w, 1, length(w) - length(x)) AS b FROM d1),
d3 AS (SELECT tok, p1, p2, done, before, CASE WHEN x <> '' AND length(b) >= p2 AND (x <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END AS w FROM d2),
e1 AS (SELECT *, w[:-2] AS b FROM d3),
e2 AS (SELECT tok, done, before, CASE WHEN suffix(w, 'e') AND (length(b) >= p2 OR length(b) >= p1 AND NOT regexp_matches(b, '{_SHORT}')) THEN b
         WHEN suffix(w, 'll') AND length(b) >= p2 THEN b ELSE w END AS w FROM e1),
{name} AS (SELECT tok, CASE WHEN length(tok) <= 2 THEN tok
    WHEN tok = 'skis' THEN 'ski' WHEN tok = 'skies' THEN 'sky' WHEN tok = 'dying' THEN 'die' WHEN tok = 'lying' THEN 'lie'
    WHEN tok = 'tying' THEN 'tie' WHEN tok = 'idly' THEN 'idl' WHEN tok = 'gently' THEN 'gentl' WHEN tok = 'ugly' THEN 'ugli'
    WHEN tok = 'early' THEN 'earli' WHEN tok = 'only' THEN 'onli' WHEN tok = 'singly' THEN 'singl'
    WHEN tok IN ('sky','news','howe','atlas','cosmos','bias','andes') THEN tok
    WHEN done THEN before ELSE replace(w, 'Y', 'y') END AS term FROM e2)"""


def bm25(chunks: str, questions: str = QUESTIONS, key: str = "doc_id, pos") -> str:
    """Scores of every (question, chunk) that share a stem; ``key`` names a chunk."""
    return chunks + ",\n" + questions + f""",
ct AS (SELECT {key}, {index_terms('text')} AS t FROM chunks),
dl AS (SELECT {key}, len(t) AS dl FROM ct),
toks AS (SELECT {key}, unnest(t) AS tok FROM ct),
qtoks AS (SELECT q_id, unnest({index_terms('question')}) AS tok FROM questions),
alltoks AS (SELECT tok FROM toks UNION SELECT tok FROM qtoks),{stems('alltoks')},
post AS (SELECT p.*, dl.dl FROM (SELECT {key}, term, count(*) AS tf FROM toks JOIN stems USING (tok) GROUP BY {key}, term) p
         JOIN dl USING ({key})),
dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n_chunks, avg(dl) AS avgdl FROM dl),
qt AS (SELECT DISTINCT q_id, term FROM qtoks JOIN stems USING (tok)),
idf AS (SELECT q_id, term, ln(1 + (n_chunks - df + 5e-1) / (df + 5e-1)) AS idf, avgdl
        FROM qt JOIN dfreq USING (term) CROSS JOIN st),
scores AS (SELECT q_id, {key},
                  round(sum(idf * tf * (15e-1 + 1) / (tf + 15e-1 * (1 - 75e-2 + 75e-2 * dl / avgdl))), 6) AS score
           FROM idf JOIN post USING (term) GROUP BY q_id, {key})"""


BM25 = bm25(CHUNKS)


def ranked(k: int, name: str = "ranked") -> str:
    return f"""{name} AS (SELECT q_id, doc_id, pos, score,
        row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, pos)::INT AS rank
        FROM scores QUALIFY rank <= {k})"""


GOLD = """gpairs AS (SELECT b.item_id AS q_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gold AS (SELECT DISTINCT q_id, question AS gold FROM gpairs JOIN questions USING (q_id)),
ngold AS (SELECT q.q_id, coalesce(g.n, 0) AS n_gold FROM questions q
          LEFT JOIN (SELECT q_id, count(*) AS n FROM gold GROUP BY q_id) g USING (q_id))"""

HITS = """rt AS (SELECT r.q_id, r.rank, r.doc_id, r.pos, c.text FROM ranked r JOIN chunks c USING (doc_id, pos)),
hits AS (SELECT rt.q_id, rt.rank, coalesce(bool_or(contains(rt.text, g.gold)), false) AS hit
         FROM rt LEFT JOIN gold g USING (q_id) GROUP BY rt.q_id, rt.rank)"""

EVAL = f"""WITH {BM25}, {ranked(5)}, {GOLD}, {HITS},
cum AS (SELECT q_id, rank, sum(hit::INT) OVER (PARTITION BY q_id ORDER BY rank) / rank AS p FROM hits),
cpa AS (SELECT q_id, sum(p) AS s, count(*) AS n, arg_max(p, rank) AS last FROM cum GROUP BY q_id),
found AS (SELECT g.q_id, g.gold, bool_or(contains(rt.text, g.gold)) AS f FROM gold g JOIN rt USING (q_id) GROUP BY g.q_id, g.gold),
fq AS (SELECT q_id, sum(f::INT)::DOUBLE AS found FROM found GROUP BY q_id),
nc AS (SELECT q_id, count(*) AS nc FROM ranked GROUP BY q_id),
nh AS (SELECT q_id, sum(hit::INT)::BIGINT AS n_hits FROM hits GROUP BY q_id),
ev AS (SELECT ng.q_id, ng.n_gold::BIGINT AS n_gold, coalesce(nh.n_hits, 0)::BIGINT AS n_hits,
  round(CASE WHEN ng.n_gold > 0 AND cpa.n > 0 THEN (cpa.s + (5 - cpa.n) * cpa.last) / 5 END, 6) AS context_precision,
  round(CASE WHEN ng.n_gold > 0 AND coalesce(nc.nc, 0) > 0 THEN coalesce(fq.found, 0) / ng.n_gold END, 6) AS context_recall
  FROM ngold ng LEFT JOIN cpa USING (q_id) LEFT JOIN fq USING (q_id) LEFT JOIN nc USING (q_id) LEFT JOIN nh USING (q_id))"""

SQL = {
    "retrieval_eval": EVAL + " SELECT * FROM ev",
    "context_precision": EVAL + " SELECT q_id, context_precision FROM ev",
    "context_recall": EVAL + " SELECT q_id, context_recall FROM ev",
    "dedupe_passages": f"WITH {PASSAGES} SELECT doc_id, text FROM passages",
    "chunk_windows": f"WITH {CHUNKS} SELECT doc_id, pos, text FROM chunks",
    "bm25_stats": f"WITH {BM25} SELECT term, df, n_chunks, round(avgdl, 6) AS avgdl FROM dfreq CROSS JOIN st",
    "bm25_topk": f"WITH {BM25}, {ranked(5)} SELECT q_id, doc_id, pos, score, rank FROM ranked",
    "gold_containment": f"WITH {QUESTIONS}, {GOLD} SELECT q_id, doc_id FROM gpairs",
    "precision_at_k": f"""WITH {BM25}, {ranked(5)}, {GOLD}, {HITS},
        ks AS (SELECT unnest(range(1, 6))::INT AS k)
        SELECT q_id, k, round(sum(hit::INT)::DOUBLE / count(*), 6) AS precision
        FROM hits JOIN ks ON rank <= k GROUP BY q_id, k""",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        d AS (SELECT a.vec_id AS q_id, b.vec_id,
                     round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score
              FROM v a, v b)
        SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id)::INT AS rank, score
        FROM d QUALIFY rank <= 5""",
    "rerank_topn": f"""WITH {BM25}, {ranked(10, 'cand')},
        qi AS (SELECT q_id, term, ln(1 + (n_chunks - df + 5e-1) / (df + 5e-1)) AS idf FROM qt JOIN dfreq USING (term) CROSS JOIN st),
        tot AS (SELECT q_id, sum(idf) AS tot FROM qi GROUP BY q_id),
        hit AS (SELECT c.q_id, c.doc_id, c.pos, sum(qi.idf) AS h FROM cand c JOIN qi USING (q_id)
                JOIN post p ON p.doc_id = c.doc_id AND p.pos = c.pos AND p.term = qi.term
                GROUP BY c.q_id, c.doc_id, c.pos),
        sc AS (SELECT c.q_id, c.doc_id, c.pos, round(coalesce(h.h, 0) / t.tot, 6) AS score
               FROM cand c LEFT JOIN hit h USING (q_id, doc_id, pos) JOIN tot t USING (q_id))
        SELECT q_id, doc_id, pos, score,
               row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, pos)::INT AS rank
        FROM sc QUALIFY rank <= 3""",
    "similarity_filter": f"""WITH {BM25}, {ranked(10, 'cand')},
        qi AS (SELECT q_id, term, ln(1 + (n_chunks - df + 5e-1) / (df + 5e-1)) AS idf FROM qt JOIN dfreq USING (term) CROSS JOIN st),
        tot AS (SELECT q_id, sum(idf) AS tot FROM qi GROUP BY q_id),
        hit AS (SELECT c.q_id, c.doc_id, c.pos, sum(qi.idf) AS h FROM cand c JOIN qi USING (q_id)
                JOIN post p ON p.doc_id = c.doc_id AND p.pos = c.pos AND p.term = qi.term
                GROUP BY c.q_id, c.doc_id, c.pos),
        sc AS (SELECT c.q_id, c.doc_id, c.pos, round(coalesce(h.h, 0) / t.tot, 6) AS score
               FROM cand c LEFT JOIN hit h USING (q_id, doc_id, pos) JOIN tot t USING (q_id)),
        f AS (SELECT sc.*, regexp_replace(lower(trim(ch.text)), '\\s+', ' ', 'g') AS nt
              FROM sc JOIN chunks ch USING (doc_id, pos) WHERE score >= 4e-1 AND trim(ch.text) <> '')
        SELECT q_id, doc_id, pos, score FROM f
        QUALIFY row_number() OVER (PARTITION BY q_id, nt ORDER BY score DESC, doc_id, pos) = 1""",
    "pack_context": f"""WITH {BM25}, {ranked(20)},
        rt AS (SELECT r.q_id, r.rank, c.text FROM ranked r JOIN chunks c USING (doc_id, pos)),
        b AS (SELECT q_id, rank, text,
                     (coalesce(sum(length(text)) OVER (PARTITION BY q_id ORDER BY rank
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000)::BIGINT AS pack FROM rt)
        SELECT q_id, pack, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks
        FROM b GROUP BY q_id, pack""",
}


def refreshed(v: int) -> str:
    """BM25 top-5 over one version of the refreshed corpus, built anew: English passages, and
    each sample of others drawn up to then as rows of its own."""
    corpus = PASSAGES + f""",
lp AS (SELECT ps.doc_id, ps.text, coalesce(d.lang = 'en', false) AS en FROM passages ps JOIN documents d USING (doc_id)),
smp AS (SELECT u, doc_id, text FROM (SELECT unnest(range(1, {v + 1}))::INT AS u), lp WHERE NOT en
        QUALIFY row_number() OVER (PARTITION BY u ORDER BY md5('42|' || u::VARCHAR || '|' || doc_id::VARCHAR), doc_id) <= 100),
rows AS (SELECT 0 AS u, doc_id, text FROM lp WHERE en UNION ALL SELECT u, doc_id, text FROM smp
         WHERE ('0x' || substr(md5('42|' || u::VARCHAR), 1, 8))::BIGINT / 4294967296e0 <= 5e-1),
pieces AS (SELECT u, doc_id, regexp_extract_all(text, '\\S+\\s*') AS p FROM rows),
chunks AS (SELECT u, doc_id, (s // 112)::INT AS pos, regexp_replace(array_to_string(list_slice(p, s + 1, s + 128), ''), '\\s+$', '') AS text
  FROM (SELECT u, doc_id, p, unnest(range(0, greatest(len(p) - 16, 1), 112)) AS s FROM pieces WHERE len(p) > 0))"""
    return f"""SELECT * FROM (WITH {bm25(corpus, key='u, doc_id, pos')}
        SELECT {v}::INT AS kb_version, q_id, doc_id, pos, score,
          row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, pos, u)::INT AS rank
        FROM scores QUALIFY rank <= 5)"""


SQL["bm25_refreshed"] = " UNION ALL ".join(refreshed(v) for v in (1, 2, 3))

SQL["config_grid"] = f"""WITH {BM25}, {ranked(20, 'lex')},
    vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    near AS (SELECT a.vec_id AS q_id, b.vec_id AS doc_id,
               round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d
             FROM vec a JOIN questions ON q_id = a.vec_id, vec b WHERE b.vec_id IN (SELECT doc_id FROM passages)),
    dense AS (SELECT q_id, doc_id, 0 AS pos, row_number() OVER (PARTITION BY q_id ORDER BY d, doc_id)::INT AS rank FROM near QUALIFY rank <= 20),
    both_ AS (SELECT 'bm25' AS retriever, q_id, doc_id, pos, rank FROM lex UNION ALL SELECT 'dense', q_id, doc_id, pos, rank FROM dense),
    tot AS (SELECT q_id, sum(idf) AS tot FROM idf GROUP BY q_id),
    hit AS (SELECT c.retriever, c.q_id, c.doc_id, c.pos, sum(idf.idf) AS h FROM both_ c JOIN idf USING (q_id)
            JOIN post p ON p.doc_id = c.doc_id AND p.pos = c.pos AND p.term = idf.term GROUP BY ALL),
    sh AS (SELECT c.*, coalesce(round(coalesce(h, 0) / tot, 6), 0) AS share FROM both_ c
           LEFT JOIN hit USING (retriever, q_id, doc_id, pos) LEFT JOIN tot USING (q_id)),
    cut AS (SELECT sh.*, k AS topk FROM sh, (SELECT unnest([5, 10, 20])::INT AS k) WHERE rank <= k),
    cfg AS (SELECT q_id, retriever, topk, false AS reranker, rank, doc_id, pos FROM cut UNION ALL
            SELECT q_id, retriever, topk, true, row_number() OVER (PARTITION BY retriever, q_id, topk ORDER BY share DESC, doc_id, pos)::INT AS r,
              doc_id, pos FROM cut QUALIFY r <= 3)
    SELECT q_id, retriever, topk, reranker, p AS prompt_edit, rank, doc_id, pos
    FROM cfg, (SELECT unnest(['simple_qa', 'paraphrase_qa', 'simplify_qa']) AS p)"""

SQL["gold_containment_short"] = """WITH g AS (SELECT item_id * 2 AS q_id, string_split(text, ' ')[1] AS gold FROM benchmark
    UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark)
    SELECT q_id, doc_id FROM g JOIN documents d ON contains(d.text, g.gold)"""

SQL["chunk_sentences"] = f"""WITH RECURSIVE {PASSAGES},
    sp AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
             lambda s: regexp_matches(s, '\\S')) AS l FROM passages),
    se AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM sp),
    sw AS (SELECT *, len(regexp_extract_all(s, '\\S+')) AS w FROM se),
    sc AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM sw),
    en AS (SELECT a.doc_id, a.i, a.n, greatest(a.i, max(CASE WHEN b.c - a.c + a.w <= 128 THEN b.i END)) AS e FROM sc a
           JOIN sc b ON b.doc_id = a.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.i, a.n),
    nx AS (SELECT en.doc_id, en.i, en.e, en.n, (SELECT min(j.i) FROM sc j JOIN sc x ON x.doc_id = j.doc_id AND x.i = en.e + 1
             JOIN sc y ON y.doc_id = j.doc_id AND y.i = en.e WHERE j.doc_id = en.doc_id AND j.i > en.i AND j.i <= en.e + 1
               AND (j.i = en.e + 1 OR y.c - j.c + j.w <= 16 AND x.c - j.c + j.w <= 128)) AS nxt FROM en),
    ch AS (SELECT doc_id, 0 AS pos, i, e, n, nxt FROM nx WHERE i = 1
           UNION ALL SELECT ch.doc_id, ch.pos + 1, nx.i, nx.e, nx.n, nx.nxt FROM ch JOIN nx ON nx.doc_id = ch.doc_id AND nx.i = ch.nxt WHERE ch.e < ch.n)
    SELECT ch.doc_id, ch.pos::INT AS pos, array_to_string(l[ch.i:ch.e], ' ') AS text,
      list_sum(list_transform(l[ch.i:ch.e], lambda s: len(regexp_extract_all(s, '\\S+'))))::INT AS n_words
    FROM ch JOIN sp USING (doc_id)"""
