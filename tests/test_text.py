"""Scalar text functions on literal rows (branches and traps)."""

from pyspark.sql import functions as F

from remedy.functions import reply as RP
from remedy.functions import text as T
from remedy.operators.repair import action_name


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_decode_brackets(spark):
    assert one(spark, T.decode_brackets("x"), "f-LRB-a-RRB- -LSB-b-RSB- -LCB-c-RCB- d-COLON-e") == "f(a) [b] {c} d:e"


def test_clean_passage_strips_tabs_and_newlines(spark):
    assert one(spark, T.clean_passage("x"), "\t a\tb\nc -LRB-x-RRB- \n") == "a b c (x)"


def test_split_sentences_regex_strip_trap(spark):
    # Python-style strip removes the trailing "\n2\t"; the last sentence keeps "...\n2"
    got = one(spark, T.split_sentences("x"), "0\tFirst one.\n1\tSecond.\n2\t")
    assert got == ["First one.", "Second.\n2"]


def test_split_sentences_drops_element_zero(spark):
    assert one(spark, T.split_sentences("x"), "0\tA\n1\tB") == ["A", "B"]


def test_numbered_lines_roundtrip(spark):
    got = one(spark, T.split_sentences(T.numbered_lines("x")), "a\nb\nc")
    assert got == ["a", "b", "c"]


def test_canon_label(spark):
    assert one(spark, T.canon_label("x"), "NOT ENOUGH INFO") == "NOTENOUGHINFO"


def test_join_sentences(spark):
    df = spark.createDataFrame([(["a\tb", " c "],)], "x array<string>")
    assert df.select(T.join_sentences("x")).first()[0] == "a b  c"


def test_clean_short_answer(spark):
    assert one(spark, T.clean_short_answer("x"), " Empty Response ") == "The provided context is insufficient."
    assert one(spark, T.clean_short_answer("x"), "Response 1: yes. Response 1: no") == "yes. no"


def test_exact_match_normalisation(spark):
    df = spark.createDataFrame([(["The  Cat!"], "cat"), (["a dog"], "cat"), ([], "x")], "r array<string>, c string")
    assert [r[0] for r in df.select(T.exact_match("r", "c")).collect()] == [True, False, False]


def test_parse_reply_variants(spark):
    rows = [('{"label": "SUPPORTS", "response": "ok"}',),
            ('```json\n{"label": "REFUTES", "response": "no"}\n```',),
            ("Empty Response",),
            ('{"label": "SUPPORTS", "resp',)]
    df = spark.createDataFrame(rows, "r string").select(RP.parse_reply(F.col("r")).alias("p"))
    got = [(x.p.label, x.p.response, x.p.parse_ok) for x in df.collect()]
    assert got[0] == ("SUPPORTS", "ok", True)
    assert got[1] == ("REFUTES", "no", True)
    assert got[2] == ("NOTENOUGHINFO", "Context is not sufficient.", True)
    assert got[3] == (None, None, False)


def test_render_prompt_literal_braces(spark):
    df = spark.createDataFrame([('{"a": 1} {context_str} / {query_str}', "CTX", "Q")], "t string, c string, q string")
    assert df.select(RP.render_prompt(F.col("t"), F.col("c"), F.col("q"))).first()[0] == '{"a": 1} CTX / Q'


def _decode(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r.s, r.r, r.o) for r in RP.decode_triples(df, "id", "t").orderBy("t_idx", "p_idx").collect()]


def test_decode_triples_multi_pair_and_multi_triple(spark):
    t = "<s><triplet> Paris <subj> France <obj> capital of <subj> Europe <obj> located in <triplet> Rome <subj> Italy <obj> capital of</s>"
    assert _decode(spark, t) == [("Paris", "capital of", "France"), ("Paris", "located in", "Europe"),
                                 ("Rome", "capital of", "Italy")]


def test_decode_triples_edge_cases(spark):
    assert _decode(spark, "") == []
    assert _decode(spark, "junk before <triplet> A <subj> B <obj> r") == [("A", "r", "B")]
    # A dangling <subj> segment without <obj> yields no triple
    assert _decode(spark, "<triplet> A <subj> B <obj> r <subj> C") == [("A", "r", "B")]
    # incomplete triple (no relation) is not emitted
    assert _decode(spark, "<triplet> A <subj> B <obj>") == []


def test_triple_query(spark):
    df = spark.createDataFrame([("a", "b", "c")], "s string, r string, o string")
    assert df.select(T.triple_query("s", "r", "o")).first()[0] == "[subject:a] - [predicate:b] - [object:c]"


def test_action_name_tests_values(spark):
    rows = [(None,), ('{"reranker": true}',), ('{"reranker": false, "prompt_edit": "paraphrase_qa"}',),
            ('{"prompt_edit": "simplify_qa"}',), ('{"retriever": "bm25", "topk": 20, "reindex": true}',),
            ('{"retriever": "dense", "topk": 5, "reranker": false, "prompt_edit": "simple_qa", "reindex": false}',)]
    df = spark.createDataFrame(rows, "p string")
    got = [r[0] for r in df.select(action_name(F.col("p"))).collect()]
    # A reranker key set to false is not "Reranker activation"
    assert got == ["Default Action", "Reranker activation", "Paraphrase query", "Simplify query",
                   "bm25, top-20, reindex=True", "dense, top-5, reindex=False"]
