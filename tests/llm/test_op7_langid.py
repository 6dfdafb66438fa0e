import numpy as np
import pyarrow as pa

from remedy.llm import op7_langid as o


def naive_phrases(text: bytes, sample: bytes) -> int:
    """Cross-parse by substring search, stretch by stretch."""
    count = 0
    for at in range(0, len(text), o.SEGMENT):
        t = text[at:at + o.SEGMENT]
        i = 0
        while i < len(t):
            n = 1
            while i + n < len(t) and t[i:i + n] in sample and t[i:i + n + 1] in sample:
                n += 1
            count += 1
            i += n
    return count


def test_phrase_counts_against_substring_search():
    rng = np.random.default_rng(4)
    samples = {"a": ["".join(rng.choice(list("abc "), 600)).encode()], "b": ["".join(rng.choice(list("cde "), 500)).encode()]}
    texts = ["".join(rng.choice(list("abcde z"), n)) for n in (1, 2, 30, 400, o.SEGMENT, o.SEGMENT + 1, 3 * o.SEGMENT + 7)]
    m = o.fit(samples)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = o.phrases(m.classes[raw].astype(np.int32), np.append(0, ends[:-1]), ends, m)
    for k, lang in enumerate("ab"):
        assert got[k].tolist() == [naive_phrases(t.encode(), samples[lang][0]) for t in texts]


def test_held_out_accuracy(spark):
    got = o.op7_langid(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = got.filter("held_out").join(lang, "doc_id").filter("lang IS NOT NULL").collect()
    assert np.mean([x.lang == x.lang_pred for x in r]) > 0.97 and all(0 <= x.score <= 1 for x in got.collect())


def test_defined_cases_and_columns(spark, docs_of):
    train = [(i, "the of and in that was " * 20, "en") for i in range(12)] + [(20 + i, "der die und nicht ein das " * 20, "de") for i in range(12)]
    odd = [(50, None, None), (51, "", "en"), (52, "123 ... 456", "de"), (53, "the the that", None), (53, "the the that", None), (None, "und nicht", None),
           (54, "ж", None), (55, "the of and " * 30_000, None)]
    df = docs_of(train + odd)
    rows = o.detect(df, o.learned_from(df)).collect()
    by = [(r.doc_id, r.lang_pred) for r in rows if r.doc_id is None or r.doc_id >= 50]
    assert sorted(by, key=str) == sorted([(50, "und"), (51, "und"), (52, "und"), (53, "en"), (53, "en"), (None, "de"), (54, by_54(by)), (55, "en")], key=str)
    kept = o.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(train) + len(odd) - 3
    assert o.keep_known(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("n_chars", "score")
    assert o.keep_known(clash).columns == clash.columns


def by_54(by):
    return next(x for i, x in by if i == 54)  # a letter of no learned script: some language, never und


def test_nothing_learned_gives_und():
    langs, score = o.classify(pa.array(["abc", None]), o.fit({}))
    assert langs == ["und", "und"] and score.tolist() == [0, 0]


def test_language_of_long_texts_only(spark, docs_of):
    rng = np.random.default_rng(2)
    long = [" ".join(rng.choice("der die und nicht ein das zu über für".split(), 9_000)) for _ in range(3)]
    assert min(len(t.encode()) for t in long) > o.TRAIN_BYTES
    df = docs_of([(i, t, "de") for i, t in enumerate(long)] + [(10 + i, f"the of and in that was {i} " * 20, "en") for i in range(12)])
    model = o.train(df, "lang", "text")
    assert model.langs == ["de", "en"]
    # three long texts fill the sample with their pieces, and no more than it
    assert o.TRAIN_BYTES <= 2 ** model.weight[0] < o.TRAIN_BYTES + 2 * o.PIECE_BYTES
    assert {r.lang_pred for r in o.detect(df.filter("lang = 'de'"), model).collect()} == {"de"}
    only = docs_of([(i, t, "de") for i, t in enumerate(long * 4)])
    assert o.keep_known(only).count() == 12


def test_copies_do_not_use_up_the_sample(spark, docs_of, monkeypatch):
    texts = [f"the of and in that was {i} " * 3 for i in range(60)]
    df = docs_of([(i, t, "en") for i, t in enumerate(texts)])
    hot = df.selectExpr("text", "xxhash64(text) h").orderBy("h").first().text
    monkeypatch.setattr(o, "fit", lambda samples: samples)
    got = o.train(df.union(docs_of([(1000 + i, hot, "en") for i in range(500)])), "lang", "text")
    assert sorted(got["en"]) == sorted(t.encode() for t in texts)
