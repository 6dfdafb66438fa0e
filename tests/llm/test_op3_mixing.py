from collections import Counter

import numpy as np

from remedy.llm import op3_mixing as o


def targets_brute(sizes):
    """Sources sorted by code point, null last -> targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        t = {s: left * w[s] / weight for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **t}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def report(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return o.mix_report(df).collect(), o.mix_counts(df)


def test_targets_near_taken_and_repeatable(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "b", "Z", "é", None][min(4, int(rng.integers(0, 9)))], int(rng.integers(0, 400))) for i in range(3000)]
    rows += [(9000, "tiny", 2), (9001, "tiny", 3), (None, "a", 17), (None, "a", 17), (None, "a", 17), (9100, "b", 20_000)]
    got, _ = report(spark, rows)
    sizes = Counter()
    for _, s, z in rows:
        sizes[s] += z
    want = targets_brute(sizes)
    by_size = {sizes[s]: t for s, t in want.items()}
    taken = Counter()
    for r in got:
        assert abs(r.target - by_size[r.source_size]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r.size and (r.size == 0) == (r.taken == 0 and r.size == 0)
        taken[r.source_size] += r.taken
    for s, t in want.items():
        # b has one document of a quarter of its words, which the others can't always make up for
        assert abs(taken[sizes[s]] - t) <= {"tiny": 3, "b": 0.05 * t}.get(s, 40), (s, t, taken[sizes[s]])
    again, _ = report(spark, rows[::-1])
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    nulls = sorted(r.taken for r in got if r.doc_id is None)
    assert len(nulls) == 3 and nulls[-1] - nulls[0] <= 17  # copies share their draws evenly


def test_flight_keeps_sums_and_leaves_at_most_two():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 800).astype(float).tolist()
    start = rng.random(800).tolist()
    x, act = o.flight(list(start), size, rng)
    assert len(act) <= 2 and all(v in (0.0, 1.0) for k, v in enumerate(x) if k not in act)
    assert abs(sum(x) - sum(start)) < 1e-6
    assert abs(np.dot(x, size) - np.dot(start, size)) < 1e-4


def test_flight_is_unbiased():
    total = np.zeros(12)
    for seed in range(3000):
        x, act = o.flight([0.3] * 12, [5.0, 9, 1, 1, 1, 30, 2, 8, 8, 8, 3, 4], np.random.default_rng(seed))
        total += [np.float64(v) for v in x]
    assert np.abs(total / 3000 - 0.3).max() < 0.04


def test_landing_keeps_probabilities_and_words():
    """Twelve documents, every step from start to landing: each is drawn as often as it
    should be, and the words miss by no more than a short document."""
    size = sorted([900.0, 400, 220, 210, 130, 90, 60, 40, 25, 12, 6, 3], reverse=True)
    total, off = np.zeros(12), []
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        x = o.settle_longest([0.35] * 12, size, rng)
        act = [k for k, v in enumerate(x) if 0 < v < 1]
        assert len(act) <= 2
        x = o.land(x, size, act, rng)
        assert set(x) <= {0.0, 1.0}
        total += x
        off.append(abs(np.dot(x, size) - 0.35 * sum(size)))
    assert np.abs(total / 3000 - 0.35).max() < 0.035
    assert np.mean(off) < 0.3 * max(size)  # drawn one by one they would miss by 400


def test_small_sources_keep_inclusion_probabilities(spark):
    """The whole mix over 900 sources of the same 12 documents: sources of weight 1 want half
    a copy of each, those of weight 3 one and a half."""
    sizes = [700, 300, 90, 80, 60, 50, 40, 30, 20, 10, 5, 2]
    rows = [(1000 * s + i, f"s{s:04}", z) for s in range(900) for i, z in enumerate(sizes)]
    got, _ = report(spark, rows)
    drawn, n = Counter(), Counter()
    for r in got:
        s, i = divmod(r.doc_id, 1000)
        rest = r.target / r.source_size % 1
        if abs(rest - 0.5) < 1e-6:
            drawn[i] += r.taken // r.size - int(r.target / r.source_size)
            n[i] += 1
    assert min(n.values()) == 600
    assert all(abs(drawn[i] / n[i] - 0.5) < 0.08 for i in range(12)), drawn


def test_empty_and_zero_sizes(spark):
    assert report(spark, [])[0] == []
    got, _ = report(spark, [(1, "a", 0), (2, None, 0)])
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


def test_mix_repeats_rows_with_all_columns(spark, docs_of):
    df = docs_of([(i, "w " * (i % 50 + 1), "en", "ab"[i % 2]) for i in range(200)] + [(7, None), (8, "")])
    mixed = o.mix(df).collect()
    counts = Counter(r.doc_id for r in mixed)
    want = {r.doc_id: r.total for r in o.mix_counts(df.select(
        "doc_id", "source", o.n_words(df["text"]).alias("size"))).collect() if r.total and r.size}
    assert {k: v for k, v in counts.items() if v} == want and max(counts.values()) <= 3


def test_small_sources_beside_a_hot_one_reach_their_targets(spark, monkeypatch):
    monkeypatch.setattr(o, "GROUP_ROWS", 20)  # 200 buckets of the hot source, three passes
    rng = np.random.default_rng(9)
    rows = [(i, "hot", int(rng.integers(20, 60))) for i in range(4000)]
    rows += [(10_000 + i, f"s{i % 15:02}", int(rng.integers(20, 60))) for i in range(1500)]
    got, counts = report(spark, rows)
    assert len(got) == len(rows)
    per = {}
    for r in counts.collect():
        size, target, taken, docs, draws = per.get(r.source, (r.source_size, r.target, 0, 0, 0))
        per[r.source] = (size, target, taken + r.total * r.size, docs + 1, draws + r.total)
    assert len(per) == 16
    for s, (size, target, taken, docs, draws) in per.items():
        assert abs(taken - target) <= 60, (s, target, taken)  # the longest document
        assert abs(draws - target / size * docs) <= 4, (s, target / size * docs, draws)
    again, _ = report(spark, rows[::-1])
    assert sorted(got) == sorted(again)
