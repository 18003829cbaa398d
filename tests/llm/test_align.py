"""Alignment of made-up bilingual passages."""

import random
from collections import defaultdict

import pytest

from granthika.llm import align as A
from granthika.llm.align import align, aligned, chain, near

EN = ["The rice fair of Malsukeganj begins in July and draws 1,582 visitors from Hirdabhakheda.", "The GHPR agency measured a depth of 162.83 metres at Hirkeratola.", "Dr. Sarbhambe pointed to the KKD record.", "In 1825, Prof. Golyarekar opened a market in Naryashagaon with 4,553 workers."]
TR = ["मालसुकेगंज का चावल मेला जुलाई में शुरू होता है और हीरदाभाखेड़ा से 1582 दर्शक आते हैं।", "GHPR संस्था ने हीरकेराटोला पर १६२.८३ मीटर की गहराई मापी।", "डॉ. सरभाम्बे ने KKD का रिकॉर्ड दिखाया।", "1825 में प्रो. गोलयारेकर ने नरयाशागाँव में 4,553 कर्मचारियों के साथ एक बाज़ार शुरू किया।"]
TERMS = {"july": ["जुलाई"], "rice": ["चावल"], "market": ["बाज़ार"]}


def pairs(en, tr):
    e, t = " ".join(en), " ".join(tr)
    at = lambda whole, parts: {whole.index(p): i for i, p in enumerate(parts)}
    a, b = at(e, en), at(t, tr)
    return {(a[x], b[y]) for x, y, _ in align(e, t, TERMS)}


def test_in_order():
    assert pairs(EN, TR) == {(i, i) for i in range(4)}


def test_left_out_and_moved():
    assert pairs(EN, [TR[0], TR[3]]) == {(0, 0), (3, 1)}
    assert pairs(EN, [TR[3], TR[0], TR[1], TR[2]]) == {(0, 1), (1, 2), (2, 3), (3, 0)}


def test_joined():
    joined = TR[0].rstrip("।") + ", और " + TR[1]
    assert pairs(EN, [joined, TR[2], TR[3]]) == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_nothing_in_common():
    assert pairs(EN[:1], ["यह कुछ और है।"]) == set()
    assert align(None, "x", {}) == [] == align("x", " ", {}) == align("", "", {})


def test_chain_and_near():
    assert chain([(0, 0, 1.0), (1, 5, 1.0), (2, 1, 1.0), (3, 2, 1.0)]) == [(0, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert chain([]) == []
    assert near("abc", "abd") and near("abc", "abcd") and near("abc", "ac") and not near("abc", "cba")


def test_frequent_features_count_far_from_their_place():
    """30 sentences with two names each, of which one is in all; those of the translation in reverse order."""
    es = set(range(30))
    common = [(0.2, es, es), *((0.9, {i}, {29 - i}) for i in es)]
    score, evidence = A._scores(common, 30)
    assert all(evidence[i, 29 - i] == 2 and score[i, 29 - i] > 1.0 for i in es) and len(score) == 900
    few, A.FEW = A.FEW, 0
    try:
        rows, counts = A._scores(common, 30)
    finally:
        A.FEW = few
    assert dict(rows) == {k: v for k, v in score.items() if v >= A.LOWEST} and all(counts[k] == evidence[k] for k in rows)


def dense_gap(es, ts, score, close):
    """Every cell of the table: pairs, two-to-one, one-to-two, or none."""
    gain = {(i, j): close(i, j) if score.get((i, j), 0.0) >= 1.0 else -1.0 for i in es for j in ts}
    best = {(0, 0): (0.0, None, [])}
    for x in range(len(es) + 1):
        for y in range(len(ts) + 1):
            options = []
            for dx, dy in ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2)) if (x, y) != (0, 0) else ():
                if x >= dx and y >= dy:
                    links = [(es[x - 1 - a], ts[y - 1 - b]) for a in range(dx) for b in range(dy)]
                    options.append((best[x - dx, y - dy][0] + sum(gain[k] - A.SKIP for k in links), (x - dx, y - dy), links))
            if options:
                best[x, y] = max(options, key=lambda o: o[0])
    out, at = [], (len(es), len(ts))
    while at is not None:
        _, before, links = best[at]
        out += links
        at = before
    return out


def test_gap_has_the_optimum_of_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        es, ts = sorted(rng.sample(range(30), rng.randint(1, 9))), sorted(rng.sample(range(30), rng.randint(1, 9)))
        score = defaultdict(float, {(i, j): rng.choice([0.5, 1.5, 2.0]) for i in range(30) for j in range(30) if rng.random() < 0.4})
        share = {(i, j): rng.random() for i in range(30) for j in range(30)}
        close = lambda i, j: share[i, j]  # noqa: B023, E731
        rows = defaultdict(list)
        for i, j in score:
            rows[i].append(j)
        value = lambda links: sum(close(i, j) - A.SKIP for i, j in links)  # noqa: B023, E731
        wide, dense = A._gap(es, ts, rows, score, close), dense_gap(es, ts, score, close)
        assert abs(value(wide) - value(dense)) < 1e-9 and all(i in es and j in ts for i, j in wide)
        assert max([0, *(sum(a == i for a, _ in wide) for i in es), *(sum(b == j for _, b in wide) for j in ts)]) <= 2


def test_operator(spark):
    schema = "row_id bigint, lang string, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<bigint>>, en string"
    long = " ".join(EN * 300), " ".join(TR * 300)
    rows = [(1, "hi", ([" ".join(EN), None, ""], [" ".join(TR), TR[0]], None), "x"), (2, None, None, None), (3, None, ([EN[1]], [TR[1]], None), None), (4, "hi", ([long[0]], [long[1]], None), None)]
    g = spark.createDataFrame([("hi", "July", "जुलाई"), ("hi", None, None)], "lang string, en_term string, tr_term string")
    got = aligned(spark.createDataFrame(rows[:3], schema), g).collect()
    assert {(r.pkey, r.en_start > 0) for r in got} == {(100, False), (100, True), (300, False)} and len(got) == 5
    assert aligned(spark.createDataFrame(rows[3:], schema), g.limit(0)).count() >= 1000
    assert A.glossary_terms(g) == {"hi": {"july": ["जुलाई"]}}
    with pytest.raises(ValueError, match="more than 0 terms"):
        A.glossary_terms(g, most=0)
    assert aligned(spark.createDataFrame(rows, schema).limit(0), g).count() == 0
