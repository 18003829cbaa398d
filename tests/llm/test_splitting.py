"""Pieces: sizes, cover, boundaries, and locality under edits."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granthika.llm.sentences import spans
from granthika.llm.splitting import LIMIT, OVERLAP, cut, pieces, piece_spans


def check(t):
    p = cut(t)
    s = t.strip()
    if not s:
        assert p == []
        return p
    first = len(t) - len(t.lstrip())
    assert p[0][:2] == (first, first) and p[-1][2] == len(t.rstrip())
    assert (len(p) > 1) == (len(s) > LIMIT)
    for (a0, c0, e0), (a1, c1, e1) in zip(p, p[1:]):
        assert a0 <= c0 < e0 <= c1 and not t[e0:c1].strip()  # nothing but white space between cores
        assert c1 - OVERLAP <= a1 <= c1 and e1 > e0
    assert all(e - a <= LIMIT for a, _, e in p)
    return p


WORDS = ["दिल्ली", "a", "शहर", "x" * 30, "है।", "1.5", "बड़ा", "gone."]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(WORDS + [" ", "\n\n", "   "]), max_size=900), st.sampled_from([" ", ""]))
def test_any_text(words, gap):
    check(gap.join(words))


def text(n, seed=0):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(["कमल", "नगर", "शहर", "नदी", "पुल"]) + str(rng.randrange(99)) for _ in range(rng.randint(4, 14))) + " है।" for _ in range(n))


def test_cuts_are_sentence_ends():
    t = text(120)
    ends = {b for _, b in spans(t)}
    p = check(t)
    assert len(p) > 5 and all(e in ends for _, _, e in p)


def test_words_where_there_are_no_sentences():
    t = " ".join(f"शब्द{i}" for i in range(800))
    assert all(t[e : e + 1] in ("", " ") for _, _, e in check(t))
    assert len(check("क" * 5000)) >= 7


def test_edit_changes_neighbours_only():
    t = text(300, 4)
    at = t.index(" है।", len(t) // 2)
    u = t[:at] + " नया" + t[at:]
    a = {t[c:e] for _, c, e in cut(t)}
    b = {u[c:e] for _, c, e in cut(u)}
    assert len(a - b) <= 3 and len(a) > 12


def test_operator(spark):
    df = spark.createDataFrame([("r", 1, " " + text(60), "x"), ("r", 2, "short", "x"), ("r", 3, None, None), ("r", 4, "  ", None)], "tbl string, rec_id bigint, text string, piece string")
    got = pieces(df, "text", "tbl", "rec_id").collect()
    assert {r.rec_id for r in got} == {1, 2} and [r.piece for r in got if r.rec_id == 2] == ["short"]
    assert all(len(r.piece) == r.end_char - r.start_char <= LIMIT for r in got)
    assert pieces(df.limit(0), "text", "rec_id").count() == 0
    with pytest.raises(ValueError):
        piece_spans(100, 100)
