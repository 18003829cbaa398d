"""Look-alikes: the table, the automaton, and the join against folding every text."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthika.llm.lookalike import consistent, fold, is_odd, look_alikes, reach, skeleton, spellings, trie

SAME = [
    ("ＧＨＰＲ", "GHPR"), ("１７", "17"), ("कि\u200bमी", "किमी"), ("\u095c", "\u0921\u093c"), ("\u09c7\u09be", "\u09cb"), ("\u0bc7\u0bbe", "\u0bcb"), ("अार", "आर"),
    ("\u0421\u041aDT", "CKDT"), ("\u039dX\u0408", "NXJ"), ("\u0643\u06d2", "\u06a9\u06d2"), ("है|", "है।"), ("है।।", "है॥"), ("e\u0301", "\u00e9"), ("a\u00adb", "ab"), ("\u0627\u0653", "\u0622"), ("क\u200dा", "का"),
]
DIFFERENT = [("पक्\u200dष", "पक्ष"), ("Ab", "ab"), ("४", "4"), ("बی", "بی"), ("ab ", "ab"), ("a b", "ab"), ("می\u200cروم", "میروم"), ("a.", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_alike(a, b):
    assert fold(a) == fold(b) and (is_odd(a) or is_odd(b))
    assert reach(trie([b]), a) == [(0, b)] and reach(trie([a]), b) == [(0, a)]


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_not_alike(a, b):
    assert fold(a) != fold(b) and not [x for x in reach(trie([b]), a) if x[1] == b]


def test_edits_cost():
    assert reach(trie(["नगर", "नहर", "शहर"]), "नगर", 1) and sorted(reach(trie(["नगर", "नहर", "शहर"]), "नगर", 1)) == [(0, "नगर"), (1, "नहर")]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAГР１|।\u200b\u200d\u200c\u00adक्ाआअडड़़ेো্াে ّآآé́ோோ", max_size=12))
def test_fold_is_stable(t):
    f = fold(t)
    assert fold(f) == f
    if not is_odd(t):
        assert f == t


@pytest.mark.parametrize("a,b", [*DIFFERENT, ("مي\u200cروم", "میروم"), ("ميروم", "می\u200cروم"), ("क\u200d्ष", "क्ष")])
def test_not_alike_either_way(a, b):
    assert fold(a) != fold(b) and reach(trie([a]), b) == [] == reach(trie([b]), a)


def test_visible_joiner_in_one_shard(spark):
    """A token may not take a stored spelling with a visible joiner, even where both are in one shard."""
    own = spark.createDataFrame([(t,) for t in ["میروم", *["می\u200cروم"] * 3]], "text string")
    asked = spark.createDataFrame([("ميروم",), ("مي\u200cروم",), ("می\u200cروم",)], "token string")
    words = spellings(asked, own, shards=1)
    assert {r.token: r.spelling for r in words.collect()} == {"ميروم": "میروم", "مي\u200cروم": "می\u200cروم", "می\u200cروم": "می\u200cروم"}


def test_the_trie_decides_and_not_the_table(spark):
    """Spellings of one skeleton that differ in what is seen; canonical spellings that are not the table's form."""
    stored = ["Москва", "Москва", "नगर", "नगरी", "नागर", "Ελλάδα", "ＷＩＤＥ", "СОР COP", "कोना"]
    own = spark.createDataFrame([(t,) for t in stored], "text string")
    asked = ["Mocквa", "Mосква", "М\u200bосква", "न\u200bगरी", "न\u200bगरो", "Eλλάδα", "ＷＩＤＥ", "СОР", "क\u200bाना", "Mocквba"]
    got = {r.token: r.spelling for r in spellings(spark.createDataFrame([(t,) for t in asked], "token string"), own).collect()}
    want = ["Москва", "Москва", "Москва", "नगरी", "नगरो", "Ελλάδα", "WIDE", "COP", "काना", "Mocквba"]
    assert got == dict(zip(asked, want)) and fold("М\u200bосква") == "Mocквa"
    texts = spark.createDataFrame([("t", i, t) for i, t in enumerate(["in Москва 1", "in Mocквa 1", "in Mосква\u00a01"])], "tbl string, rec_id int, text string")
    assert {r.canonical for r in consistent(texts, own, "rec_id").collect()} == {"in Москва 1"}
    found = look_alikes(texts.where("rec_id > 0"), texts.where("rec_id = 0").withColumnRenamed("rec_id", "match_id"))
    assert {r.rec_id for r in found.collect()} == {1, 2}


def test_weights():
    """A visible edit costs, a look-alike or an unseen sign does not."""
    root = trie(["नगर", "नहर", "शहर", "cafe", "café", "CAT"])
    assert reach(root, "न\u200bहर", 0) == [(0, "नहर")]
    assert sorted(reach(root, "न\u200bहर", 1)) == [(0, "नहर"), (1, "नगर"), (1, "शहर")]
    assert sorted(reach(root, "cafe\u0301", 1)) == [(0, "café"), (1, "cafe")] and reach(root, "САТ", 1) == [(0, "CAT")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcd", min_size=1, max_size=5), min_size=1, max_size=6, unique=True), st.text(alphabet="abcd", min_size=1, max_size=5), st.integers(0, 3))
def test_reach_is_the_edit_distance(words, token, most):
    assert sorted(reach(trie(words), token, most)) == sorted((d, w) for w in words if (d := edits(token, w)) <= most)


def test_what_looks_alike_has_one_skeleton(spark):
    rng = random.Random(3)
    pool = "aAГР１|।\u200b\u200d\u200c\u00adक्ाआअडड़़ेো্াে ّآأé\u0301ோओअोῈ\u212bｶﾞガ한ᄒ"
    words = list({"".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(6000)})
    pairs = [(t, fold(t)) for t in words] + SAME
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(skeleton(F.col("a")) != skeleton(F.col("b"))).collect() == []
    assert df.select(skeleton(F.col("b"))).distinct().count() > 100


@settings(max_examples=400, deadline=None)
@given(*[st.text(alphabet="aAГ|।\u200b\u200d\u200c\u00adक्ाآمیيرَ", max_size=5)] * 2)
def test_what_is_reached_has_the_same_form(a, b):
    assert not reach(trie([a]), b) or fold(a) == fold(b)


def test_join_against_folding(spark):
    rng = random.Random(2)
    stored = [f"नगर {i} का पुल {i * 7} ABC है।" for i in range(60)] + ["दो  शब्द", "ＷＩＤＥ पाठ"]

    def noise(t):
        for a, b in rng.sample([("A", "А"), (" ", "\u00a0"), ("।", "|"), ("1", "１"), ("क", "क\u200b"), ("B", "b"), ("है", "है ")], rng.randint(0, 3)):
            t = t.replace(a, b)
        return t

    texts = [(i, noise(rng.choice(stored))) for i in range(300)] + [(900, None), (901, " "), (902, "x" * 5000), (903, "न\u200bगर")] + [(904, "WIDE पाठ")] * 2
    df = spark.createDataFrame([("t", i, t, "e") for i, t in texts], "tbl string, rec_id bigint, text string, form string")
    own = spark.createDataFrame([("t", f"m{i}", t, "e") for i, t in enumerate(stored)] + [("u", "m0", "नगर", None), ("t", "null", None, None)], "tbl string, match_id string, text string, form string")
    f = {}
    for i, t in enumerate(stored):
        f.setdefault(fold(t), []).append(f"m{i}")
    want = {("t", i, m) for i, t in texts if t and t.strip() and t not in stored for m in f.get(fold(t), [])}
    got = [tuple(r) for r in look_alikes(df, own).collect()]
    assert set(got) == want and len(got) == len(set(got)) and ("t", 904, "m61") in want
    assert look_alikes(df.limit(0), own).count() == 0 == look_alikes(df, own.limit(0)).count()
    c = {r.rec_id: r.canonical for r in consistent(df, own, "rec_id").collect()}
    assert c[900] is None and c[901] is None and c[904] == "WIDE पाठ"
    assert len({c[i] for i, t in texts if t and t.strip()}) == len({fold(t) for _, t in texts if t and t.strip()})
