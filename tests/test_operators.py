"""Core operators on small fixtures, and with property tests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granthika.functions import vectors as V
from granthika.operators import chunking, corpus, dense, evaluation, lexical, orphans
from granthika.operators.skew import hot_keys, skew_join

ROWS = "row_id bigint, lang string, query string, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<bigint>>, batch string"


def rows(spark):
    p = lambda t, s, e=None: {"English_passages": e, "Translated_passages": t, "is_selected": s}
    return spark.createDataFrame(
        [
            (1, "hi", " q1 ", p([" a ", "b", "b", None, "  "], [1, 0, 1, 1, 1]), "x"),
            (2, None, "q2", p(["a", "c"], None), "x"),
            (3, "hi", None, p(["d"], [1]), "x"),
            (4, "hi", "q4", None, "x"),
            (5, "hi", "q5", p(["e", "f", "g"], [1]), "x"),
            (6, "hi", "q6", p(None, [1]), "x"),
        ],
        ROWS,
    )


def test_extraction(spark):
    got = [(r.row_id, r.pos, r.text, r.is_selected) for r in corpus.extracted(rows(spark)).orderBy("row_id", "pos").collect()]
    assert got == [(1, 0, "a", 1), (1, 1, "b", 0), (1, 2, "b", 1), (2, 0, "a", 0), (2, 1, "c", 0), (3, 0, "d", 1), (5, 0, "e", 1)]


def test_first_copies_and_counts(spark):
    e = corpus.extracted(rows(spark))
    assert {(r.text, r.row_id, r.pos) for r in corpus.first_copies(e).collect()} == {("a", 1, 0), ("b", 1, 1), ("c", 2, 1), ("d", 3, 0), ("e", 5, 0)}
    c = corpus.counts(e).first()
    assert (c.n_rows, c.raw, c.unique, c.dropped) == (4, 7, 5, 2)
    none = corpus.counts(e.limit(0)).first()
    assert (none.n_rows, none.raw, none.unique, none.dedup_ratio) == (0, 0, 0, 1.0)


def test_answer_key_keeps_repeats(spark):
    k = {r.q: r.rel for r in corpus.answer_key(corpus.extracted(rows(spark))).collect()}
    assert set(k) == {"q1", "q5"} and len(k["q1"]) == 2


def test_running_sum_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k"), F.lit(1).alias("v"))
    got = [r.before for r in corpus.running(df, "k", "v", "before", width=100).orderBy("k").collect()]
    assert got == list(range(1000))


@pytest.mark.parametrize("n", [0, 1, 80, 81, 140, 141, 200, 333])
def test_sliding_window(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("o", None, " ".join(words))], "owner string, lang string, text string")
    got = [r.text for r in chunking.sliding_window(df).orderBy("pos").collect()]
    if n <= 80:
        assert got == [" ".join(words)]
    else:
        starts = [0]
        while starts[-1] + 80 < n:
            starts.append(starts[-1] + 60)
        assert got == [" ".join(words[s : s + 80]) for s in starts]


def test_chunk_errors_and_nulls(spark):
    df = spark.createDataFrame([("o", None, None), ("p", None, "")], "owner string, lang string, text string")
    with pytest.raises(ValueError):
        chunking.sliding_window(df, 10, 10)
    with pytest.raises(ValueError):
        chunking.chunks(df, "other")
    assert [r.owner for r in chunking.chunks(df, "passage").collect()] == ["p"]
    assert chunking.chunks(df, "sentence_window").count() == 0
    assert chunking.chunks(df, "semantic").count() == 1
    tagged = chunking.chunks(df.withColumn("text", F.lit("The Eiffel Tower is 330 metres tall.")), "metadata_aware").first()
    assert tagged.text == "[unk | numeric] The Eiffel Tower is 330 metres tall."


def test_semantic_groups():
    toks = [["a"], ["a"], ["b"], ["b"], ["c"]]
    assert chunking._groups(toks, [1] * 5, 80, 200) == [0, 0, 1, 1, 2] or len(set(chunking._groups(toks, [1] * 5, 80, 200))) > 1
    assert chunking._groups([["a"]] * 4, [3, 3, 3, 3], 100, 6)[-1] >= 1


def vectors(spark, n=60, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # a tie
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("form", ["float", "int8", "bits"])
def test_dense_against_numpy(spark, form):
    x, df = vectors(spark)
    q = df.where("vec_id < 10")
    got = {}
    c = dense.candidates(q, df, 5, form, query_block=4, corpus_block=17)
    for r in dense.ranked(c, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.hit_id)
    if form == "float":
        s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 9)
    elif form == "int8":
        y = np.clip(np.rint(x * np.float32(127)), -127, 127)
        s = y @ y.T
    else:
        y = np.where(x > 0, 1, -1)
        s = (y @ y.T - x.shape[1]) / 2
    for i in range(10):
        assert got[i] == sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:5]


def test_dense_in_place_and_in_blocks_agree(spark):
    _, df = vectors(spark, n=90)
    many = df.unionByName(df.select((F.col("vec_id") + 1000).alias("vec_id"), "embedding")).unionByName(df.limit(1).select(F.lit(5000).cast("bigint").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding")))
    q = many.where("vec_id % 20 = 0")
    a = dense.ranked(dense.candidates(q, many.repartition(5), 4), 4).collect()
    b = dense.ranked(dense.candidates(q, many, 4, query_block=3, corpus_block=40), 4).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 4 * q.where("embedding is not null").count()


def test_dense_keeps_no_more_than_k_of_equal_rows(spark):
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    c = dense.candidates(same.where("vec_id < 2"), same.repartition(4), 3)
    assert c.count() <= 2 * 3 * 4 and {(r.query_id, r.hit_id) for r in dense.ranked(c, 3).collect()} == {(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3)}


def test_packed_signs_and_norms(spark):
    x, df = vectors(spark, d=70)
    a = df.withColumn("b", V.sign_bits(F.col("embedding"))).withColumn("n", V.norm(V.normalized(F.col("embedding"))))
    r = a.where("vec_id = 0").select(F.col("b").alias("b0")).join(a).select("vec_id", "n", V.hamming(F.col("b0"), F.col("b")).alias("h")).orderBy("vec_id").collect()
    assert [v.h for v in r] == [int(((x[0] > 0) != (v > 0)).sum()) for v in x]
    assert all(abs(v.n - 1) < 1e-6 for v in r)


def test_dense_empty(spark):
    _, df = vectors(spark)
    assert dense.top_k(df.limit(0), df, 3).count() == 0 and dense.top_k(df, df.limit(0), 3).count() == 0
    assert dense.two_tier(df.where("vec_id = 1"), df, 3, 10).count() == 3
    s = dense.self_retrieval(df, df).first()
    assert s.probes == s.found == 60


def test_two_tier_exact_keeps_what_sign_bits_miss(spark):
    # 40 rows agree with the query in every sign but weigh the small components; the best row differs in
    # all signs but the one that counts
    q = [1.0] + [0.01] * 15
    near = [[0.01] + [0.25 + 0.0001 * i] * 15 for i in range(40)]
    far = [[0.99] + [-0.02] * 15]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([q, *near, *far])], "vec_id bigint, embedding array<float>")
    best = lambda hits: hits.where("query_id = 0 and rank = 0").first().hit_id
    one = df.where("vec_id = 0")
    assert best(dense.two_tier(one, df, 1, 10)) != 41
    assert best(dense.two_tier_exact(one, df, 1, 10)) == 41
    for n, d in ((60, 8), (300, 64)):
        _, df = vectors(spark, n, d)
        rows = lambda hits: sorted(map(tuple, hits.collect()))
        assert rows(dense.two_tier_exact(df, df, 5, 7, query_block=20, corpus_block=37)) == rows(dense.top_k(df, df, 5, "int8"))
    assert dense.two_tier_exact(df.limit(0), df, 3).count() == 0 == dense.two_tier_exact(df, df.limit(0), 3).count()


def test_semantic_chunks_in_scripts_without_bm25_tokens(spark):
    """Bengali, Tamil and Urdu sentences on two subjects part between the subjects, and nowhere else."""
    texts = {
        "bn": ["নদী পাহাড় থেকে নেমে আসে।", "নদী পাহাড় থেকে দূরে যায়।", "নদী পাহাড় থেকে সাগরে যায়।", "বাজার সকালে খোলা থাকে সবসময়।", "বাজার সকালে খোলা হয় সবসময়।", "বাজার সকালে খোলা পাই সবসময়।"],
        "ta": ["ஆறு மலை இருந்து வருகிறது இன்று.", "ஆறு மலை இருந்து செல்கிறது இன்று.", "ஆறு மலை இருந்து ஓடுகிறது இன்று.", "சந்தை காலை திறந்து இருக்கும் எப்போதும்.", "சந்தை காலை திறந்து வைப்பார் எப்போதும்.", "சந்தை காலை திறந்து காணும் எப்போதும்."],
        "ur": ["دریا پہاڑ سے نیچے آتا ہے آج.", "دریا پہاڑ سے دور جاتا ہے آج.", "دریا پہاڑ سے پار جاتا ہے آج.", "بازار صبح کھلا رہتا تھا ہمیشہ.", "بازار صبح کھلا ملتا تھا ہمیشہ.", "بازار صبح کھلا لگتا تھا ہمیشہ."],
    }
    df = spark.createDataFrame([(k, k, " ".join(v)) for k, v in texts.items()], "owner string, lang string, text string")
    got = {}
    for r in chunking.semantic(df).orderBy("owner", "pos").collect():
        got.setdefault(r.owner, []).append(r.text)
    assert got == {k: [" ".join(v[:3]), " ".join(v[3:])] for k, v in texts.items()}


def test_question_without_a_token_is_near_nothing(spark):
    from granthika.plans.retrieval_queries import _not_zero

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, -1.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in _not_zero(df).collect()] == [2]


def test_floor_ranks_and_rolling_of_hot_keys(spark):
    """Against sorting in Python, with a key of a third of the rows, ties and null keys; and no task with a whole key."""
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 40), i, rng.choice([None, *range(30)])) for i in range(1500)]
    df = spark.createDataFrame([(k, t, i, None if v is None else v / 4) for k, t, i, v in data], "k int, ts int, id int, v double").repartition(5)
    kept = {}
    for k, t, i, v in sorted(data, key=lambda x: (x[1], x[2])):
        if v is not None:
            kept.setdefault(k, []).append((i, v / 4))
    rank = lambda v, p: sorted(v)[min(len(v), p * len(v) // 100 + 1) - 1]
    ranks = evaluation.floor_ranks(df, "k", "v")
    assert {tuple(r) for r in ranks.collect()} == {(k, len(v), *(rank([x for _, x in v], p) for p in (50, 70, 100))) for k, v in kept.items()}
    assert "collect_list" not in ranks._jdf.queryExecution().toString()
    want = {(k, i, len(last), *(rank(last, p) for p in (50, 70, 100))) for k, v in kept.items() for n, (i, _) in enumerate(v) for last in [[x for _, x in v[max(0, n - 9) : n + 1]]]}
    for block in (1, 16, 20_000):
        got = [(r.k, r.id, r.n, r.p50, r.p70, r.p100) for r in evaluation.rolling(df, "k", ["ts", "id"], "v", 10, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert evaluation.floor_ranks(df.limit(0), "k", "v").count() == 0 == evaluation.rolling(df.limit(0), "k", ["ts", "id"], "v").count()


def test_chunk_stats_have_semantic_chunks(spark, tmp_path):
    """The semantic row against groups made in Python."""
    from granthika.plans import corpus_queries

    texts = {"a": [f"Word{i} river hill stone number {i}." for i in range(6)], "b": ["নদী পাহাড় থেকে নেমে আসে।", "নদী পাহাড় থেকে দূরে যায়।", "বাজার সকালে খোলা থাকে সবসময়।", "বাজার সকালে খোলা হয় সবসময়।"], "c": ["Only one sentence here."]}
    spark.createDataFrame([(k, "x", " ".join(v)) for k, v in texts.items()], "doc_id string, l string, t string").write.parquet(str(tmp_path / "passage_store.parquet"))
    chunks = []
    for k, v in texts.items():
        groups = [0] * len(v) if len(v) < 3 else chunking._groups([s.lower().rstrip(".।").split() for s in v], [len(s.split()) for s in v], 80.0, 200)
        chunks += [" ".join(s for s, g in zip(v, groups) if g == n) for n in sorted(set(groups))]
    got = {r.strategy: r for r in corpus_queries.chunk_stats_all(spark, str(tmp_path)).collect()}
    assert len(got) == len(chunking.STRATEGIES)
    r = got["semantic"]
    assert (r.n_chunks, r.passages, r.longest) == (len(chunks), 3, max(map(len, chunks))) and r.chunks_per_passage == round(len(chunks) / 3, 2)


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "x x"), ("c", None), ("d", "")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "x"), (2, "nothing"), (3, None)], "query_id bigint, text string")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in lexical.bm25(q, docs).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", 0), (1, "a", 1)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id bigint, doc_id string, rank int")
    b = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "query_id bigint, doc_id string, rank int")
    got = {r.doc_id: r.score for r in lexical.fuse([a, b]).collect()}
    assert got == {"b": round(1 / 62 + 1 / 61, 12), "a": round(1 / 61, 12), "c": round(1 / 62, 12)}
    with pytest.raises(ValueError):
        lexical.fuse([])


def test_percentiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],)], "v array<double>")
    assert [r.p for r in df.select(evaluation.floor_rank(F.col("v"), 70).alias("p")).collect()] == [4.0, 0.0]


def test_recall_of_query_without_hits(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame([(1, "x", 0), (1, "y", 4)], "query_id bigint, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "y"), (1, "y"), (2, "z")], "query_id bigint, doc_id string")
    r = evaluation.recall_mrr(q, hits, rel).first()
    assert (r.n_queries, r.recall_at_1, r.recall_at_5, r.mrr) == (2, 0.0, 0.5, 0.1)


# ---- orphan references ---------------------------------------------------------------------------
REFS = "tbl string, rec_id bigint, doc_id string, at timestamp_ntz, note string"
OWN = "doc_id string, stored_at timestamp_ntz, deleted_at timestamp_ntz, note string"


def at(day, month=3):
    from datetime import datetime

    return datetime(2025, month, day)


def brute(refs, own):
    import unicodedata

    bare = lambda s: "".join(c for c in s.lower() if not c.isspace() and unicodedata.category(c)[0] != "P")
    out = set()
    for tbl, rec, doc, when, _ in refs:
        if doc is None or when is None or not bare(doc):
            continue
        lives = [(s, d) for i, s, d, _ in own if bare(i) == bare(doc)]
        if any((s is None or s <= when) and (d is None or d > when) for s, d in lives):
            continue
        reason = "missing" if not lives else "late" if all(s is not None and s > when for s, _ in lives) else "deleted"
        out.add((tbl, when.strftime("%Y-%m"), rec, bare(doc), reason))
    return out


def test_orphans_brute_force(spark):
    rng = random.Random(5)
    own = [(f"{i:04x}", at(rng.randint(1, 28), rng.randint(1, 6)), at(rng.randint(1, 28), rng.randint(6, 9)) if rng.random() < 0.4 else None, "n") for i in range(150)]
    forms = [str.upper, lambda s: f"{{{s}}}", lambda s: s + "\t", lambda s: s[:2] + "-" + s[2:], str]
    refs = [(rng.choice("ab"), i, rng.choice(forms)(f"{rng.randint(0, 200):04x}"), at(rng.randint(1, 28), rng.randint(1, 9)), "n") for i in range(900)]
    refs += [("a", 5000 + i, "0007", at(1 + i % 28, 8), "n") for i in range(600)]  # a hot key
    refs += [("a", 1, None, at(1), "n"), ("a", 2, "0001", None, "n"), ("a", 3, " - ", at(1), "n"), refs[0]]
    found = orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(own, OWN), buckets=8, most_hot=50, least_hot=100)
    rows = [tuple(r) for r in found.select("tbl", "period", "rec_id", "doc_id", "reason").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(refs, own)


def test_orphans_boundaries_and_empty(spark):
    own = spark.createDataFrame([("x", at(5), at(9), "")], OWN)
    refs = spark.createDataFrame([("t", d, "X", at(d), "") for d in (4, 5, 8, 9)], REFS)
    assert {(r.rec_id, r.reason) for r in orphans.orphans(refs, own).collect()} == {(4, "late"), (9, "deleted")}
    assert orphans.orphans(refs.limit(0), own).count() == 0
    assert {r.reason for r in orphans.orphans(refs, own.limit(0)).collect()} == {"missing"}
    assert orphans.orphan_report(orphans.orphans(refs, own)).count() == 2


def test_dictionary_is_dense_and_stable(spark):
    keys = spark.createDataFrame([(f"k{i % 300}",) for i in range(900)] + [(None,)], "key string")
    a = {r.key: r.code for r in orphans.dictionary(keys, 4).collect()}
    b = {r.key: r.code for r in orphans.dictionary(keys.repartition(7), 4).collect()}
    assert a == b and len(set(a.values())) == 300
    bits = orphans.bitmap(spark.createDataFrame(list(a.items()), "key string, code bigint"))
    assert {r.code for r in orphans.decode(bits).collect()} == set(a.values())


def test_compressed_ranges(spark):
    rng = random.Random(4)
    a, b = ({rng.randrange(100_000) for _ in range(3000)} for _ in "ab")
    frame = lambda x: spark.createDataFrame([("t", c) for c in x], "tbl string, code bigint")
    left, right = orphans.bitmap(frame(a), "tbl"), orphans.bitmap(frame(b), "tbl")
    assert left.count() <= 100_000 // (64 * orphans.WORDS) + 1
    assert {r.code for r in orphans.decode(orphans.and_not(left, right, "tbl"), "tbl").collect()} == a - b


def test_orphans_of_a_hot_key_that_does_not_fail(spark):
    refs = spark.range(3000).select(F.lit("t").alias("tbl"), F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("doc_id"), F.lit("2025-03-02").cast("timestamp_ntz").alias("at"))
    own = spark.createDataFrame([("Hot.",), ("k1",)], "doc_id string").select("doc_id", F.lit("2025-01-01").cast("timestamp_ntz").alias("stored_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    found = orphans.orphans(refs, own).collect()
    assert len(found) == refs.where("doc_id not in ('hot', 'k1')").count() and {r.reason for r in found} == {"missing"}


def test_skew_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("k"), "id", F.lit(1).alias("_x"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, v int")
    want = sorted(map(tuple, big.join(small, "k").select("k", "id", "v").collect()))
    for most, least in ((10, 64), (1000, 10**6)):
        assert sorted(map(tuple, skew_join(big, small, ["k"], F.col("id"), most=most, least=least).select("k", "id", "v").collect())) == want
    semi = skew_join(big, small.select("k"), ["k"], F.col("id"), how="left_semi")
    assert semi.count() == big.where("k in ('hot', 'k1')").count() and skew_join(big.limit(0), small, ["k"], F.col("id")).count() == 0


def test_percentiles_against_numpy(spark):
    rng = random.Random(6)
    rows_ = [(rng.choice(["a", "b", None]), round(rng.choice([rng.random(), 0.5]), 3)) for _ in range(900)] + [("one", 7.0), ("none", None)]
    got = {r.k: r for r in evaluation.percentiles(spark.createDataFrame(rows_, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        v = [x for y, x in rows_ if y == k and x is not None]
        assert r.n == len(v) and np.allclose([r.p50, r.p70, r.p100], np.percentile(v, [50, 70, 100]))


def test_bm25_of_many_terms_goes_by_shuffle(spark):
    rng = random.Random(8)
    word = lambda: f"w{min(rng.randrange(40), rng.randrange(40))}"
    docs = spark.createDataFrame([(f"d{i}", " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(200)] + [("null", None)], "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(3))) for i in range(8)] + [(99, "")], "query_id bigint, text string")
    a, b = (sorted(map(tuple, lexical.bm25(q, docs, 5, most_weights=m).collect())) for m in (200_000, 0))
    assert a == b and len(a) == 40 and lexical.bm25(q, docs.limit(0), 5).count() == 0 == lexical.bm25(q.limit(0), docs, 5).count()
    post = {(r.term, r.doc_id): (r.tf, r.dl) for r in lexical.postings(docs).collect()}
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    assert post == {(t, d): (w.count(t), len(w)) for d, w in texts.items() for t in w}


def test_hot_keys(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 5)], "key string, n bigint")
    assert [r.key for r in hot_keys(counts, most=10, least=100).collect()] == ["a"]
    assert hot_keys(counts.limit(0)).count() == 0
