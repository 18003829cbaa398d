"""Near-duplicates against all pairs, signatures against true similarity, components against a graph walk."""

import random

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthika.llm import neardup
from granthika.llm.neardup import by_rarest_runs, components, near_groups, near_pairs, runs_of, signed, superminhash

D = regex.compile(r"[\s\p{P}]+")
SCHEMA = "tbl string, scope bigint, key bigint, text string, extra string"


def runs(t, w):
    ws = [x for x in D.split((t or "").lower()) if x]
    return frozenset(tuple(ws[i : i + w]) for i in range(max(1, len(ws) - w + 1))) if ws else frozenset()


def brute(rows, w, s):
    out = set()
    for i, (ta, sa, ka, a, _) in enumerate(rows):
        for tb, sb, kb, b, _ in rows[i + 1 :]:
            x, y = runs(a, w), runs(b, w)
            if ta == tb and sa == sb and x and y and ka != kb and len(x & y) / len(x | y) >= s and D.sub("", a.lower()) != D.sub("", b.lower()):
                out.add((ta, min(ka, kb), max(ka, kb)))
    return out


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"शब्द{i}" for i in range(400)]
    rows, key = [], 0
    for scope in (-1, 5, 6):
        for _ in range(40):
            base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 80]))]
            for _ in range(rng.randint(1, 4)):
                t = list(base)
                for _ in range(rng.randint(0, 4)):
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
                sep = rng.choice([" ", "  ", ", "])
                rows.append(("t" if scope < 0 else "u", scope, key, sep.join(t), None))
                key += 1
    # one text holds a third of the rows, in two spellings that are equal when bare and one that is not
    hot = " ".join(vocabulary[:30])
    for i in range(len(rows) // 2):
        rows.append(("t", -1, key, hot if i % 2 else hot.upper() + " .", None))
        key += 1
    rows.append(("t", -1, key, hot + " और", None))
    return rows + [("t", -1, key + 1, None, "x"), ("t", -1, key + 2, "", None), ("t", -1, key + 3, " । ", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs_brute_force(spark):
    rows = texts()
    for w, s in ((3, 0.6), (5, 0.8)):
        got = [tuple(r) for r in near_pairs(frame(spark, rows), w, s).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, w, s)


def test_groups(spark):
    rows = texts(2)[:120]
    pairs = brute(rows, 3, 0.6)
    got = {(r.tbl, r.key): r.group_key for r in near_groups(frame(spark, rows), 3, 0.6).collect()}
    assert set(got) == {(r[0], r[2]) for r in rows}
    for t, a, b in pairs:
        assert got[t, a] == got[t, b]
    assert near_pairs(frame(spark, []), 3, 0.6).count() == 0 == near_groups(frame(spark, []), 3, 0.6).count()


def test_crowded_bands(spark):
    """A band that many classes share is not paired in itself, and no pair is lost."""
    rows = texts(4)
    got = [tuple(r) for r in near_pairs(frame(spark, rows), 3, 0.6, crowd=2).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=2, max_size=8), st.sampled_from([0.5, 0.6, 0.8, 1.0]))
def test_rarest_runs_lose_nothing(sets, similarity):
    """The same rule as in the operator, over sets: what reaches the similarity shares one of the first."""
    often = {x: sum(x in s for s in sets) for x in range(13)}
    order = [sorted(s, key=lambda x: (often[x], x)) for s in sets]
    first = [set(o[: len(o) - int(np.ceil(similarity * len(o) - 1e-9)) + 1]) for o in order]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= similarity:
                assert first[i] & first[j]


def test_one_band_in_very_many_classes(spark):
    """20,000 texts of 60 common and 45 own words each: too unlike to be pairs, but all with bands in common."""
    common = " ".join(f"सब{i}" for i in range(60))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string"))), " ")
    df = spark.range(20_000).repartition(8).select(F.lit("t").alias("tbl"), F.lit(-1).cast("bigint").alias("scope"), F.col("id").alias("key"), F.concat(F.lit(common + " "), own).alias("text"))
    df = df.unionByName(df.where("key % 4000 = 0").select("tbl", "scope", (F.col("key") + 100_000).alias("key"), F.concat("text", F.lit(" और कुछ")).alias("text")))
    members = signed(df, 3, 0.6)
    crowd = members.select("cls", F.explode("bands").alias("band")).groupBy("band").count().where("count > 100").join(members.select(F.explode("bands").alias("band"), "cls"), "band")
    assert crowd.select("cls").distinct().count() > 5000
    sets = neardup._runs_of_classes(members.select("cls"), members, df, 3)
    assert by_rarest_runs(sets, 0.6).count() < 1000
    assert sorted((r.key_a, r.key_b) for r in near_pairs(df, 3, 0.6).collect()) == [(k, k + 100_000) for k in range(0, 20_000, 4000)]


def test_runs_of():
    words = [[1, 2, 3, 1, 2, 3], [4], [5, 6], [1, 2, 3]]
    values = np.array([x for w in words for x in w], np.uint64)
    runs_, at = runs_of(values, np.array([len(w) for w in words]), 3)
    assert np.diff(at).tolist() == [3, 1, 1, 1] and set(runs_[at[3] :]) <= set(runs_[: at[1]])


def test_large_sets_by_parts(monkeypatch):
    x = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    at = np.array([0, 2000, 2000, 3000])
    whole = superminhash(x, at, 156)
    monkeypatch.setattr(neardup, "ELEMENTS", 100)
    assert (superminhash(x, at, 156) == whole).all()


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.2, 0.6, 0.9):
        k = int(200 * share * 2 / (1 + share))
        a, b = x[:200], x[200 - k : 400 - k]
        sig = superminhash(np.concatenate([a, b]), np.array([0, 200, 400]), 256)
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.1
    one = superminhash(x[:1], np.array([0, 1, 1]), 64)
    assert sorted(one[0].astype(int)) == list(range(64)) and np.isinf(one[1]).all()


def test_signature_ignores_order_and_batch():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 50).astype(np.uint64)
    a = superminhash(x, np.array([0, 50]), 100)
    b = superminhash(np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), x[::-1]]), np.array([0, 9, 59]), 100)
    assert (a[0] == b[1]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
