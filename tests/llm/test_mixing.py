"""Mixtures: shares, caps, determinism, hot sources."""

import random

from pyspark.sql import functions as F

from granthika.llm import mixing
from granthika.llm.mixing import draw, mixture, rates, shares


def sized(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["big", "mid", "small"], [80, 15, 5])[0], rng.randint(1, 900)) for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark, monkeypatch):
    s = sized(spark)
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 2)], TARGETS)
    r = rates(s, t)
    d = draw(s, r)
    per = {x.source: x for x in d.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("copy_no").alias("c")).collect()}
    total = sum(x.t for x in per.values())
    for name, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4)):
        assert abs(per[name].t / total - share / 0.9) < 0.01 and per[name].c < most
    assert {x.source for x in r.collect()} == {"big", "mid", "small", "none"} and "none" not in per
    assert draw(s.repartition(7), r).exceptAll(d).isEmpty()
    assert not draw(s, r, seed=7).exceptAll(d).isEmpty()
    # a source that holds most documents is numbered in many buckets, of each source as many copies come out
    few = draw(s, r, per_bucket=50)
    n = lambda df: {x.source: x["count"] for x in df.groupBy("source").count().collect()}
    assert all(abs(n(few)[k] - v) <= 1 for k, v in n(d).items())
    monkeypatch.setattr(mixing, "FEW_CLASSES", 0)
    assert draw(s, r).exceptAll(d).isEmpty() and draw(s, r).count() == d.count()
    # every document of a source is drawn once or twice as often as the rate says
    rate = {x.source: x.rate for x in r.collect()}
    counts = d.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()
    assert all(x.m <= -(-rate[x.source] // 1) + 1e-9 for x in counts)


def test_more_than_there_is(spark):
    t = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], TARGETS)
    d = draw(sized(spark), rates(sized(spark), t, total_tokens=1e12))
    assert d.groupBy("doc_id").count().where("count > 2").isEmpty()
    n = sized(spark).where("source in ('big')").count() + 2 * sized(spark).where("source = 'small'").count()
    assert d.count() == n


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a", "some text", 1.0), (2, "b", "more text here", 1.0), (3, None, "x", None), (4, "a", None, None), (5, "a", "", None), (6, "c", "y", None)], "doc_id bigint, source string, text string, rate double")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3), (None, 0.2, 1), ("d", None, None), ("e", 0.0, 0)], TARGETS)
    assert {r.doc_id for r in mixture(docs, t).collect()} <= {1, 2}
    s = {r.source: r.share for r in shares(docs, t).collect()}
    assert set(s) == {"a", "b", "d", "e"} and abs(sum(s.values()) - 1) < 1e-9
    assert mixture(docs.limit(0), t).count() == 0 and mixture(docs, t.limit(0)).count() == 0
