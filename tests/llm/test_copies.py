"""Copies against grouping in Python."""

import json

from pyspark.sql import functions as F

from granthika.llm.copies import collapse, copies, payload_records, text_key


def records(spark, n=300):
    forms = ["Ab c, d", "ab cd", " A B\u00a0C-D ", "abcd।"]
    rows = [("t", i, forms[i % 4], "x") for i in range(n)] + [("t", 900 + i, f"only {i}", "x") for i in range(20)] + [("u", 1, "abcd", None), ("t", 5000, None, None)]
    return spark.createDataFrame(rows, "tbl string, rec bigint, text string, copies string").withColumn("key", text_key(F.col("text")))


def test_hot_group(spark):
    for least in (10, 10_000):
        c = {(r.tbl, r.keep_key): r.copies for r in collapse(records(spark), 50, least).collect()}
        assert c[("t", 0)] == 300 and c[("u", 1)] == 1 and len(c) == 22 and sum(c.values()) == 321
        d = copies(records(spark), 50, least).collect()
        assert {(r.keep_key, r.dup_key) for r in d} == {(0, i) for i in range(1, 300)}
    assert collapse(records(spark).limit(0)).count() == 0 == copies(records(spark).limit(0)).count()


def test_payloads(spark):
    base = {"query_id": 1, "doc_id": "Ab-1", "text": "A b", "score": 0.5, "rank": 3}
    lines = [json.dumps(base), json.dumps(dict(reversed(base.items())), indent=1), '{"query_id":1.0,"doc_id":" ab1 ","text":"ab","score":0.50,"rank":3}', json.dumps(base)[:-9], None, "", "[]", json.dumps(base | {"text": None}), json.dumps({k: v for k, v in base.items() if k != "text"}), json.dumps(base | {"text": ""})]
    df = spark.createDataFrame([(i, p, 0) for i, p in enumerate(lines)], "log_id bigint, payload string, rec int")
    rec = payload_records(df).withColumn("tbl", F.lit("h"))
    assert {(r.keep_key, r.copies) for r in collapse(rec).collect()} == {(0, 3), (7, 2), (9, 1)}
    assert {(r.keep_key, r.dup_key) for r in copies(rec).collect()} == {(0, 1), (0, 2), (7, 8)}
