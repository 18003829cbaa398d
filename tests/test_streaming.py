"""Streaming jobs give what their batch forms give, across restarts."""

import pandas as pd
from pyspark.sql import functions as F

from granthika.functions.text import content_id
from granthika.operators.corpus import extracted, first_copies
from granthika.streaming import events, ingest


def test_ingest_resumes(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/source_rows.parquet")
    folder = str(tmp_path / "in")
    rows.where("row_id <= 30").coalesce(1).write.parquet(folder)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    go = lambda: ingest.run_once(ingest.distinct_passages(ingest.source_stream(spark, folder, rows.schema)), out, state)
    go()
    n = spark.read.parquet(out).count()
    rows.where("row_id > 20").coalesce(1).write.mode("append").parquet(folder)  # some rows come again
    go()
    got = spark.read.parquet(out)
    texts = rows.select(F.explode("passages.Translated_passages").alias("t")).where("length(trim(t)) > 0")
    from granthika.sources.tables import strip

    assert n < got.count() == texts.select(content_id(strip(F.col("t")))).distinct().count()
    assert got.count() >= first_copies(extracted(rows)).count()


def stream_rows():
    out = []
    for q, text in ((1, ["NOT_IN", "_CONTEXT"]), (2, ["NOT", " here"]), (3, ["a", " b"]), (4, ["NOT_IN_CONTEXT", "."])):
        out += [(q, i, p) for i, p in enumerate(text)]
    return out


EXPECTED = {(2, 1, "NOT here"), (3, 0, "a"), (3, 1, " b"), (4, 1, "NOT_IN_CONTEXT.")}


def test_hold_back_batch(spark):
    df = spark.createDataFrame(stream_rows(), "query_id bigint, seq int, piece string")
    assert {tuple(r) for r in events.released(df).collect()} == EXPECTED


def test_hold_back_stream(spark, tmp_path):
    schema = "query_id bigint, seq int, piece string"
    folder = str(tmp_path / "in")
    for i in (0, 1):
        pd.DataFrame([r for r in stream_rows() if r[1] == i], columns=["query_id", "seq", "piece"]).astype({"seq": "int32"}).pipe(lambda p: spark.createDataFrame(p, schema)).coalesce(1).write.mode("append").parquet(folder)
        s = events.release_stream(spark.readStream.schema(schema).parquet(folder))
        ingest.run_once(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == EXPECTED


def test_contract(spark):
    e = spark.createDataFrame([(1, 0, "stage", "safety"), (1, 1, "token", None), (1, 2, "refusal", None), (1, 3, "done", None), (2, 0, "done", None), (2, 1, "token", None), (3, 0, "odd", None)], "query_id bigint, seq int, type string, stage string")
    got = {r.query_id: (r.known, r.done_last, r.ending, r.state) for r in events.contract(e).collect()}
    assert got == {1: (True, True, "refused", "unverified"), 2: (True, False, "answered", "done"), 3: (False, False, "broken", "done")}
