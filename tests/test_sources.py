"""Files, wire functions, and SQL names."""

import pytest
from pyspark.sql import functions as F

from granthika.functions import register, wire
from granthika.operators.corpus import latest, sample_by_hash, with_default
from granthika.sources import files
from granthika.sources.tables import not_blank, passages, response_passages, strip


def test_shards(spark, tmp_path):
    a = str(tmp_path / "v")
    v = spark.range(25).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    files.write_shards(v.coalesce(1), a, rows=10)
    files.write_shards(v.where("vec_id < 5").coalesce(1), a, rows=10)
    r = files.read_shards(spark, a)
    assert r.count() == 30 and r.select("shard").distinct().count() == 4
    assert files.first_over_shards(r).count() == 25 and files.first_over_shards(r, 7).count() == 7
    files.write_shards(spark.createDataFrame([(None, [1.0])], "vec_id bigint, embedding array<double>"), a)
    with pytest.raises(Exception, match="vector without id"):
        files.read_shards(spark, a).select("vec_id").collect()


def test_jsonl(spark, tmp_path):
    p = str(tmp_path / "q")
    q = spark.createDataFrame([("क", ["a", "a"]), ("ख", [])], files.QRELS)
    files.append_jsonl(q, p)
    files.append_jsonl(q, p)
    assert files.read_jsonl(spark, p).count() == 4 and files.read_jsonl(spark, p, most=3).count() == 3
    files.write_report(q, p + "r")
    files.write_report(q.limit(1), p + "r")
    assert spark.read.json(p + "r").count() == 1


def test_wire(spark):
    df = spark.createDataFrame([("audio/webm;codecs=opus", 'data: {"choices":[{"delta":{"content":"क"}}]}', 429, 5, "aGk="), ("x", "data: [DONE]", 404, 0, "?"), (None, "data: {", 503, 1, None), ("a/b", "other", None, 2, "")], "m string, l string, s int, i int, b string")
    got = df.select(wire.extension(F.col("m")), wire.stream_delta(F.col("l")), wire.retryable(F.col("s")), wire.backoff(F.col("i")), wire.audio_bytes(F.col("b"))).collect()
    assert [r[0] for r in got] == ["webm", "x", None, "b"] and [r[1] for r in got] == ["क", None, None, None]
    assert [r[2] for r in got] == [True, False, True, False] and [r[3] for r in got] == [4.0, 0.25, 0.5, 1.0]
    assert bytes(got[0][4]) == b"hi" and got[1][4] is None
    assert df.select(wire.query_text(F.col("m")), wire.passage_text(F.col("l"))).first()[0].startswith("query: ")


def test_sql_names(spark):
    register.register(spark)
    got = spark.sql("select pos, n_parts, chunk from sliding_chunks('a b c d e', 3, 1)").collect()
    assert [tuple(r) for r in got] == [(0, 2, "a b c"), (1, 2, "c d e")]
    assert spark.sql("select blake_id('x') as b, size(hashed_vector(array('x'))) as n").first().n == 256


def test_flattening(spark):
    s = "row_id bigint, lang string, passages struct<Translated_passages:array<string>>"
    df = spark.createDataFrame([(1, None, (["a", None, " ", " b "],)), (2, "x", None), (3, "x", (None,))], s)
    assert [(r.pkey, r.text) for r in passages(df).collect()] == [(100, "a"), (103, " b ")]
    assert passages(df).select(strip(F.col("text"))).collect()[1][0] == "b"
    r = spark.createDataFrame([(1, [("d", "t"), ("e", None)]), (2, None)], "query_id bigint, passages array<struct<doc_id:string,text:string>>")
    assert [x.okey for x in response_passages(r).collect()] == [100]
    assert spark.createDataFrame([(None,), ("",), ("　",), ("x",)], "t string").where(not_blank(F.col("t"))).count() == 1


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 9, "z"), ("b", 1, None)], "k string, at int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", ["at"], "v").collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.name) for r in with_default(df.select("k"), spark.createDataFrame([("a", "A")], "k string, name string"), "k", "name", "-").collect()} == {("a", "A"), (None, "-"), ("b", "-")}
    assert sample_by_hash(df, "v", 2).count() == 2


def test_unit_shards(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.6, 0.8]), ("b", [3.0, 0.0]), ("b", None)], "shard string, embedding array<float>")
    assert [(r.shard, r.n) for r in files.unit_shards(v.where("shard = 'a'")).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="not of length 1 in b"):
        files.unit_shards(v).collect()


def test_unknown_language(spark):
    from granthika.sources.tables import of_language

    rows = spark.createDataFrame([("hi",), ("bn",), (None,)], "lang string")
    assert of_language(rows, "hi").count() == 1
    with pytest.raises(ValueError, match="known: as, bn, gu"):
        of_language(rows, "te")


def test_inconsistent_store_ends_in_an_error(spark):
    from granthika.operators.corpus import assert_consistent

    hits = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string")
    assert assert_consistent(hits.where("doc_id = 'a'"), spark.createDataFrame([("a",)], "doc_id string")).first().refs == 1
    with pytest.raises(Exception, match="1 ids have no text"):
        assert_consistent(hits, spark.createDataFrame([("a",)], "doc_id string")).collect()


def test_checkpoint_folder():
    from granthika.session import checkpoint_folder

    assert checkpoint_folder("s3://x", "spark://h") == "s3://x" and checkpoint_folder(None, "local[4]")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_folder(None, master)
