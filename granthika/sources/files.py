"""Files in and out: shards of vectors, answer keys as JSON lines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions.vectors import norm

QRELS = "q string, rel array<string>"
#: vectors per file, so that a file stays readable on one machine
SHARD_ROWS = 200_000


def write_shards(vectors: DataFrame, folder: str, rows: int = SHARD_ROWS) -> None:
    """``vec_id, embedding`` as Parquet files of at most ``rows`` rows; nothing is gathered."""
    vectors.write.mode("append").option("maxRecordsPerFile", rows).parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all shards with their ``shard``; a vector without an id is an error when it is read."""
    v = spark.read.parquet(folder).withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return v.withColumn("vec_id", F.coalesce("vec_id", F.raise_error(F.concat(F.lit("vector without id in "), F.col("shard")))))


def first_over_shards(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """One vector per id, of the first shard that has it; of these the first ``most`` by id."""
    first = vectors.groupBy("vec_id").agg(F.min(F.struct("shard", "embedding")).alias("f")).select("vec_id", "f.embedding", "f.shard")
    return first if most is None else first.orderBy("vec_id").limit(most)


def unit_shards(vectors: DataFrame, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """``shard, n, mean_norm`` of each shard; a shard whose mean length is not within ``low`` and ``high`` is an error when
    it is read, so that no index is made of it. Null vectors are left out."""
    per = vectors.where("embedding is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.avg(norm(F.col("embedding"))).alias("mean_norm"))
    wrong = F.raise_error(F.concat(F.lit("vectors not of length 1 in "), F.col("shard")))
    return per.withColumn("mean_norm", F.when(F.col("mean_norm").between(low, high), F.col("mean_norm")).otherwise(wrong.cast("double")))


def append_jsonl(qrels: DataFrame, folder: str) -> None:
    """Answer-key rows as JSON lines, added to what is there."""
    qrels.select("q", "rel").write.mode("append").json(folder)


def read_jsonl(spark: SparkSession, folder: str, schema: str = QRELS, most: int | None = None) -> DataFrame:
    """JSON lines under a fixed schema; lines that are no JSON give a row of nulls, which is dropped."""
    rows = spark.read.schema(schema).json(folder).where("q is not null")
    return rows if most is None else rows.limit(most)


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file, written over an older one."""
    rows.coalesce(1).write.mode("overwrite").json(path)
