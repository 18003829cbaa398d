"""The functions under SQL names, for users who write ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from granthika.functions.text import blake_id
from granthika.functions.vectors import hashed_encoder


@udtf(returnType="pos int, n_parts int, chunk string")
class SlidingChunks:
    """``sliding_chunks(text, size, overlap)``: windows of words, a row each."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        if overlap >= size:
            raise ValueError("overlap must be smaller than size")
        if text is None:
            return
        words = text.split()
        if len(words) <= size:
            yield 0, 1, text
            return
        starts = range(0, len(words) - overlap, size - overlap)
        for i, s in enumerate(starts):
            yield i, len(starts), " ".join(words[s : s + size])


def register(spark: SparkSession) -> None:
    """Make ``blake_id``, ``hashed_vector`` and ``sliding_chunks`` known to SQL."""
    spark.udf.register("blake_id", blake_id)
    spark.udf.register("hashed_vector", hashed_encoder())
    spark.udtf.register("sliding_chunks", SlidingChunks)
