"""Five ways to cut texts into chunks; each maps ``owner, lang, text`` to rows of one schema.

``owner, strategy, pos, n_parts, text, window_text, tags``: ``window_text`` only of sentence windows,
``tags`` only of tagged chunks. Null texts give no chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from granthika.functions.text import content_tags, encoder_tokens, split_sentences, words
from granthika.functions.vectors import token_counts

SIZE, STEP_BACK = 80, 20
STRATEGIES = ("passage", "sentence_window", "sliding_window", "semantic", "metadata_aware")


def _shaped(df: DataFrame, strategy: str, pos: Column, n_parts: Column, text: Column, window: Column | None = None) -> DataFrame:
    return df.select("owner", "lang", F.lit(strategy).alias("strategy"), pos.cast("int").alias("pos"), n_parts.cast("int").alias("n_parts"), text.alias("text"), (window if window is not None else F.lit(None).cast("string")).alias("window_text"), F.lit(None).cast("array<string>").alias("tags"))


def passage(df: DataFrame) -> DataFrame:
    """The text itself as its one chunk."""
    return _shaped(df.where("text is not null"), "passage", F.lit(0), F.lit(1), F.col("text"))


def sentence_window(df: DataFrame, window: int = 1) -> DataFrame:
    """A chunk per sentence, with its neighbours up to ``window`` away as window text."""
    s = df.where("text is not null").withColumn("_s", split_sentences(F.col("text")))
    each = s.select("owner", "lang", "_s", F.posexplode("_s").alias("_i", "_t"))
    first = F.greatest(F.col("_i") - window, F.lit(0))
    around = F.array_join(F.slice("_s", first + 1, F.col("_i") + window + 1 - first), " ")
    return _shaped(each, "sentence_window", F.col("_i"), F.size("_s"), F.col("_t"), around)


def sliding_window(df: DataFrame, size: int = SIZE, overlap: int = STEP_BACK) -> DataFrame:
    """Windows of ``size`` words, each beginning with the last ``overlap`` words of the one before.

    A text of at most ``size`` words, an empty one too, stays as it is. ``overlap`` must be smaller.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    w = df.where("text is not null").withColumn("_w", words(F.col("text")))
    n = F.when(F.size("_w") <= size, F.lit(1)).otherwise(F.ceil((F.size("_w") - size) / step).cast("int") + 1)
    each = w.withColumn("_n", n).select("owner", "lang", "text", "_w", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    text = F.when(F.col("_n") == 1, F.col("text")).otherwise(F.array_join(F.slice("_w", F.col("_i") * step + 1, size), " "))
    return _shaped(each, "sliding_window", F.col("_i"), F.col("_n"), text)


def semantic(df: DataFrame, percentile: float = 80.0, least_sentences: int = 3, most_words: int = 200) -> DataFrame:
    """Consecutive sentences grouped by the similarity of neighbours, under the hashed encoder.

    Texts of fewer than ``least_sentences`` sentences stay whole.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def group(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for toks, lengths in batches:
            yield pd.Series([None if t is None or len(t) < least_sentences else _groups(t, n, percentile, most_words) for t, n in zip(toks, lengths)])

    group = group.asNondeterministic()  # else evaluated once more for inferred filters
    s = df.where("text is not null").withColumn("_s", split_sentences(F.col("text")))
    s = s.withColumn("_g", group(F.transform("_s", encoder_tokens), F.transform("_s", lambda x: F.size(words(x)))))
    whole = F.array(F.col("text"))
    joined = F.transform(F.sequence(F.lit(0), F.element_at("_g", -1)), lambda g: F.array_join(F.filter(F.col("_s"), lambda x, i: F.element_at(F.col("_g"), i + 1) == g), " "))
    each = s.withColumn("_c", F.when(F.col("_g").isNull(), whole).otherwise(joined)).select("owner", "lang", F.size("_c").alias("_n"), F.posexplode("_c").alias("_i", "_t"))
    return _shaped(each, "semantic", F.col("_i"), F.col("_n"), F.col("_t"))


def _groups(token_lists, word_counts, percentile: float, most_words: int) -> list[int]:
    """For each sentence the number of its group. A group ends where the distance to the next sentence
    is at or above the percentile of all distances, or once it holds ``most_words`` words."""
    v = np.stack([token_counts(list(t)) for t in token_lists])
    length = np.sqrt((v * v).sum(axis=1))
    both = length[:-1] * length[1:]
    # a sentence without a token is like no other; distances count to nine decimals
    distance = np.round(1.0 - np.divide((v[:-1] * v[1:]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0), 9)
    limit = np.round(np.percentile(distance, percentile), 9)
    out, group, held = [], 0, 0
    for i, n in enumerate(word_counts):
        out.append(group)
        held += int(n)
        if held >= most_words or (i < len(distance) and distance[i] >= limit):
            group, held = group + 1, 0
    return out


def metadata_aware(chunks: DataFrame) -> DataFrame:
    """Another chunker's chunks, each with its language and tags before the text."""
    tags = content_tags(F.col("text"))
    lead = F.concat(F.lit("["), F.coalesce("lang", F.lit("unk")), F.lit(" | "), F.array_join(tags, " "), F.lit("] "))
    return chunks.select("owner", "lang", F.concat(F.lit("metadata_aware("), "strategy", F.lit(")")).alias("strategy"), "pos", "n_parts", F.concat(lead, F.col("text")).alias("text"), "window_text", tags.alias("tags"))


def chunks(df: DataFrame, strategy: str) -> DataFrame:
    """Chunks by the name of a strategy; an unknown name is an error that lists the known ones."""
    if strategy == "metadata_aware":
        return metadata_aware(sentence_window(df))
    makers = {"passage": passage, "sentence_window": sentence_window, "sliding_window": sliding_window, "semantic": semantic}
    if strategy not in makers:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return makers[strategy](df)
