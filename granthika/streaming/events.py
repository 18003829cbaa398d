"""Event rows: checking their contract, holding back a sentinel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.operators.evaluation import STAGES

#: what a model answers when the sources do not have it; never shown while it may still come
SENTINEL = "NOT_IN_CONTEXT"
TYPES = ("transcript", "stage", "passages", "token", "refusal", "done", "error")


def contract(events: DataFrame) -> DataFrame:
    """``query_id, n_events, known, done_last, ending, state`` for each request.

    ``ending`` is refused, answered, passages (nothing generated) or broken; ``state`` is done, refused, or
    unverified where a refusal came after tokens.
    """
    per = events.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bool_and(F.col("type").isin(*TYPES) & (F.col("stage").isNull() | F.col("stage").isin(*STAGES))).alias("known"),
        F.max_by("type", "seq").alias("last"),
        F.count_if(F.col("type") == "done").alias("dones"),
        F.max((F.col("type") == "token").cast("int")).alias("token"),
        F.max((F.col("type") == "refusal").cast("int")).alias("refusal"),
        F.max((F.col("type") == "passages").cast("int")).alias("passages"),
    )
    ending = F.when(F.col("refusal") == 1, "refused").when(F.col("token") == 1, "answered").when(F.col("passages") == 1, "passages").otherwise("broken")
    state = F.when((F.col("refusal") == 1) & (F.col("token") == 1), "unverified").when(F.col("refusal") == 1, "refused").otherwise("done")
    return per.select("query_id", "n_events", "known", ((F.col("last") == "done") & (F.col("dones") == 1)).alias("done_last"), ending.alias("ending"), state.alias("state"))


def released(stream: DataFrame) -> DataFrame:
    """``query_id, seq, text``: what is shown at each piece, once no sentinel can come any more.

    ``stream`` has ``query_id, seq, piece``. Pieces are held back while all of them together, stripped, are a prefix of the
    sentinel; the first piece that breaks it releases what was held. An answer that is the sentinel shows nothing.
    Only the pieces before the sentinel's length is reached are put together, by a running sum.
    """
    before = Window.partitionBy("query_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.length(F.regexp_replace("piece", r"\s+", ""))).over(before), F.lit(0))
    placed = stream.select("query_id", "seq", "piece", seen.alias("_seen"))
    heads = placed.where(F.col("_seen") <= len(SENTINEL)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("h"))
    upto = lambda i: F.array_join(F.slice("h", F.lit(1), i)["piece"], "")
    held = F.size(F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.lit(SENTINEL).startswith(F.trim(upto(i)))))
    first = heads.withColumn("_n", held).select("query_id", F.get("h", F.col("_n"))["seq"].alias("_first"), upto(F.col("_n") + 1).alias("_text"))
    shown = placed.join(first, "query_id").where(F.col("seq") >= F.col("_first"))
    return shown.select("query_id", "seq", F.when(F.col("seq") == F.col("_first"), F.col("_text")).otherwise(F.col("piece")).alias("text"))


def release_stream(stream: DataFrame) -> DataFrame:
    """``released`` over a streaming DataFrame, with the held pieces as the state of each request.

    Pieces of one request must arrive in order. The state ends with the first release.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, open_ = state.get if state.exists else ("", False)
        out = []
        for batch in batches:
            for seq, piece in batch.sort_values("seq")[["seq", "piece"]].itertuples(index=False):
                if open_:
                    out.append((key[0], seq, piece))
                    continue
                held += piece
                if SENTINEL.startswith(held.strip()):
                    continue
                out.append((key[0], seq, held))
                held, open_ = "", True
        state.update((held, open_))
        yield pd.DataFrame(out, columns=["query_id", "seq", "text"])

    return stream.groupBy("query_id").applyInPandasWithState(step, "query_id bigint, seq int, text string", "held string, open boolean", "append", "NoTimeout")
