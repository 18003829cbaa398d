"""Oversized texts cut into pieces at natural boundaries (problem 4).

Content-defined chunking: a rolling hash over the text marks landmarks that depend only on the
characters around them; each cut is the sentence end nearest to the first landmark between the
least and the greatest size. An edit moves only the landmarks it touches, so only the pieces next
to it change.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from granthika.llm.sentences import spans
from granthika.sources.tables import SPACES, not_blank, strip

LIMIT, OVERLAP, LEAST, WINDOW = 800, 100, 200, 24
BASE = np.uint64(0x9E3779B97F4A7C15)
#: a landmark every 256 characters on average
MASK = np.uint64(0xFF << 40)
WORD_END = regex.compile(r"(?<=\S)(?=\s)")
CLUSTER = regex.compile(r"\X")
PIECES = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "core", "end")]))


def landmarks(text: str) -> np.ndarray:
    """Offsets behind which the rolling hash of the last ``WINDOW`` characters hits the mask."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = np.zeros(max(0, len(x) - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        h = h * BASE + x[k : k + len(h)]
    h ^= h >> np.uint64(29)
    return np.flatnonzero((h & MASK) == 0) + WINDOW


def _nearest(at: list[int], mark: int, low: int, high: int) -> int | None:
    """The member of the sorted ``at`` nearest to ``mark`` within low..high, the lower one of two."""
    i, j = bisect_left(at, low), bisect_right(at, high)
    if i == j:
        return None
    k = bisect_left(at, mark, i, j)
    return min(at[max(i, k - 1) : min(j, k + 1)], key=lambda a: (abs(a - mark), a))


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, core, end)`` of consecutive pieces; start..core repeats the end of the piece before."""
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    if last - first <= limit:
        return [(first, first, last)] if last > first else []
    marks = landmarks(text).tolist()
    sentence_ends = [b for _, b in spans(text)]
    word_ends = [m.start() for m in WORD_END.finditer(text)]
    room = limit - overlap
    out, start, core = [], first, first
    while last - start > limit:
        low, high = core + min(least, room), core + room
        i = bisect_left(marks, low)
        mark = marks[i] if i < len(marks) and marks[i] <= high else high
        end = _nearest(sentence_ends, mark, low, high) or _nearest(sentence_ends, low, core + 1, low) or _nearest(word_ends, mark, low, high) or _nearest(word_ends, low, core + 1, low)
        if end is None:  # neither sentence nor word ends here: between two clusters
            end = high
            for m in CLUSTER.finditer(text, max(core + 1, high - 64), min(len(text), high + 64)):
                if m.end() > high:
                    break
                end = m.end()
        out.append((start, core, end))
        core = end
        while core < last and text[core].isspace():
            core += 1
        k = bisect_left(word_ends, end - overlap)
        start = word_ends[k] if k < len(word_ends) and word_ends[k] < end else end - overlap
        while start < end and text[start].isspace():
            start += 1
        if start >= end:
            start = core
        elif core - start > overlap:  # white space between the pieces counts against the overlap
            start = core - overlap
            while start < core and (text[start].isspace() or not text[start - 1].isspace()) and start < end:
                start += 1
            start = core if start >= end else start
    out.append((start, core, last))
    return out


def piece_spans(limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST):
    """A column function from text to its pieces; ``least`` <= ``limit - overlap`` is needed."""
    if not 0 < least <= limit - overlap or overlap < 0:
        raise ValueError("needs 0 < least <= limit - overlap and overlap >= 0")

    @F.pandas_udf(PIECES)
    def cut_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: None if t is None else [dict(zip(("start", "core", "end"), p)) for p in cut(t, limit, overlap, least)])

    return cut_all.asNondeterministic()  # else evaluated once more for inferred filters


def pieces(df: DataFrame, text: str | Column, *keys: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """``keys, piece_no, n_pieces, start_char, core_char, end_char, piece``, a row per piece.

    Null and blank texts give no row; a text of at most ``limit`` characters, white space around it
    not counted, is one piece and never leaves the JVM. Other columns are dropped.
    """
    col = F.col(text) if isinstance(text, str) else text
    inner = strip(F.col("_t"))
    lead = F.length("_t") - F.length(F.ltrim("_t", F.lit(SPACES)))
    whole = F.array(F.struct(lead.cast("int").alias("start"), lead.cast("int").alias("core"), (lead + F.length(inner)).cast("int").alias("end")))
    return (
        df.select(*keys, col.alias("_t"))
        .where(not_blank(F.col("_t")))
        # a text of few enough characters needs no look at the white space around it
        .withColumn("_long", F.when((F.length("_t") > limit) & (F.length(inner) > limit), F.col("_t")))
        .withColumn("_cut", piece_spans(limit, overlap, least)("_long"))
        .withColumn("_p", F.coalesce("_cut", whole))
        .select(*keys, "_t", F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("piece_no", "_q"))
        .select(*keys, "piece_no", "n_pieces", F.col("_q.start").alias("start_char"), F.col("_q.core").alias("core_char"), F.col("_q.end").alias("end_char"), F.expr("substring(_t, _q.start + 1, _q.end - _q.start)").alias("piece"))
    )
