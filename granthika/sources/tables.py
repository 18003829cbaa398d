"""The input tables and the flattening of nested passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space as Python's str.isspace has it, as a Java character class.
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# ---- fixed values: languages of the source rows, by code
LANGUAGES = ("as", "bn", "gu", "hi", "kn", "ml", "mr", "ne", "or", "pa", "sa", "ta", "ur")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def of_language(rows: DataFrame, lang: str, column: str = "lang") -> DataFrame:
    """The rows of one language; a code that is none is an error that lists the known ones."""
    if lang not in LANGUAGES:
        raise ValueError(f"unknown language {lang!r}; known: {', '.join(LANGUAGES)}")
    return rows.where(F.col(column) == lang)


#: the same characters one by one
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """``text`` without the white space around it (Unicode white space, not only ASCII)."""
    return F.trim(text, F.lit(SPACES))


def not_blank(text: Column) -> Column:
    """True where ``text`` is neither null nor only white space."""
    return F.coalesce(text.rlike(rf"[^{SPACE[1:]}"), F.lit(False))


def passages(rows: DataFrame, column: str = "Translated_passages") -> DataFrame:
    """One row per non-blank passage: ``row_id, pkey, pos, lang, text``.

    ``pkey`` is ``row_id * 100 + pos``. A null struct, a null list, and null or blank elements give
    no row; repeated rows stay, as each has its own ``row_id``. Only one nested column is read.
    """
    return (
        rows.select("row_id", "lang", F.posexplode(F.col(f"passages.{column}")).alias("pos", "text"))
        .where(not_blank(F.col("text")))
        .select("row_id", (F.col("row_id") * 100 + F.col("pos")).alias("pkey"), "pos", "lang", "text")
    )


def response_passages(responses: DataFrame) -> DataFrame:
    """One row per non-blank text inside a response: ``query_id, okey, pos, text``."""
    return (
        responses.select("query_id", F.posexplode("passages").alias("pos", "p"))
        .select("query_id", "pos", F.col("p.text").alias("text"))
        .where(not_blank(F.col("text")))
        .select("query_id", (F.col("query_id") * 100 + F.col("pos")).alias("okey"), "pos", "text")
    )
