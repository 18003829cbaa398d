"""Small shared column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and punctuation (Unicode categories P*), as a Java character class.
DROPPED = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{P}]"

#: a word between them
WORD = r"[^\s\x1c-\x1f\x85\p{Z}\p{P}]+"


def words_of(text: Column) -> Column:
    """The words of a text between white space and punctuation, letter case ignored."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bare(text: Column) -> Column:
    """``text`` with letter case ignored and all white space and punctuation dropped."""
    return F.regexp_replace(F.lower(text), DROPPED + "+", "")
