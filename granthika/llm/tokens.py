"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: how the rank files split text before merging (fixed with the vocabulary)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = TOKENIZER):
    """A column function from text to its number of tokens; null has none, empty text 0."""

    @F.pandas_udf(IntegerType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for series in texts:
            yield series.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int32")

    return count.asNondeterministic()  # else counted once more for filters on the count
