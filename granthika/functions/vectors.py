"""Vector functions as column expressions, and the hashed encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """``v`` scaled to length 1; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def int8(v: Column) -> Column:
    """Components times 127, rounded half to even, clipped to -127..127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x.cast("float") * F.lit(127.0).cast("float")).cast("double")))).cast("tinyint"))


def sign_bits(v: Column) -> Column:
    """Signs packed into 64-bit words, the first component in the lowest bit; zero counts as no."""
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 64 + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 64).cast("int") - 1, F.lit(0))), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


@lru_cache(maxsize=1 << 17)
def _slot(token: str, size: int) -> tuple[int, float]:
    """Place and sign of a token, from its MD5: any engine can repeat them."""
    d = hashlib.md5(token.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
    return int.from_bytes(d[1:5], "big") % size, 1.0 if d[0] >= 0x80 else -1.0


def token_counts(tokens: list[str], size: int = 256) -> np.ndarray:
    """Tokens counted at their places, with their signs: whole numbers."""
    v = np.zeros(size)
    for t in tokens:
        at, sign = _slot(t, size)
        v[at] += sign
    return v


def encode(tokens: list[str], size: int = 256) -> np.ndarray:
    """A vector of hashed token counts, scaled to length 1: deterministic, trained on nothing."""
    v = token_counts(tokens, size)
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32)


def hashed_encoder(size: int = 256):
    """A column function from an array of tokens to its vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.map(lambda ts: encode([] if ts is None else list(ts), size))

    return run.asNondeterministic()  # else evaluated once more where the vector is used twice
