"""Column functions over what travels between services: media types, event streams, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def audio_bytes(data: Column) -> Column:
    """Base64 text as bytes; text that is no base64 is null."""
    return F.try_to_binary(data, F.lit("base64"))


def extension(media_type: Column) -> Column:
    """``webm`` of ``audio/webm;codecs=opus``."""
    return F.substring_index(F.substring_index(media_type, "/", -1), ";", 1)


def stream_delta(line: Column) -> Column:
    """The text that a server-sent line adds; null for other lines, the end mark and broken JSON."""
    body = F.when(line.startswith("data: "), F.substring(line, 7, 1 << 30))
    return F.when(body != "[DONE]", F.get_json_object(body, "$.choices[0].delta.content"))


def backoff(attempt: Column, base: float = 0.25, cap: float = 4.0) -> Column:
    """Seconds to wait after an attempt (from 0), doubled each time up to ``cap``, without jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def retryable(status: Column) -> Column:
    """Whether an HTTP status is worth another attempt: 429 and the server's own errors."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))


def query_text(text: Column) -> Column:
    """``text`` as a search model expects a question."""
    return F.concat(F.lit("query: "), text)


def passage_text(text: Column) -> Column:
    """``text`` as a search model expects a passage."""
    return F.concat(F.lit("passage: "), text)
