"""Encoding of streams: the same narrow expression on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..api import Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text: str = "text", **options) -> DataFrame:
    """A streaming frame with ids; stateless, so it needs no watermark and restarts from its checkpoint alone."""
    if not stream.isStreaming:
        raise ValueError("not a streaming frame")
    return tokenizer.encode_df(stream, text, **options)
