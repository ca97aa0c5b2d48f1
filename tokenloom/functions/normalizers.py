"""Normalizers: JSON descriptions compiled to functions of a column of segments (``array<string>``).

Replace and Sequence stay in the JVM.  NFC has no built-in, so it is an Arrow function over the segments.
Edge cases: a description of null is no normalizer; an unknown type, or Replace without a pattern, raises.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Error, TokenizerError
from .patterns import escape, to_java

Segments = Callable[[Column], Column]


def literal_replacement(text: str) -> str:
    """Replacement text in which nothing refers to groups."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_text(text: Column, pattern: str, content: str, *, is_regex: bool = False) -> Column:
    if not is_regex:
        return F.replace(text, F.lit(pattern), F.lit(content)) if pattern else text
    return F.regexp_replace(text, F.lit(to_java(pattern)), F.lit(literal_replacement(content)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfc_segments(segments: pa.Array) -> pa.Array:
    out = [None if row is None else [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in row] for row in segments.to_pylist()]
    return pa.array(out, pa.list_(pa.string()))


def pattern_of(spec: dict, what: str) -> tuple[str, bool]:
    """The pattern of a description and whether it is a regular expression; a string pattern is taken literally."""
    pattern = spec.get("pattern")
    if isinstance(pattern, dict):
        if "Regex" in pattern:
            return pattern["Regex"], True
        if "String" in pattern:
            return pattern["String"], False
    raise TokenizerError(Error.LOAD_FAILURE, f"{what} needs a pattern of Regex or String")


def compile_normalizer(spec: dict | None) -> Segments:
    if spec is None:
        return lambda segments: segments
    kind = spec.get("type")
    if kind == "Replace":
        pattern, is_regex = pattern_of(spec, "Replace")
        if "content" not in spec:
            raise TokenizerError(Error.LOAD_FAILURE, "Replace needs content")
        return lambda segments: F.transform(segments, lambda t: replace_text(t, pattern, spec["content"], is_regex=is_regex))
    if kind == "Sequence":
        steps = [compile_normalizer(s) for s in spec.get("normalizers", [])]

        def run(segments: Column) -> Column:
            for step in steps:
                segments = step(segments)
            return segments

        return run
    if kind == "NFC":
        return nfc_segments
    raise TokenizerError(Error.LOAD_FAILURE, f"normalizer type {kind!r}")


__all__ = ["compile_normalizer", "escape", "literal_replacement", "nfc_segments", "pattern_of", "replace_text"]
