"""Token decoders: JSON descriptions compiled to functions from a token's text to its bytes' text (binary columns).

Between steps a token is a string; bytes that are not UTF-8 appear only with ByteLevel and ByteFallback, whose results are
binary and joined before any cast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Error, TokenizerError
from .bytelevel import byte_rows, in_alphabet, to_bytes

Decoder = Callable[[Column], Column]


def byte_level(token: Column) -> Column:
    """The bytes behind printable characters; another character gives a note with its bytes and the token, in its place."""

    def one(c: Column) -> Column:
        return F.when(in_alphabet(c), to_bytes(c)).otherwise(F.encode(F.concat(F.lit("[UNK_BYTE_0x"), F.lower(F.hex(F.encode(c, "UTF-8"))), token, F.lit("]")), "UTF-8"))

    odd = F.aggregate(F.split(token, ""), F.lit(b""), lambda acc, c: F.concat(acc, one(c)))
    return F.when(in_alphabet(token), to_bytes(token)).otherwise(odd)


def replace(token: Column, pattern: str, content: str) -> Column:
    return F.replace(token, F.lit(pattern), F.lit(content)) if pattern else token


def byte_fallback(token: Column) -> Column:
    """``<0xHH>`` as its byte; a valid beginning of the digits counts, values above 255 do not."""
    digits = F.regexp_extract(token, r"^<0x([0-9A-Fa-f]+)[^>]*>$", 1)
    value = F.ltrim(digits, F.lit("0"))
    return F.when((digits != "") & (F.length(value) <= 2), F.unhex(F.lpad(value, 2, "0"))).otherwise(F.encode(token, "UTF-8"))


def compile_decoder(spec: dict | None, *, whole_columns: bool = False) -> Decoder:
    """A function from token text (string) to bytes (binary); of ``whole_columns``, not of variables in lambdas, by faster functions."""
    if spec is None:
        raise TokenizerError(Error.LOAD_FAILURE, "a decoder of null")
    steps = _steps(spec)

    def run(token: Column) -> Column:
        is_binary = False
        for kind, step in steps:
            step = byte_rows if whole_columns and step is byte_level else step
            token = step(F.decode(token, "UTF-8") if is_binary else token)
            is_binary = kind
        return token if is_binary else F.encode(token, "UTF-8")

    return run


def _steps(spec: dict) -> list[tuple[bool, Decoder]]:
    kind = spec.get("type")
    if kind == "ByteLevel":
        return [(True, byte_level)]
    if kind == "Replace":
        pattern = spec.get("pattern")
        literal = pattern.get("String", "") if isinstance(pattern, dict) else pattern or ""
        return [(False, lambda t: replace(t, literal, spec.get("content", "")))]
    if kind == "ByteFallback":
        return [(True, byte_fallback)]
    if kind == "Fuse":
        return []
    if kind == "Sequence":
        return [s for d in spec.get("decoders", []) for s in _steps(d)]
    raise TokenizerError(Error.LOAD_FAILURE, f"decoder type {kind!r}")
