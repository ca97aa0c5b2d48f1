"""Regular expressions: constants, dialect translation to the JVM, and match columns.

Patterns come in the dialect of two engines.  Those without lookaround, back-references or possessive quantifiers are of
the first tier, where ``\\s`` is ASCII and lacks the vertical tab; the others are of the second, with Unicode classes.
``to_java`` rewrites a pattern so that the JVM's engine gives the same matches.  A pattern that matches the empty string is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Error, TokenizerError, log
from .batches import in_parts, small_batches

# Default pre-tokenization patterns of the public vocabularies.
RANK_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+"
RANK_PATTERN_LOOKAHEAD = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
CASED_PATTERN = r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+"
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIGITS_EACH = r"[^\p{N}]+|\p{N}"
DIGITS_RUN = r"[^\p{N}]+|[\p{N}]+"

#: What only the second tier's engine compiles.
SECOND_TIER = re.compile(r"\(\?<?[=!]|\\[1-9]|[*+?]\+|\{\d+(?:,\d*)?\}\+|\(\?>|\\[KGRX]")
#: The characters that ``escape`` puts a backslash before.
SPECIAL = set("\\^$.|?*+()[]{}")


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def tier(pattern: str) -> int:
    return 2 if SECOND_TIER.search(pattern) else 1


_fallback: Callable[[str], str | None] | None = None


def register_fallback(hook: Callable[[str], str | None] | None) -> None:
    """``hook`` gives a pattern of the JVM's dialect for one that is not understood here, or None."""
    global _fallback
    _fallback = hook


def to_java(pattern: str) -> str:
    """The pattern in the JVM's dialect, with the matches of the engine that its tier names."""
    try:
        if regex.compile(pattern, regex.V0).fullmatch("") is not None:
            raise TokenizerError(Error.REGEX_FAILURE, f"{pattern!r} matches the empty string")
    except regex.error as e:
        own = _fallback(pattern) if _fallback is not None else None
        if own is not None:
            return own
        log.error("%r: %s", pattern, e)
        raise TokenizerError(Error.REGEX_FAILURE, f"{pattern!r}: {e}") from None
    out, i, in_class, second = [], 0, False, tier(pattern) == 2
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == "\\s" and not second:
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            elif two == "\\S" and not second:
                if in_class:
                    raise TokenizerError(Error.REGEX_FAILURE, r"\S inside a class is not translated")
                out.append(r"[^\t\n\f\r ]")
            elif two == "\\z" or len(two) == 1:
                out.append(r"\z")
            else:
                out.append(two)
            i += 2
            continue
        c = two[0]
        if in_class:
            if c == "[" and pattern[i : i + 2] != "[:":
                out.append("\\[")  # the JVM would nest a class
            elif pattern[i : i + 2] == "&&":
                out.append("\\&\\&")
                i += 1
            else:
                in_class = c != "]"
                out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "$" and not second:
            out.append(r"\z")
        elif pattern.startswith("(?i", i):
            out.append("(?iu")
            i += 2
        else:
            out.append(c)
        i += 1
    return ("(?dU)" if second else "(?d)") + "".join(out)


def find_all(text: Column, pattern: str) -> Column:
    """All matches, left to right, without the text between them."""
    return F.regexp_extract_all(text, F.lit(to_java(pattern)), F.lit(0))


def find_all_with_gaps(text: Column, pattern: str) -> Column:
    """Matches and the stretches between them, in order: joined they are the text."""
    p = to_java(pattern)
    flags, body = p[: p.index(")") + 1], p[p.index(")") + 1 :]
    return F.regexp_extract_all(text, F.lit(rf"{flags}(?:{body})|(?s:.)+?(?=(?:{body})|\z)"), F.lit(0))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _summed(matches: pa.Array, gaps: pa.Array) -> pa.Array:
    return offset_rows(matches, gaps)


def offset_rows(matches: pa.Array, gaps: pa.Array) -> pa.Array:
    """Offsets from the byte lengths of matches and of the gaps before them."""
    return in_parts(_summed_part, matches, gaps)


def _summed_part(matches: pa.Array, gaps: pa.Array) -> pa.Array:
    count = np.asarray(pc.fill_null(pc.list_value_length(matches), 0)).astype(np.int64)
    gap_count = np.asarray(pc.fill_null(pc.list_value_length(gaps), 0)).astype(np.int64)
    own, before = np.asarray(matches.flatten()).astype(np.int64), np.asarray(gaps.flatten()).astype(np.int64)
    bounds, firsts = np.r_[0, np.cumsum(count)], np.cumsum(gap_count) - gap_count
    at = np.repeat(firsts - bounds[:-1], count) + np.arange(len(own))
    sums = np.r_[0, np.cumsum(own + before[at])]
    ends = sums[1:] - np.repeat(sums[bounds[:-1]], count)
    pairs = pa.StructArray.from_arrays([pa.array(ends - own), pa.array(ends)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs, mask=matches.is_null())


def match_offsets(text: Column, pattern: str) -> Column:
    """``array<struct<start, end>>`` of the matches, in bytes.  Only lengths leave the JVM: a running sum has no linear built-in."""
    small_batches()
    matches, gaps = find_all(text, pattern), F.split(text, to_java(pattern), -1)
    return _summed(F.transform(matches, F.octet_length), F.transform(gaps, F.octet_length))
