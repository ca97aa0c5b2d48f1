"""Splits before merging: JSON descriptions compiled to functions from a text column to ``array<string>``.

All are single expressions that stay in the JVM.  A regular-expression Split returns the matches and drops what lies
between, whatever its behaviour says; ByteLevel keeps the gaps.  Unknown types, behaviours other than Removed, Isolated and
MergedWithPrevious, and ``invert`` raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Error, TokenizerError
from .bytelevel import to_printable
from .normalizers import pattern_of
from .patterns import BYTE_LEVEL_PATTERN, DIGITS_EACH, DIGITS_RUN, find_all, find_all_with_gaps

Pieces = Callable[[Column], Column]
MOST_CHARS, MOST_RUN = 400_000, 25_000


def quoted(text: str) -> str:
    """A literal for the JVM's regular expressions."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_if_empty(text: Column, pieces: Column) -> Column:
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def split_removed(text: Column, delimiter: str) -> Column:
    """Without the delimiter and without empty pieces."""
    pieces = F.filter(F.split(text, quoted(delimiter), -1), lambda x: x != "")
    return whole_if_empty(text, pieces)


def split_isolated(text: Column, delimiter: str) -> Column:
    """Each delimiter a piece of its own."""
    q = quoted(delimiter)
    return whole_if_empty(text, F.regexp_extract_all(text, F.lit(rf"(?s){q}|.+?(?={q}|\z)"), F.lit(0)))


def split_merged_with_previous(text: Column, delimiter: str) -> Column:
    """Each delimiter ends the piece before it."""
    return whole_if_empty(text, F.regexp_extract_all(text, F.lit(rf"(?s).*?{quoted(delimiter)}|.+"), F.lit(0)))


BEHAVIOURS = {"Removed": split_removed, "Isolated": split_isolated, "MergedWithPrevious": split_merged_with_previous}


def byte_level(text: Column, *, add_prefix_space: bool = True, pattern: str = BYTE_LEVEL_PATTERN) -> Column:
    """Pieces with their gaps, in the printable byte alphabet."""
    if add_prefix_space:
        text = F.when((text != "") & ~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text)
    return F.transform(find_all_with_gaps(text, pattern), to_printable)


def digits(text: Column, *, individual: bool = False) -> Column:
    return find_all(text, DIGITS_EACH if individual else DIGITS_RUN)


def long_input_parts(text: Column, *, most_chars: int = MOST_CHARS, most_run: int = MOST_RUN) -> Column:
    """A text in parts of at most ``most_chars``, each cut again inside any longer run of space or non-space."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(most_chars))
    parts = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(most_chars)))
    n = most_run
    stretch = rf"(?sU).*?(?:[^\s\x1c-\x1f]{{{n}}}(?=[^\s\x1c-\x1f])|[\s\x1c-\x1f]{{{n}}}(?=[\s\x1c-\x1f]))|.+"
    cut = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(stretch), F.lit(0))))
    return F.when(F.length(text) <= most_run, F.array(text)).otherwise(cut)


def compile_pretokenizer(spec: dict | None) -> Pieces:
    if spec is None:
        raise TokenizerError(Error.LOAD_FAILURE, "a pre-tokenizer is required")
    kind = spec.get("type")
    if kind == "Split":
        pattern, is_regex = pattern_of(spec, "Split")
        behaviour = spec.get("behavior") or "Removed"
        if spec.get("invert"):
            raise TokenizerError(Error.LOAD_FAILURE, "Split with invert")
        if behaviour not in BEHAVIOURS:
            raise TokenizerError(Error.LOAD_FAILURE, f"Split behaviour {behaviour!r}")
        if is_regex:
            return lambda text: find_all(text, pattern)
        return lambda text: BEHAVIOURS[behaviour](text, pattern)
    if kind == "Digits":
        return lambda text: digits(text, individual=bool(spec.get("individual_digits", False)))
    if kind == "ByteLevel":
        return lambda text: byte_level(text, add_prefix_space=bool(spec.get("add_prefix_space", True)), pattern=spec.get("pattern") or BYTE_LEVEL_PATTERN)
    if kind == "Sequence":
        steps = [compile_pretokenizer(s) for s in spec.get("pretokenizers", [])]

        def run(text: Column) -> Column:
            pieces = F.array(text)
            for step in steps:
                pieces = F.flatten(F.transform(pieces, step))
            return pieces

        return run
    raise TokenizerError(Error.LOAD_FAILURE, f"pre-tokenizer type {kind!r}")
