"""Special tokens: the pattern that finds them and a text's segments, cut before any normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.splitters import quoted


def special_order(specials: dict[str, int]) -> list[str]:
    """The order of the alternation, which matters only where one special begins another: by id modulo their number, then id."""
    n = max(1, len(specials))
    return sorted(specials, key=lambda s: (specials[s] % n, specials[s]))


def special_pattern(specials: dict[str, int]) -> str | None:
    """An alternation of the specials as literals; None without any."""
    return "|".join(quoted(s) for s in special_order(specials)) if specials else None


def segments(text: Column, specials: dict[str, int]) -> Column:
    """The text as ``array<string>``: allowed specials and the stretches between them, in order; an empty text has none."""
    pattern = special_pattern(specials)
    if pattern is None:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    # the first characters decide fast that no special begins at a place
    first = "".join(sorted({s[0] if s[0].isalnum() else "\\" + s[0] for s in specials}))
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?:{pattern})|.+?(?=(?=[{first}])(?:{pattern})|\z)"), F.lit(0))


def special_ids(specials: dict[str, int]) -> Column:
    """``map<string, bigint>`` literal."""
    if not specials:
        return F.create_map().cast("map<string,bigint>")
    return F.map_from_arrays(F.lit(list(specials)), F.lit([int(i) for i in specials.values()]).cast("array<bigint>"))


def allowed_specials(specials: dict[str, int], allowed: str | set[str] | frozenset[str] = "all") -> dict[str, int]:
    if allowed == "all":
        return specials
    if allowed == "none":
        return {}
    return {s: i for s, i in specials.items() if s in set(allowed)}
