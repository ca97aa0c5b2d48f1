"""Exact byte-level BPE token counts at every prefix of a text, by dynamic programming.

The encoding of a piece (a match of the pre-tokenizer's pattern) has a last token.  For a prefix of
the piece that last token is the one token, ending there, that starts where a shorter prefix ends whose
own last token does not merge with it; so count[i] = count[i - len(token)] + 1, in time linear in
the piece.  A text's counts follow from those of its pieces, since pieces are encoded alone.

The only prefixes that a plain concatenation would get wrong are those that cut the text where the
pattern then splits otherwise: inside a run of white space, inside a contraction, and inside a special string.
These are counted as the cut text would be.

Units never span a place where ``stretches`` cuts, so a text's steps are those of its stretches, and each distinct stretch is
counted once (two bounded generations of short ones are remembered).

What is stored for a text is one signed byte a code point: how far the count moves when the code
point is added (a merge can lower it).  Their running sum answers any truncation or budget question
without encoding again: see ``count_at``, ``longest_prefix`` and ``tokens_between``.

Edge cases: null and empty texts have no tokens and an empty table; unpaired surrogates cannot occur in Spark
strings; texts of any length are processed whole; repeated rows are counted one by one; an empty table gives no row; input columns
named like an output, in any case of letters, give way.
"""

from __future__ import annotations

import json
import operator
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, without
from .stretches import shape, stretches

#: The published byte-to-character table of byte-level BPE: printable bytes stand for themselves, the rest follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    table = {chr(b): b for b in _PRINTABLE}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
    return table


SPACE = r"\p{White_Space}"
#: Units between places where every prefix splits alike: white space with what follows it, or a contraction.
UNIT = regex.compile(rf"(?:{SPACE}*(?! ){SPACE})?'(?:s|t|re|ve|m|ll|d)|{SPACE}*(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|{SPACE}+")
LEADING = regex.compile(rf"{SPACE}*")
CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
#: The longest stretch that is remembered.
LONGEST = 64


class PrefixCounter:
    """Counts for one vocabulary file (byte-level BPE with the common pattern)."""

    def __init__(self, path: str, most: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if shape(spec) != "spaced":
            raise ValueError("only byte-level BPE with the common pattern and no normalizer is counted")
        table = byte_alphabet()
        as_bytes = lambda s: bytes(table[c] for c in s)
        self.tokens = [as_bytes(t) for t in spec["model"]["vocab"]]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        #: How a token of several bytes is made: (rank, left part, right part).
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.ranks.items():
            self.made.setdefault(a + b, (i, a, b))
        #: Finds the tokens that end at each byte, the longest first.
        self.ending = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.ending.add_word(t.decode("latin-1"), (i, len(t)))
        self.ending.make_automaton()
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.joined: dict[int, bool] = {}
        self.most = most
        #: Steps of stretches as signed bytes (False where one does not fit), in two bounded generations.
        self.young: dict[bytes, bytes | bool] = {}
        self.old: dict[bytes, bytes | bool] = {}

    # --- one piece
    def stays(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b``, side by side, are the encoding of their concatenation.

        Undoes the two tokens' merges, latest first.  If at some moment the parts that meet in the middle
        have a merge that comes before the one just undone, merging would have joined them.
        """
        left, right, before = self.tokens[a], self.tokens[b], 1 << 60
        while True:
            rank, made_left, made_right = self.ranks.get((left, right)), self.made.get(left), self.made.get(right)
            if rank is not None and rank < before:
                return False
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                before, left = made_left[0], made_left[2]
            else:
                before, right = made_right[0] + 1, made_right[1]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a piece, by bytes, from the empty one on."""
        counts, last, joined = [0] * (len(piece) + 1), [-1] * (len(piece) + 1), self.joined
        for end, (token, size) in self.ending.iter(piece.decode("latin-1")):
            i = end + 1
            if last[i] >= 0:
                continue
            start = i - size
            if start:  # a whole token is the encoding of its own bytes
                pair = last[start] << 32 | token
                known = joined.get(pair)
                if known is None:
                    if len(joined) > 1_000_000:
                        joined.clear()
                    known = joined[pair] = self.stays(last[start], token)
                if not known:
                    continue
            last[i], counts[i] = token, counts[start] + 1
        if -1 in last[1:]:
            raise ValueError(f"no token ends at byte {last.index(-1, 1)} of {piece!r}")
        return counts

    # --- pieces of a text
    def at_characters(self, piece: str) -> list[int]:
        """Counts after each code point of a piece."""
        data = piece.encode("utf-8")
        counts = self.prefix_counts(data)
        if len(data) == len(piece):
            return counts[1:]
        out, at = [], 0
        for c in piece:
            at += len(c.encode("utf-8"))
            out.append(counts[at])
        return out

    def unit_counts(self, unit: str) -> list[int]:
        """Counts after each code point of a unit: what the text up to there, cut, would have."""
        a = LEADING.match(unit).end()
        space, core = unit[:a], unit[a:]
        out = self.at_characters(space) if space else []
        if not core:
            return out
        if not space:
            base, piece = 0, core
        elif space[-1] == " ":
            base, piece = (out[-2] if a > 1 else 0), " " + core
        else:
            base, piece = (out[-2] if a > 1 else 0) + self.at_characters(space[-1])[-1], core
        inside = self.at_characters(piece)
        if len(core) == 3 and piece == core and CONTRACTION.fullmatch(core):
            inside[1] = inside[0] + self.at_characters(core[1])[-1]  # 'r is no contraction yet
        return out + [base + n for n in inside[len(piece) - len(core) :]]

    def ordinary(self, text: str) -> list[int]:
        out, base = [], 0
        for unit in UNIT.findall(text):
            out += [base + n for n in self.unit_counts(unit)]
            base = out[-1]
        return out

    def counts(self, text: str) -> list[int]:
        """Token count after each code point of a text, special strings included."""
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        out, base, at = [], 0, 0
        for m in [*self.special.finditer(text), None]:
            segment = text[at : m.start() if m else len(text)]
            inside = self.ordinary(segment)
            out += [base + n for n in inside]
            if m:
                # a cut special string is ordinary text that carries on the last unit
                units = UNIT.findall(segment)
                tail = units[-1] if units else ""
                start = base + (inside[-1] - self.unit_counts(tail)[-1] if tail else 0)
                partial = self.ordinary(tail + m[0])[len(tail) :]
                out += [start + n for n in partial[:-1]]
                base += (inside[-1] if inside else 0) + 1
                out.append(base)
                at = m.end()
        return out

    # --- steps, remembered by stretch
    def known(self, keys: list[bytes]) -> list[bytes | bool]:
        """The steps of distinct stretches."""
        young, old, new = self.young, self.old, {}
        found = [young.get(k) for k in keys]
        for i, x in enumerate(found):
            if x is None:
                k = keys[i]
                x = old.get(k)
                if x is None:
                    # a run of ASCII letters, with a space before it or not, is one piece
                    x = steps(self.prefix_counts(k)[1:] if k.removeprefix(b" ").isalpha() else self.counts(k.decode("utf-8")))
                    x = False if x is None else x
                found[i] = x
                if len(k) < LONGEST:
                    new[k] = x
        young.update(new)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return found

    def deltas(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One signed byte a code point of all texts, where each text's begin, and whether a step of it does not fit (``counts`` has those)."""
        pieces, first = stretches(texts)
        coded = pieces.dictionary_encode()
        known = self.known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(x or b"" for x in known), dtype=np.int8)
        size, wide = np.array([len(x) if x else 0 for x in known], dtype=np.int64), np.array([x is False for x in known], dtype=bool)
        at, place = np.cumsum(size) - size, np.asarray(coded.indices)
        n = size[place]
        ends = np.r_[0, np.cumsum(n)]
        odd = np.r_[0, np.cumsum(wide[place])]
        return flat[np.repeat(at[place] - ends[:-1], n) + np.arange(ends[-1])], ends[first], odd[first[1:]] > odd[first[:-1]]


def steps(counts: list[int]) -> bytes | None:
    """The differences of ``counts`` as signed bytes, or None if one does not fit."""
    moves = list(map(operator.sub, counts, [0, *counts]))
    return array("b", moves).tobytes() if not moves or min(moves) >= -128 and max(moves) <= 127 else None


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


OUTPUT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_width", T.IntegerType()), T.StructField("prefix_deltas", T.BinaryType())]


def prefix_token_counts(df: DataFrame, vocabulary: str, *, text: str = "text", table: bool = True) -> DataFrame:
    """``df`` without ``text``, with ``n_bytes``, ``n_tokens`` and the prefix table (``prefix_width`` bytes a step, ``prefix_deltas``).

    ``table=False`` leaves the table null, for callers that only want what follows from it.
    ``vocabulary`` is a path that every executor can open (an installed package's file).
    """
    kept = [f for f in without(df, *[f.name for f in OUTPUT]) if f.name != text]
    schema = T.StructType(kept + OUTPUT)

    def run(batches):
        own = counter(vocabulary)
        for whole in batches:
            for batch in slices(whole, text):
                flat, bounds, odd = own.deltas(batch.column(text))
                sums = np.r_[0, np.cumsum(flat, dtype=np.int64)]
                n_tokens, width = sums[bounds[1:]] - sums[bounds[:-1]], np.ones(batch.num_rows, np.int32)
                data = [flat[a:b].tobytes() if table else None for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                for i in np.flatnonzero(odd).tolist():
                    d = np.diff(np.array(own.counts(batch.column(text)[i].as_py()), dtype=np.int64), prepend=0)
                    n_tokens[i], width[i], data[i] = d.sum(), 4, d.astype("<i4").tobytes() if table else None
                n_bytes = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
                arrays = [batch.column(f.name) for f in kept] + [n_bytes, pa.array(n_tokens), pa.array(width), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


# --- questions to a stored table
def running(width: int, deltas: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas, dtype=np.int8 if width == 1 else "<i4"), dtype=np.int64)


def count_at(width: int, deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(running(width, deltas)[min(n_chars, len(deltas) // width) - 1]) if n_chars > 0 and deltas else 0


def longest_prefix(width: int, deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(running(width, deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_between(width: int, deltas: bytes, start: int, end: int) -> int:
    """How many tokens the text gains from code point ``start`` to ``end``."""
    return count_at(width, deltas, end) - count_at(width, deltas, start)
