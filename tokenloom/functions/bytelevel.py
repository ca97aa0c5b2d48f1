"""The byte-level alphabet as column expressions: every byte stands for one printable character.

Bytes become a string of the code points 0 to 255 by decoding as ISO-8859-1, and one ``translate`` maps those, all in the JVM.
``translate`` looks up each character by itself, so whole columns (not lambdas) have ``printable_rows`` and ``byte_rows``, which take bytes from tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_parts, small_batches

# The bytes that stand for themselves; the others take U+0100 on, in order.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def alphabet() -> list[str]:
    """The character of each byte."""
    others = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]


ALPHABET = alphabet()
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}
_MOVED = [b for b in range(256) if ord(ALPHABET[b]) != b]
_FROM, _TO = "".join(map(chr, _MOVED)), "".join(ALPHABET[b] for b in _MOVED)


def to_printable(text: Column) -> Column:
    most = F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM.replace("\0", ""), _TO.replace(ALPHABET[0], ""))
    return F.replace(most, F.lit("\0"), F.lit(ALPHABET[0]))


def to_bytes(printable: Column) -> Column:
    """The bytes behind printable characters; all characters must be of the alphabet."""
    # translate takes a NUL for deletion, so byte 0 is put in by itself
    most = F.translate(printable, _TO.replace(ALPHABET[0], ""), _FROM.replace("\0", ""))
    return F.encode(F.replace(most, F.lit(ALPHABET[0]), F.lit("\0")), "ISO-8859-1")


def in_alphabet(text: Column) -> Column:
    return text.rlike("^[" + "".join("\\x{%x}" % ord(c) for c in ALPHABET) + "]*$")


# --- whole columns, by tables: of each byte its character in one or two bytes of UTF-8, and of each such character its byte
_CODE = np.array([ord(c) for c in ALPHABET])
_PAIR = np.array([[*c.encode("utf-8"), 0][:2] for c in ALPHABET], dtype=np.uint8)
_KEPT = np.stack([np.ones(256, dtype=bool), _CODE > 127], axis=1)
_BYTE = np.full(0x800, -1, dtype=np.int16)
_BYTE[_CODE] = np.arange(256)


def buffers(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a column of strings begin and end in its bytes, from 0, and the bytes."""
    _, at, data = rows.buffers()
    if not len(rows):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(at, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)


def column(kind: pa.DataType, ends: np.ndarray, data: np.ndarray, nulls: np.ndarray) -> pa.Array:
    valid = pa.array(~nulls).buffers()[1] if nulls.any() else None
    return pa.Array.from_buffers(kind, len(nulls), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def printable_part(texts: pa.Array) -> pa.Array:
    ends, data = buffers(texts)
    wide = np.r_[0, np.cumsum(_KEPT[data, 1])]
    return column(pa.string(), ends + wide[ends], _PAIR[data][_KEPT[data]], np.asarray(texts.is_null()))


def noted(token: str) -> bytes:
    """The bytes of a token that has characters outside the alphabet, with a note for each of them."""
    return b"".join(bytes([BYTE_OF[c]]) if c in BYTE_OF else f"[UNK_BYTE_0x{c.encode('utf-8').hex()}{token}]".encode() for c in token)


def byte_part(tokens: pa.Array) -> pa.Array:
    ends, data = buffers(tokens)
    nulls = np.asarray(tokens.is_null())
    heads = (data & 0xC0) != 0x80
    first = data[heads].astype(np.int64)
    second = np.r_[data[1:], 0][heads] if len(data) else data
    # a character of three bytes or more is no character of the alphabet, as is 0x7FF
    code = np.where(first < 0x80, first, np.where(first < 0xE0, (first & 0x1F) << 6 | second & 0x3F, 0x7FF))
    got = _BYTE[code]
    before = np.r_[0, np.cumsum(heads)][ends]
    odd = np.unique(np.searchsorted(before, np.flatnonzero(got < 0), side="right") - 1)
    out = column(pa.binary(), before, got.astype(np.uint8), nulls)
    if not len(odd):
        return out
    rows = out.to_pylist()
    for i in odd.tolist():
        rows[i] = noted(tokens[i].as_py())
    return pa.array(rows, pa.binary())


@F.arrow_udf(T.StringType())
def _printable(texts: pa.Array) -> pa.Array:
    return in_parts(printable_part, texts)


@F.arrow_udf(T.BinaryType())
def _bytes(tokens: pa.Array) -> pa.Array:
    return in_parts(byte_part, tokens)


def printable_rows(text: Column) -> Column:
    """``to_printable`` of a whole column."""
    small_batches()
    return _printable(text)


def byte_rows(token: Column) -> Column:
    """The bytes behind a whole column of printable characters; another character gives a note, as in ``decoders.byte_level``."""
    small_batches()
    return _bytes(token)
